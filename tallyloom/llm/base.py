"""What the text operators share: words, shared scratch tables, components."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as a Java and a Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local folder stands in only where the setting is absent in a session of one process (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tallyloom-")
    return _own[app]


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written within leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage and its shuffle files end here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom-{name}-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tallyloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tallyloom_path", None)
        if path is None:
            continue
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def clear_own() -> None:
    """Remove the stand-in folders of :func:`shared_dir`."""
    while _own:
        shutil.rmtree(Path(_own.popitem()[1]), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a whole text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of ``edges(a, b)``; label is the smallest node of the component.

    Each round every node points at its smallest neighbour, pointers are
    doubled until they end at a local minimum, and the edges are rewritten
    between those ends; a round at least halves the nodes that still have
    edges. All state lives in shared tables, and nothing but two counts a
    round reaches the driver. Null ends and loops are ignored.
    """
    live = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    live = materialize(live, "edges")
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nodes = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        up = materialize(nodes.select("node", F.least("node", "low").alias("to")), "up")
        while True:
            top = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = materialize(up.join(top, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "up")
            moved = not jumped.where("moved").isEmpty()
            discard(up)
            up = jumped
            if not moved:
                break
        up = up.select("node", "to")
        if labels is None:
            labels = up.select("node", F.col("to").alias("label"))
        else:
            step = up.select(F.col("node").alias("label"), "to")
            labels = materialize(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = live.join(up.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a")
        left = left.join(up.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        fewer = materialize(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "edges")
        discard(live)
        live = fewer
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def join_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Components ``labels(node, label)`` after further edges ``more(a, b)``, found among the components alone."""
    end = lambda df, c: df.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_l")), c, "left").withColumn(f"{c}_l", F.coalesce(f"{c}_l", c))
    wide = end(end(more.select("a", "b"), "a"), "b")
    up = connected_components(wide.select(F.col("a_l").alias("a"), F.col("b_l").alias("b"))).select(F.col("node").alias("old"), F.col("label").alias("new"))
    all_nodes = labels.unionByName(wide.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_l").alias("label")), F.struct(F.col("b").alias("node"), F.col("b_l").alias("label")))).alias("x")).select("x.node", "x.label")).distinct()
    out = all_nodes.join(up, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    return materialize(out, "labels")


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8; bytes.split() parts at the six characters that SPACE names."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over Arrow batches of ``df``; fn takes an iterator of record batches and yields others."""
    return df.mapInArrow(fn, schema)
