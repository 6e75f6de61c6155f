"""One-to-one matching of the rows of two sides, pass by pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; a local folder stands in only where that is unset (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="tallyloom-"))


def assign_one_to_one(pairs: DataFrame, left: str, right: str, order: Sequence[Column]) -> DataFrame:
    """The greedy assignment by ``order`` (columns, the least first, without ties): each round keeps the pairs that are first for both ends.

    Equal to taking pairs in order one after the other, until no pair is open.
    Each round settles at least the first pair of every connected group and
    drops the pairs of settled rows; first pairs are minima, summed where the
    pairs lie. Lineage is cut by checkpoint(). A group whose rows are all tied
    takes a round a pair, see :func:`equal_key_pairs`.
    """
    keep_checkpoints(pairs.sparkSession)
    open_, done = pairs.withColumn("o__", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])), None
    while True:
        first = lambda end: open_.groupBy(end).agg(F.min("o__").alias("o__"))  # noqa: E731, B023
        kept = open_.join(first(left), [left, "o__"], "left_semi").join(first(right), [right, "o__"], "left_semi").checkpoint()
        if kept.isEmpty():
            break
        done = kept if done is None else done.unionByName(kept)
        open_ = open_.join(kept.select(left), left, "left_anti").join(kept.select(right), right, "left_anti").select(*open_.columns).checkpoint()
    return pairs.limit(0) if done is None else done.select(*pairs.columns)


def equal_key_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_id: str) -> DataFrame:
    """The k-th row of a key on one side with the k-th on the other: the greedy assignment of equal scores, without forming all pairs."""
    rank = lambda df, by: df.withColumn("k__", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    return rank(a, a_id).join(rank(b, b_id), [*keys, "k__"]).drop("k__")


def nearest_rows(a: DataFrame, b: DataFrame, a_pos: str, b_pos: str, reach: int = 35, most: int = 8) -> DataFrame:
    """For every row of ``a`` the ``most`` nearest rows of ``b`` by position, then those within ``reach``.

    Positions are cut into cells of reach + 1, and a row looks into its own
    and the two beside it, so the band join is an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / (reach + 1))
    wide = a.withColumn("cell__", F.explode(F.array(*[cell(a_pos) + k for k in (-1, 0, 1)])))
    near = wide.join(b.withColumn("cell__", cell(b_pos)), "cell__").withColumn("distance", F.abs(F.col(a_pos) - F.col(b_pos))).where(F.col("distance") <= reach)
    place = F.row_number().over(Window.partitionBy(a_pos).orderBy("distance", b_pos))
    return near.withColumn("place", place).where(F.col("place") <= most).drop("cell__")


def missing(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def character_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams of each word padded by a space; a padded word shorter than n counts once as it is."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    one = lambda w, n: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda k: F.substring(w, k, F.lit(n))))
    return F.flatten(F.transform(words, lambda w: F.concat(*[one(w, n) for n in range(low, high + 1)])))


def tfidf_neighbours(a: DataFrame, b: DataFrame, a_id: str, b_id: str, text: str, k: int = 8, block: Sequence[str] = ()) -> DataFrame:
    """(a_id, b_id, cosine, place): the ``k`` rows of ``b`` of highest character TF-IDF cosine for each row of ``a``, the smaller id first at a tie.

    An inverted index of n-grams: weights are unit vectors with 1 + ln tf and
    smoothed idf over both sides of a ``block`` (equal values of those
    columns); only rows that share an n-gram meet. An n-gram of many rows of
    ``b`` is joined in parts, so that none is one task's alone, and rows are
    summed by pair before they are shuffled.
    """
    by = [f"k{n}__" for n in range(len(block))]
    side = lambda df, i: df.select(*[F.col(c).alias(n) for c, n in zip(block, by)], F.col(i).alias("id"), F.explode(character_grams(F.col(text))).alias("g")).groupBy(*by, "id", "g").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    keep_checkpoints(a.sparkSession)
    both = side(a, a_id).withColumn("s", F.lit(0)).unionByName(side(b, b_id).withColumn("s", F.lit(1))).checkpoint()
    n = both.select(*by, "s", "id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else both.select("s", "id").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = both.groupBy(*by, "g").agg(F.count(F.lit(1)).alias("df"), F.sum("s").alias("right"))
    df = df.join(n, by) if by else df.crossJoin(F.broadcast(n))
    parts = F.least(F.ceil(F.col("right") / PART), F.lit(64)).cast("int")
    idf = df.select(*by, "g", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"), F.greatest(parts, F.lit(1)).alias("parts"))
    weighed = both.join(idf, [*by, "g"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("s", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighed.join(norm, ["s", "id"]).select(*by, "s", "id", "g", "parts", (F.col("w") / F.col("norm")).alias("w"))
    left = unit.where("s = 0").select(*by, "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("a_id"), F.col("w").alias("wa"))
    right = unit.where("s = 1").select(*by, "g", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("b_id"), F.col("w").alias("wb"))
    dots = left.join(right, [*by, "g", "part"]).groupBy("a_id", "b_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return dots.withColumn("place", F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("cosine"), "b_id"))).where(F.col("place") <= k)


#: Rows of an n-gram joined in one part.
PART = 2_000
