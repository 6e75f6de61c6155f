"""Operator 8: SimHash classes found through an inverted index of fingerprint bytes by position."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import byte_words, connected_components, join_labels, map_batches, materialize, table

#: The largest posting list of which all pairs are formed; longer ones go through one-bit neighbours.
MOST_PAIRED = 32
SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    import numpy as np
    import xxhash

    found = byte_words(text)
    if not found:
        return 0
    joined, n = b" ".join(found), len(found)
    size = min(size, n)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, step, digest = np.zeros(64, np.int64), 1 << 15, xxhash.xxh64_intdigest
    for k in range(0, n - size + 1, step):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[k : min(k + step, n - size + 1)].tolist(), ends[k + size - 1 : k + step + size - 1].tolist())), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > n - size + 1, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), size) for t in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all of the distinct ``fps(fp)`` that differ in two bits or fewer into one component.

    Two bits lie in at most two of the eight bytes, so six positional bytes
    match, and with the bytes taken as four neighbouring pairs, two whole
    pairs do. A posting therefore holds the four bytes of two pairs (six
    postings a fingerprint). A pair met in a posting list is kept if its tally
    of equal positional bytes reaches six, then verified bit by bit. Members
    of a list of more than MOST_PAIRED are linked through their 65 values at
    distance one or less instead: two fingerprints are within two bits
    exactly if they share such a value. That is linear and loses nothing.
    """
    pairs = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(65535)) for k in range(4)]
    keys = [F.lit(c << 32).bitwiseOR(F.shiftleft(pairs[i], 16)).bitwiseOR(pairs[j]) for c, (i, j) in enumerate(combinations(range(4), 2))]
    posts = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    posts = posts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    posts = materialize(posts, "posts")
    few = posts.where(F.col("n") <= MOST_PAIRED).select("key", "fp")
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    met = a.join(b, "key").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 1").select("a", "b")
    tally = reduce(lambda x, y: x + y, [(_byte(F.col("a"), p) == _byte(F.col("b"), p)).cast("int") for p in range(8)])
    near = met.where(tally >= 6).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    many = posts.where(F.col("n") > MOST_PAIRED).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    around = many.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    around = around.withColumn("low", F.min("fp").over(Window.partitionBy("at"))).where("fp <> low").select(F.col("fp").alias("b"), F.col("low").alias("a"))
    return near.unionByName(around).distinct()


def simhash_classes(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id among all texts reachable over
    fingerprints that differ in two bits or fewer. Null and empty texts have
    fingerprint zero and link as any other. Exact copies share a fingerprint
    and meet only as a count; no pair of them is formed. Repeated rows come
    back as often as they came; other columns are ignored.
    """
    made = materialize(fingerprints(docs, size), "fp")
    firsts = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    labels = connected_components(link_fingerprints(firsts.select("fp")))
    linked = firsts.join(labels, firsts.fp == labels.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    lows = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    parts = linked.join(lows, "label").select("fp", "component_id")
    return made.join(parts, "fp").select("doc_id", "fp", "component_id")


@dataclass(frozen=True)
class Near:
    """Texts are near if the Jaccard of their sets of ``size`` words reaches ``least``.

    The wide fingerprint has ``triples`` x 24 bits, each the majority of a bit
    of the hashes of ``window`` neighbouring words. At the threshold a word in
    45 is changed where edits are scattered, so a bit differs with probability
    0.095 and one of 48 triples of bytes is equal in 99 of 100 pairs; where
    one block is replaced or added, in 61 (0.15 a bit). ``shared``: positional
    bytes that must be equal of all. paired: the longest posting list of which
    all pairs are formed. broadcast: most rows sent to all tasks at once.
    """

    size: int = 5
    least: float = 0.8
    window: int = 2
    triples: int = 48
    shared: int = 24
    paired: int = 32
    broadcast: int = 1_000_000


class _Hashes(dict):
    """Hashes of words, made once a word."""

    def __missing__(self, word):
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out


def _runs(words_: list[bytes], n: int, hashes: _Hashes):
    """Hashes of the runs of n words (of all, if they are fewer), repeats included."""
    import numpy as np

    one = np.fromiter(map(hashes.__getitem__, words_), np.uint64, len(words_))
    n = min(n, len(one))
    out = np.full(len(one) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ one[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def wide_fingerprint(words_: list[bytes], near: Near, hashes: _Hashes) -> bytes:
    """The fingerprint of a text with words, three bytes a posting."""
    import numpy as np

    lanes = -(-3 * near.triples // 8)
    odd = np.random.default_rng(17).integers(1, 1 << 63, lanes, dtype=np.uint64) | np.uint64(1)
    grams, total = _runs(words_, near.window, hashes), np.zeros(64 * lanes, np.int64)
    for at in range(0, len(grams), 255 * 32):
        part = grams[at : at + 255 * 32]
        mixed = part[:, None] * odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(part), -1), axis=1).view(np.uint64)
        for k in range(0, len(part), 255):  # eight counters a word, none of which can overflow
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * total > len(grams)).tobytes()[: 3 * near.triples]


def text_key(text: Column) -> Column:
    """128 bits of a text; all texts without a word, null included, are one."""
    return F.unhex(F.md5(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("").cast("binary")))


def wide_fingerprints(docs: DataFrame, near: Near) -> DataFrame:
    """(key, fp, posts) of every distinct text of ``docs(text)`` with a word; posts are the triples of bytes with their positions."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = _Hashes()
        for batch in batches:
            rows = [(k, w) for k, t in enumerate(batch.column(1)) if (w := byte_words(t.as_py()))]
            made = [wide_fingerprint(w, near, hashes) for _, w in rows]
            raw = np.frombuffer(b"".join(made), np.uint8).reshape(-1, near.triples, 3).astype(np.int32)
            posts = (np.arange(near.triples, dtype=np.int32) << 24) + (raw[:, :, 0] << 16) + (raw[:, :, 1] << 8) + raw[:, :, 2]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * near.triples), pa.array(posts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in rows], pa.int64())), pa.array(made, pa.binary()), lists], ["key", "fp", "posts"])

    made = map_batches(docs.select(text_key(F.col("text")).alias("key"), "text"), run, "key binary, fp binary, posts array<int>")
    return made.groupBy("key").agg(F.first("fp").alias("fp"), F.first("posts").alias("posts"))


def _enough_bytes(pairs: DataFrame, fps: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) of which at least ``shared`` positional bytes are equal."""
    side = lambda c: fps.select(F.col("key").alias(c), F.col("fp").alias(f"f{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= near.shared))

    return map_batches(both, run, "a binary, b binary")


def _near_texts(pairs: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) of keys whose whole texts have a Jaccard of ``least`` or more."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= near.broadcast else wanted
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = materialize(texts, "texts")
    side = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        import pyarrow as pa

        hashes = _Hashes()
        for batch in batches:
            held = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = (set(_runs(byte_words(v.as_py()), near.size, hashes).tolist()) for v in (x, y))
                shared = len(s & t)
                held.append(shared >= near.least * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    return map_batches(both, run, "a binary, b binary")


def _hot_pairs(hot: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """All pairs (a, b) of keys of ``hot(key, part, outside)``, one of them outside, that could be near and are of two parts.

    The exact way for long posting lists: with the runs of words of every
    text in one order, the rarest first, two near texts share one among the
    first k - least * k + 1 of their k, and what follows in both must suffice
    for the overlap that ``least`` asks for.
    """
    wanted = F.broadcast(hot) if hot.count() <= near.broadcast else hot
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(wanted, "key").groupBy("key", "part", "outside").agg(F.first("text").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = _Hashes()
        for batch in batches:
            for at in range(batch.num_rows):
                runs = np.unique(_runs(byte_words(batch.column(3)[at].as_py()), near.size, hashes)).view(np.int64)
                of = pa.array(np.full(len(runs), at, np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(3)), pa.array(np.full(len(runs), len(runs), np.int32)), pa.array(runs)], ["key", "part", "outside", "k", "h"])

    rows = materialize(map_batches(texts, run, "key binary, part binary, outside boolean, k int, h long"), "runs")
    seen = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(seen, "h").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("df", "h")))
    first = ranked.where((F.col("df") > 1) & (F.col("at") <= F.col("k") - F.ceil(near.least * F.col("k") - 1e-9) + 1))
    first = materialize(first.select("h", "key", "part", "outside", "k", "at"), "first")
    x = first.where("outside").select("h", *[F.col(c).alias(f"x_{c}") for c in ("key", "part", "k", "at")])
    need = F.lit(near.least / (1 + near.least)) * (F.col("k") + F.col("x_k")) - 1e-9
    fits = (F.col("part") != F.col("x_part")) & (1 + F.least(F.col("k") - F.col("at"), F.col("x_k") - F.col("x_at")) >= need)
    return first.join(x, "h").where(fits).select(F.least("key", "x_key").alias("a"), F.greatest("key", "x_key").alias("b")).distinct()


def near_classes(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """(node, label): the key (:func:`text_key`) of every text near another, and the smallest key of its class.

    Postings of three positional bytes bring texts together, a tally of all
    positional bytes and then the exact Jaccard of whole texts decide. Lists
    of up to ``paired`` texts are compared pair by pair, longer ones with their
    first. Texts that these edges put into the class of that first need no
    more; those outside are compared with all texts of long lists that are of
    another class, see :func:`_hot_pairs`. So a family of thousands of copies
    never meets in all pairs, and no link that could join two classes is left
    out.
    """
    fps = materialize(wide_fingerprints(docs, near), "wide")
    posts = fps.select("key", F.explode("posts").alias("post"))
    sizes = posts.groupBy("post").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("lead")).where("c > 1")
    posts = materialize(posts.join(sizes, "post"), "posts")
    few, many = posts.where(F.col("c") <= near.paired), posts.where(F.col("c") > near.paired)
    met = few.select("post", F.col("key").alias("a")).join(few.select("post", F.col("key").alias("b")), "post").where("a < b").select("a", "b")
    led = many.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    pairs = materialize(_enough_bytes(met.unionByName(led).distinct(), fps, near), "pairs")
    labels = connected_components(materialize(_near_texts(pairs, docs, near), "edges"))
    if many.isEmpty():
        return labels
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_part"))
    placed = many.join(of("key"), "key", "left").join(of("lead"), "lead", "left")
    placed = placed.select("post", "key", F.coalesce("key_part", "key").alias("part"), (F.coalesce("key_part", "key") != F.coalesce("lead_part", "lead")).alias("outside"))
    placed = materialize(placed, "placed")
    mixed = placed.where("outside").select("post").distinct()
    hot = materialize(placed.join(mixed, "post", "left_semi").groupBy("key", "part").agg(F.max("outside").alias("outside")), "hot")
    if hot.isEmpty():
        return labels
    return join_labels(labels, materialize(_near_texts(materialize(_hot_pairs(hot, docs, near), "pairs"), docs, near), "edges"))


def without_near_copies(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that come first in their class of near or equal texts.

    First is the smallest doc_id, null last, then the smallest key of the
    text; of rows equal in id and text one stays. Null, empty and blank texts
    are equal texts. All columns stay as they are.
    """
    at = materialize(docs.select("doc_id", text_key(F.col("text")).alias("key")), "rows")
    labels = near_classes(docs, near).withColumnRenamed("node", "key")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    seen = at.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("same")).join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    seen = materialize(seen.select("doc_id", "key", "same", "label"), "classes")
    heads = seen.groupBy("label").agg(F.min(place).alias("head"), F.sum("same").alias("n")).where("n > 1").select("head")
    first = heads.select(F.col("head.doc_id").alias("h_id"), F.col("head.key").alias("h_key"))
    grouped = seen.join(seen.groupBy("label").agg(F.sum("same").alias("n")).where("n > 1").select("label"), "label", "left_semi")
    is_head = grouped.doc_id.eqNullSafe(first.h_id) & (grouped.key == first.h_key)
    gone = materialize(grouped.join(first, is_head, "left_anti").select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key")), "gone")
    twice = materialize(grouped.join(first, is_head, "left_semi").where("same > 1").select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key")), "twice")
    small = lambda df: F.broadcast(df) if df.count() <= near.broadcast else df
    rows = docs.select(F.struct(*docs.columns).alias("row__"), F.col("doc_id").alias("id__"), text_key(F.col("text")).alias("key__"))
    same = lambda df: F.col("id__").eqNullSafe(df.g_id) & (F.col("key__") == df.g_key)
    out = rows.join(small(gone), same(gone), "left_anti")
    if not twice.isEmpty():
        held = small(twice)
        out = out.join(held, same(twice), "left_anti").unionByName(out.join(held, same(twice), "left_semi").dropDuplicates(["id__", "key__"]))
    return out.select(*[F.col("row__").getField(c).alias(c) for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE: dict[str, str] = {}
