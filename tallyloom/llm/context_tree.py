"""Operator 5: language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import crc_mod, map_batches, materialize, table

LOG2 = float(np.log(2))


@dataclass(frozen=True)
class Tree:
    """depth: bytes of the longest context (3 to 6). All contexts of the corpus have a node, so the model grows with it.

    split: the bytes next to the predicted one whose contexts are worked on in
    one task. block: runs of depth + 1 bytes looked up in one pass over the
    texts; more runs make more passes, and none holds more than 12 bytes a run.
    """

    depth: int = 5
    split: int = 2
    block: int = 4_000_000
    chunk: int = 1 << 21
    head: int = 50_000


def _bytes(texts, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts lower-cased, each after ``depth`` zero bytes and closed by one, and the place of each first byte."""
    pad, parts, starts, at = bytes(depth), [], [], 0
    for text in texts:
        own = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
        starts.append(at + depth)
        parts += (pad, own, b"\0")
        at += depth + len(own) + 1
    return np.frombuffer(b"".join(parts), np.uint8), np.array(starts, np.int64)


def _pieces(texts, size: int):
    """(place of the first, texts) of runs of texts of about ``size`` bytes."""
    part, total, at = [], 0, 0
    for k, text in enumerate(texts):
        part.append(text)
        total += len(text or "") + 8
        if total >= size:
            yield at, part
            part, total, at = [], 0, k + 1
    if part:
        yield at, part


def _targets(flat: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """True at the bytes to be predicted: all but the zeros before each text."""
    out = np.ones(len(flat), bool)
    for k in range(1, depth + 1):
        out[starts - k] = False
    return out


def _codes(flat: np.ndarray, depth: int) -> np.ndarray:
    """At every byte the run of depth + 1 bytes that ends there, the last byte lowest."""
    out = np.zeros(len(flat), np.int64)
    for k in range(depth + 1):
        out[k:] |= flat[: len(flat) - k].astype(np.int64) << (8 * k)
    return out


def _folded(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
    return [(keys[first], np.add.reduceat(n[order], first) if len(first) else n)]


def gram_counts(docs: DataFrame, tree: Tree) -> DataFrame:
    """(gram, n) of every run of depth + 1 bytes that ends at a byte of ``docs(text, train)``; n counts those where ``train`` holds, summed over all rows."""
    depth, chunk = tree.depth, tree.chunk

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            train = np.array(batch.column(1).to_pylist(), bool)
            for first, part in _pieces(batch.column(0).to_pylist(), chunk):
                flat, starts = _bytes(part, depth)
                here = _targets(flat, starts, depth)
                # The flag goes below the run, so that one sort of plain numbers does.
                keys = _codes(flat, depth)[here] << 1
                keys |= np.repeat(train[first : first + len(part)], np.diff(np.append(starts, len(flat) + depth)) - depth)
                keys.sort()
                runs = keys >> 1
                new = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
                held.append((runs[new], np.add.reduceat(keys & 1, new)))
                if len(held) == 8:
                    held = _folded(held)
        if held:
            (keys, sums), = _folded(held)
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(sums[k : k + 100_000])], ["gram", "n"])

    return map_batches(docs.select("text", "train"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5 by the recurrence up to 8 and Stirling's series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(y), shift)
        y = np.where(low, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _evidence(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of that many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - np.log(np.pi)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of a half of each, and the weight that the data leave to the node's own estimate."""
    whole = np.logaddexp(own, below) - LOG2
    return whole, np.exp(own - LOG2 - whole)


def _levels(gram: np.ndarray, n: np.ndarray, depths: range):
    """For each of the 8 bits of the predicted byte: (bit, its node, {depth: (contexts with the node, place of each gram, zeros, ones, weight)}, ln evidence at the least depth).

    A byte is eight binary decisions, at the nodes 1 and then 2k or 2k + 1;
    the decisions of a level have trees of their own, so levels are worked on
    one by one and only contexts that occur have entries.
    """
    byte = gram & 255
    for level in range(8):
        node, bit = (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1
        found, below = {}, None
        for d in reversed(depths):
            keys, place = np.unique(((gram >> 8) & ((1 << 8 * d) - 1)) << 8 | node, return_inverse=True)
            zeros, ones = np.bincount(place, n * (1 - bit), len(keys)), np.bincount(place, n * bit, len(keys))
            own = _evidence(zeros, ones)
            if below is None:
                whole, weight = own, np.ones(len(keys))
            else:
                longer, of_longer = below
                up = np.searchsorted(keys, ((longer >> 8) & ((1 << 8 * d) - 1)) << 8 | (longer & 255))
                whole, weight = _mixed(own, np.bincount(up, of_longer, len(keys)))
            found[d] = (keys, place, zeros, ones, weight)
            below = (keys, whole)
        yield bit, node, found, below[1]


def _by_suffix(counts: DataFrame, tree: Tree, fn, schema: str) -> DataFrame:
    """``fn(gram, n)`` for the runs of each suffix of ``split`` bytes."""
    suffix = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * tree.split)) - 1))

    def run(data):
        import pyarrow as pa

        out = fn(data.column("gram").to_numpy(), data.column("n").to_numpy())
        return pa.table(out)

    return counts.groupBy(suffix.alias("suffix")).applyInArrow(lambda data: run(data), schema)


def train(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """(gram, logp): log10 P(last byte | the bytes before it) of every run of depth + 1 bytes of ``docs(text, train)``.

    Every binary node of every context of 0 to ``depth`` bytes mixes its own
    Krichevsky-Trofimov estimate and what its longer contexts say, with the
    weights that the training counts give them (a half each before any data).
    The contexts of one suffix are a subtree, worked on in one task; of each
    byte's subtrees only the sums at their roots come to the driver (at most
    256 x 255 rows), which mixes the shorter contexts.
    """
    counts = materialize(gram_counts(docs, tree), "grams")
    low, depths = tree.split, range(tree.split, tree.depth + 1)
    if low not in (1, 2):
        raise ValueError("split is 1 or 2")

    def roots(gram, n):
        rows = [(found[low][0], whole, found[low][2], found[low][3]) for _, _, found, whole in _levels(gram, n, depths)]
        keys, whole, zeros, ones = (np.concatenate(x) for x in zip(*rows))
        return {"ctx": keys >> 8, "node": (keys & 255).astype(np.int32), "whole": whole, "zeros": zeros.astype(np.float64), "ones": ones.astype(np.float64)}

    above = _by_suffix(counts, tree, roots, "ctx long, node int, whole double, zeros double, ones double")
    above = above.groupBy((F.col("ctx").bitwiseAND(F.lit(255)) if low == 2 else F.lit(0).cast("long")).alias("ctx"), "node")
    above = above.agg(F.sum("whole").alias("whole"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    root = above.toArrow()
    ctx, node, below, zeros, ones = (root.column(c).to_numpy() for c in ("ctx", "node", "whole", "zeros", "ones"))
    said, left = np.zeros((256, 256)), np.ones((256, 256))
    whole, weight = _mixed(_evidence(zeros, ones), below)
    tops = {k: np.bincount(node, v, 256) for k, v in (("zeros", zeros), ("ones", ones), ("below", whole if low == 2 else below))}
    _, top = _mixed(_evidence(tops["zeros"], tops["ones"]), tops["below"])
    said += top * _estimate(tops["zeros"], tops["ones"])
    left *= 1 - top
    if low == 2:
        said[ctx, node] += left[ctx, node] * weight * _estimate(zeros, ones)
        left[ctx, node] *= 1 - weight
    shared = docs.sparkSession.sparkContext.broadcast((said, left))

    def predicted(gram, n):
        first, logs = (gram >> 8) & 255, np.zeros(len(gram))
        for bit, node, found, _ in _levels(gram, n, depths):
            p, rest = shared.value[0][first, node], shared.value[1][first, node]
            for d in depths:
                _, place, zeros, ones, weight = found[d]
                p = p + rest * weight[place] * _estimate(zeros, ones)[place]
                rest = rest * (1 - weight[place])
            logs += np.log10(np.where(bit == 1, p, 1 - p))
        return {"gram": gram, "logp": logs.astype(np.float32)}

    return materialize(_by_suffix(counts, tree, predicted, "gram long, logp float"), "model")


class _Lookup:
    """Values of sorted codes, 0 for others: most by one look at a table of hashes, those that lost their place there by search."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(4 * max(1, len(codes)))))))
        self.keys = np.full(1 << int(64 - self.shift), -1, np.int64)
        self.held = np.zeros(len(self.keys), np.float32)
        place = self._place(codes)
        self.keys[place], self.held[place] = codes, values
        lost = self.keys[place] != codes
        self.codes, self.values = codes[lost], values[lost]

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        place = self._place(wanted)
        hit = self.keys[place] == wanted
        out = np.where(hit, self.held[place], np.float32(0))
        if len(self.codes) and len(rest := np.nonzero(~hit)[0]):
            at = np.minimum(np.searchsorted(self.codes, wanted[rest]), len(self.codes) - 1)
            out[rest] = np.where(self.codes[at] == wanted[rest], self.values[at], np.float32(0))
        return out


def _blocks(model: DataFrame, tree: Tree):
    """(runs in order, their logp) of the model, at most about ``block`` of them at once."""
    parts = max(1, -(-model.count() // tree.block))
    for k in range(parts):
        own = model.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k) if parts > 1 else model
        got = own.toArrow()
        gram, logp = got.column("gram").to_numpy(), got.column("logp").to_numpy()
        order = np.argsort(gram)
        yield gram[order], logp[order]


def model_scores(docs: DataFrame, model: DataFrame, tree: Tree, *keep: str) -> DataFrame:
    """``keep``, n_bytes and score (log10 P of the lower-cased text and its end) for every row of ``docs(text)``, all of whose runs the model has.

    The model is sent to the tasks in blocks of bounded size; a text goes
    through one pass a block within its task, and no text is shuffled.
    """
    depth, chunk = tree.depth, tree.chunk
    names = [f.name for f in docs.schema.fields if f.name in keep]
    fields = [docs.schema[c] for c in names]
    out = docs.select(*names, "text", F.lit(0).cast("long").alias("n_bytes"), F.lit(0.0).alias("score"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string, n_bytes long, score double"])
    for gram, logp in _blocks(model, tree):
        shared = docs.sparkSession.sparkContext.broadcast((gram, logp))

        def run(batches, shared=shared):
            import pyarrow as pa

            found = _Lookup(*shared.value)
            for batch in batches:
                sizes, scores = [], []
                for _, part in _pieces(batch.column(len(fields)).to_pylist(), chunk):
                    flat, starts = _bytes(part, depth)
                    here = _targets(flat, starts, depth)
                    value = np.zeros(len(flat))
                    value[here] = found(_codes(flat, depth)[here])
                    scores.append(np.add.reduceat(value, starts))
                    sizes.append(np.diff(np.append(starts, len(flat) + depth)) - depth - 1)
                before = batch.column(len(fields) + 2).to_numpy()
                total = before + np.concatenate([*scores, np.zeros(0)])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields) + 1], pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(total)], [*names, "text", "n_bytes", "score"])

        out = map_batches(out, run, schema)
    return out.drop("text")


def _words_of(batch, column: int):
    """The words of each text of a column as bytes, A-Z lower-cased."""
    import pyarrow as pa

    for text in batch.column(column).cast(pa.binary()).to_pylist():
        yield [] if text is None else text.lower().split()


def word_counts(docs: DataFrame, held: int = 500_000) -> DataFrame:
    """(word, c) of ``docs(text)``, words as bytes; a task holds about ``held`` words at once and passes their counts on."""

    def run(batches):
        import pyarrow as pa

        def out():
            for k in range(0, len(found := list(counts.items())), 100_000):
                part = found[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], ["word", "c"])
            counts.clear()

        counts = Counter()
        for batch in batches:
            for own in _words_of(batch, 0):
                counts.update(own)
                if len(counts) >= held:
                    yield from out()
        yield from out()

    return map_batches(docs.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _looked_up(docs: DataFrame, head: DataFrame) -> DataFrame:
    """(doc_id, mark, size, known, logs, rare) by row of ``docs(doc_id, mark, text)``: number of words, of those in ``head(word, c)``, their log10(c + 1) in all, and the other words."""
    got = head.toArrow()
    logs_of = dict(zip(got.column("word").to_pylist(), np.log10(got.column("c").to_numpy() + 1.0).tolist()))
    shared = docs.sparkSession.sparkContext.broadcast(logs_of)

    def run(batches):
        import pyarrow as pa

        find = shared.value.get
        for batch in batches:
            sizes, knowns, logs, rare = [], [], [], []
            for own in _words_of(batch, 2):
                found = [find(w) for w in own]
                others = [w for w, x in zip(own, found) if x is None]
                sizes.append(len(own))
                knowns.append(len(own) - len(others))
                logs.append(sum(x for x in found if x is not None))
                rare.append(others)
            arrays = [pa.array(sizes, pa.int64()), pa.array(knowns, pa.int64()), pa.array(logs, pa.float64()), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "mark", "size", "known", "logs", "rare"])

    return map_batches(docs.select("doc_id", "mark", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, size long, known long, logs double, rare array<binary>")


def word_scores(docs: DataFrame, training: DataFrame, tree: Tree) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_rows, n_tokens, known_words, logs) by text, and one row (train_rows, n, v) of the training tokens.

    Words are cut once to be counted and once to be looked up, where they are
    read. Those of the ``head`` most frequent (a bounded list) are looked up in
    a broadcast; only the others, none of them frequent, are joined by word.
    """
    counts = materialize(word_counts(training), "words")
    of = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("v"))
    totals = of.crossJoin(training.agg(F.count(F.lit(1)).alias("train_rows"))).select("train_rows", (F.col("w") + F.col("train_rows")).alias("n"), (F.col("v") + (F.col("train_rows") > 0).cast("long")).alias("v"))
    head = counts.orderBy(F.desc("c"), "word").limit(tree.head)
    looked = materialize(_looked_up(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), head), "looked")
    frequent = looked.where("known > 0").groupBy("doc_id", "mark").agg(F.sum("known").alias("known"), F.sum("logs").alias("logs"))
    rare = looked.select("doc_id", "mark", F.explode("rare").alias("word")).join(counts, "word").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    sizes = looked.select("doc_id", "mark", "size")
    sizes = sizes.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n_rows"), F.first("size").alias("size"))
    both = frequent.unionByName(rare).groupBy("doc_id", "mark").agg(F.sum("known").alias("known"), F.sum("logs").alias("logs"))
    same = (sizes.doc_id.eqNullSafe(both.doc_id)) & (sizes.mark == both.mark)
    out = sizes.join(both, same, "left").select(sizes.doc_id, sizes.mark, (F.col("size") + 1).alias("n_tokens"), (F.coalesce("known", F.lit(0)) / F.col("n_rows")).cast("long").alias("known"), (F.coalesce("logs", F.lit(0.0)) / F.col("n_rows")).alias("logs"))
    return out, totals


def score_texts(docs: DataFrame, held_out, tree: Tree = Tree()) -> DataFrame:
    """Base and model scores for every row of ``docs(doc_id, text)``; rows where ``held_out`` (a Column) holds are not learned from.

    n_tokens, n_known, train_tokens and base_score follow the add-one word
    model with one end a text; n_bytes, score and code_length (bits a byte, end
    included) follow the context tree. A null text counts as empty. With
    nothing to learn from the base is that of an empty vocabulary and the tree
    gives every byte 1/256. Repeated rows are scored alike. Other columns are
    ignored.
    """
    docs = docs.select("doc_id", "text")
    training = docs.where(~held_out)
    model = train(docs.select("text", (~held_out).alias("train")), tree)
    base, totals = word_scores(docs, training, tree)
    t = totals.first()
    end = 1 if t["train_rows"] else 0
    scored = model_scores(docs.withColumns({"mark": F.xxhash64("text"), "held_out": held_out}), model, tree, "doc_id", "mark", "held_out")
    joined = scored.join(base.withColumnsRenamed({"doc_id": "d__", "mark": "m__"}), F.col("doc_id").eqNullSafe(F.col("d__")) & (F.col("mark") == F.col("m__")))
    space = float(t["n"]) + float(t["v"]) + 1.0
    base_score = F.col("logs") + F.log10(F.lit(float(t["train_rows"]) + 1.0)) - F.col("n_tokens") * F.log10(F.lit(space))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.lit(end)).cast("long").alias("n_known"), F.lit(t["n"]).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("code_length"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)))


QUERIES = {"op5_lm_scores": op5_lm_scores}
ORACLE: dict[str, str] = {}
