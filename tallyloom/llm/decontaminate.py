"""Operator 2: benchmark passages in training texts by n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import map_batches, table


@dataclass(frozen=True)
class Search:
    """gram: words of a seed, all of which are looked up; least: aligned share of the item's best score.

    block: words of items taken at once. More items are searched in further
    passes over the texts, so what is broadcast stays below it.
    """

    gram: int = 4
    least: float = 0.5
    match: int = 2
    differ: int = -1
    gap: int = -1
    block: int = 1_000_000


_TERM = re.compile(r"[^\W_]+")


def terms(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, so that case and punctuation do not part a copy from its item."""
    return _TERM.findall(text.lower()) if text else []


def _ids(text, vocabulary: dict[str, int]) -> np.ndarray:
    found = terms(text)
    return np.fromiter(map(vocabulary.get, found, [-1] * len(found)), np.int64, len(found))


def _grams(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the runs of n known words; hashes are compared with those of items alone and checked by alignment."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids >= 0
    run = known[: len(ids) - n + 1].copy()
    for k in range(1, n):
        run &= known[k : len(ids) - n + 1 + k]
    at = np.nonzero(run)[0]
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ (ids[at + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return at, out


def align(a: np.ndarray, b: np.ndarray, search: Search) -> tuple[int, int, int]:
    """Best local alignment of the words a with the item b: (score, first place in a, place after the last).

    A row of the Smith-Waterman table a word of ``a``. A gap along b is a
    running maximum, since the gap cost is linear.
    """
    m = len(b)
    score, since = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    best = (0, 0, 0)
    steps = np.arange(m + 1) * search.gap
    for i, word in enumerate(a):
        diagonal = score[:-1] + np.where(b == word, search.match, search.differ)
        up = score[1:] + search.gap
        here, from_ = np.zeros(m + 1, np.int64), np.full(m + 1, i + 1, np.int64)
        take = (diagonal >= up) & (diagonal > 0)
        here[1:] = np.maximum(np.maximum(diagonal, up), 0)
        opened = np.where(score[:-1] > 0, since[:-1], i)
        from_[1:] = np.where(take, opened, np.where(up > 0, since[1:], i + 1))
        flat = here - steps
        peak = np.maximum.accumulate(flat)
        origin = np.maximum.accumulate(np.where(flat == peak, np.arange(m + 1), 0))
        run = peak + steps
        wider = run > here
        here, from_ = np.where(wider, run, here), np.where(wider, from_[origin], from_)
        score, since = here, from_
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(since[top]), i + 1)
    return best


class Items:
    """A block of items by their place in it (ids may repeat or be null), their words as numbers, and their seeds."""

    def __init__(self, rows, search: Search):
        self.vocabulary: dict[str, int] = {}
        self.search, self.words, self.ids = search, [], []
        for item, text in rows:
            self.ids.append(item)
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in terms(text)], np.int64))
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        for item, ids in enumerate(self.words):
            for at, seed in zip(*map(np.ndarray.tolist, _grams(ids, min(search.gram, max(1, len(ids)))))):
                self.seeds.setdefault(seed, []).append((item, at))

    def reach(self, size: int) -> int:
        """Words of a text that an alignment reaching ``least`` can have beyond those of the item: each costs a gap."""
        return int(self.search.match * (1 - self.search.least) * size / -self.search.gap)

    def sizes(self) -> list[int]:
        return sorted({min(self.search.gram, max(1, len(ids))) for ids in self.words if len(ids)})


def _blocks(items: DataFrame, search: Search):
    """Items by block; only one block is in the driver at a time."""
    block, total = [], 0
    for r in items.where("text is not null").groupBy("item_id", "text").agg(F.count(F.lit(1))).orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        total += len(terms(r["text"]))
        if total >= search.block:
            yield block
            block, total = [], 0
    if block:
        yield block


def _aligned(docs: DataFrame, shared, search: Search, keep: tuple[str, ...], clean: bool = False, item_type: T.DataType = T.LongType()) -> DataFrame:
    """The columns ``keep`` with each alignment; or, if ``clean``, the rows without any."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields, kind = [docs.schema[c] for c in keep], to_arrow_type(item_type)

    def run(batches):
        import pyarrow as pa

        bank = shared.value
        wanted = np.array(sorted(bank.seeds), np.uint64)
        names = [*(f.name for f in fields), "item_id", "score", "similarity", "first_word", "last_word"]
        for batch in batches:
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(len(fields)).to_pylist()):
                ids = _ids(text, bank.vocabulary)
                spans: dict[int, list[tuple[int, int]]] = {}
                for n in bank.sizes():
                    places, seeds = _grams(ids, n)
                    at = np.searchsorted(wanted, seeds)
                    at[at == len(wanted)] = 0
                    for place, seed in zip(places[wanted[at] == seeds].tolist(), seeds[wanted[at] == seeds].tolist()):
                        for item, inside in bank.seeds[seed]:
                            size = len(bank.words[item])
                            reach = bank.reach(size)
                            spans.setdefault(item, []).append((max(0, place - inside - reach), min(len(ids), place - inside + size + reach)))
                for item, own in spans.items():
                    b, best = bank.words[item], (0, 0, 0)
                    joined: list[list[int]] = []
                    for lo, hi in sorted(own):
                        if joined and lo <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], hi)
                        else:
                            joined.append([lo, hi])
                    for lo, hi in joined:
                        score, first, last = align(ids[lo:hi], b, search)
                        if score > best[0]:
                            best = (score, lo + first, lo + last)
                    if best[0] >= search.least * search.match * len(b):
                        rows.append((k, bank.ids[item], best[0], best[0] / (search.match * len(b)), best[1], best[2]))
            if clean:
                stays = np.ones(batch.num_rows, bool)
                stays[[r[0] for r in rows]] = False
                yield pa.RecordBatch.from_arrays(batch.columns[: len(fields)], list(keep)).filter(pa.array(stays))
            elif rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(cols[0])) for c in batch.columns[: len(fields)]), *(pa.array(c, t) for c, t in zip(cols[1:], (kind, pa.int64(), pa.float64(), pa.int64(), pa.int64())))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    if not clean:
        schema += f", item_id {item_type.simpleString()}, score long, similarity double, first_word long, last_word long"
    return map_batches(docs.select(*keep, F.col("text").alias("text__")), run, schema)


def _passes(docs: DataFrame, items: DataFrame, search: Search):
    """A broadcast of each block of items."""
    context = docs.sparkSession.sparkContext
    for block in _blocks(items, search):
        yield context.broadcast(Items(block, search))


def find_leaks(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """(doc_id, item_id, score, similarity, first_word, last_word): every row of ``docs(doc_id, text)`` with each item of ``items(item_id, text)`` aligned in it.

    A text is aligned with an item wherever it has ``gram`` neighbouring words
    of it, as far around as an alignment that reaches ``least`` can extend.
    Of a text's alignments with an item the best is returned if it reaches
    ``least`` of the score of a whole copy.
    Words are those of :func:`terms`. Items shorter than a seed are seeds
    themselves; null or empty texts and items match nothing. Items are told by
    id and text, so two texts under one id, or under none, are two items, and
    a repeated item is one. Repeated documents give repeated results; other
    columns are ignored.
    """
    out = None
    for shared in _passes(docs, items, search):
        part = _aligned(docs, shared, search, ("doc_id",), item_type=items.schema["item_id"].dataType)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind, of = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
        out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {of}, score long, similarity double, first_word long, last_word long")
    return out


def without_leaks(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of ``docs`` in which :func:`find_leaks` aligns no item, with all their columns and without a shuffle."""
    out = docs
    for shared in _passes(docs, items, search):
        out = _aligned(out, shared, search, tuple(docs.columns), clean=True)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE: dict[str, str] = {}
