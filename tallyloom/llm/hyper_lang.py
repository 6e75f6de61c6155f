"""Operator 4: language by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import crc_mod, map_batches, table


@dataclass(frozen=True)
class Profile:
    """dims: length of the vectors; gram: letters bound together.

    block, texts: characters and texts encoded at once (a longer text is a
    block of its own); part: n-gram vectors held at once.
    """

    dims: int = 768
    gram: int = 3
    seed: int = 7
    block: int = 300_000
    texts: int = 1_000
    part: int = 4_096


@lru_cache(maxsize=None)
def _is_letter():
    import sys

    table_ = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table_[c] = ord(low[0]) if low[0].isalpha() else c
    return table_


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters as code points; every run of anything else is one 0, with a 0 at either end."""
    if not text:
        return np.zeros(0, np.uint32)
    mapped = _is_letter()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    mapped = np.concatenate((np.zeros(1, np.uint32), mapped, np.zeros(1, np.uint32)))
    keep = np.ones(len(mapped), bool)
    keep[1:] = (mapped[1:] != 0) | (mapped[:-1] != 0)
    out = mapped[keep]
    return out if out.any() else np.zeros(0, np.uint32)


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int, profile: Profile) -> np.ndarray:
    return np.random.default_rng((profile.seed, code)).choice(np.array([-1, 1], np.int8), profile.dims)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams, 21 bits a letter, without those of gaps alone."""
    if len(codes) < n:
        return np.zeros(0, np.int64)
    wide = codes.astype(np.int64)
    out = wide[: len(wide) - n + 1].copy()
    for k in range(1, n):
        out = (out << 21) | wide[k : len(wide) - n + 1 + k]
    return out


def gram_vectors(packed: np.ndarray, profile: Profile) -> np.ndarray:
    """One row a gram: the product of its letters' vectors, each rotated by its place."""
    n = profile.gram
    if not len(packed):
        return np.zeros((0, profile.dims), np.int8)
    rows = np.ones((len(packed), profile.dims), np.int8)
    for k in range(n):
        codes, at = np.unique((packed >> (21 * (n - 1 - k))) & 0x1FFFFF, return_inverse=True)
        rows *= np.stack([np.roll(letter_vector(int(c), profile), n - 1 - k) for c in codes])[at]
    return rows


def _counted(texts, profile: Profile):
    """Blocks of texts as (first, number, distinct grams, text of each count, gram of each count, counts)."""
    at, block, size = 0, [], 0
    for k, text in enumerate(texts):
        block.append(grams(letters(text), profile.gram))
        size += len(block[-1])
        if size >= profile.block or len(block) >= profile.texts or k == len(texts) - 1:
            flat = np.concatenate(block)
            distinct, place = np.unique(flat, return_inverse=True)
            owner = np.repeat(np.arange(len(block)), [len(b) for b in block])
            pairs, counts = np.unique(owner * max(len(distinct), 1) + place, return_counts=True)
            yield at, len(block), distinct, pairs // max(len(distinct), 1), pairs % max(len(distinct), 1), counts
            at, block, size = k + 1, [], 0


def bundle(n: int, distinct: np.ndarray, owner: np.ndarray, place: np.ndarray, counts: np.ndarray, profile: Profile) -> np.ndarray:
    """The sum of its n-grams' vectors for each of n texts, in parts of bounded size: by a dense product, or by pairs where texts are short and share little."""
    out = np.zeros((n, profile.dims), np.float32)
    for k in range(0, len(distinct), profile.part):
        vectors = gram_vectors(distinct[k : k + profile.part], profile).astype(np.float32)
        inside = np.nonzero((place >= k) & (place < k + profile.part))[0]
        if n * len(vectors) < 15 * len(inside):
            dense = np.zeros((n, len(vectors)), np.float32)
            dense[owner[inside], place[inside] - k] = counts[inside]
            out += dense @ vectors
            continue
        for at in range(0, len(inside), profile.part):  # pairs are in the order of texts
            some = inside[at : at + profile.part]
            first = np.nonzero(np.diff(owner[some], prepend=-1))[0]
            out[owner[some][first]] += np.add.reduceat(vectors[place[some] - k] * counts[some, None].astype(np.float32), first, axis=0)
    return out


def learn(docs: DataFrame, profile: Profile = Profile()) -> dict[str, np.ndarray]:
    """Unit prototype vectors by language from all rows of ``docs(text, lang)`` with both; texts weigh by their n-grams.

    What comes to the driver is one vector a language, summed by Spark from
    one vector a language and task.
    """

    def run(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, n, distinct, owner, place, counts in _counted(batch.column(0).to_pylist(), profile):
                here = np.array(langs[at : at + n])
                weights = {lang: np.bincount(place[inside], counts[inside], len(distinct)).astype(np.float32) for lang in set(langs[at : at + n]) for inside in [(here == lang)[owner]]}
                for k in range(0, len(distinct), profile.part):
                    vectors = gram_vectors(distinct[k : k + profile.part], profile).astype(np.float32)
                    for lang, w in weights.items():
                        total[lang] = total.get(lang, 0) + (w[k : k + profile.part] @ vectors).astype(np.int64)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x].tolist() for x in names], pa.list_(pa.int64()))], ["lang", "v"])

    known = docs.where("lang is not null and text is not null").select("text", "lang")
    sums = map_batches(known, run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect():
        v = np.array([x["x"] for x in r["v"]], np.float64)
        if (norm := np.linalg.norm(v)) > 0:
            out[r["lang"]] = (v / norm).astype(np.float32)
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], profile: Profile = Profile(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score for every row of ``docs``: the prototype of the highest cosine (the first by name at a tie) and that cosine, at least 0.

    ``und`` with score 0 for null, for a text without a letter, or if no language was learned.
    """
    names = list(prototypes)
    fields = [docs.schema[c] for c in keep]
    matrix = np.stack([prototypes[n] for n in names], 1) if names else np.zeros((profile.dims, 0), np.float32)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            labels, scores = [], []
            for _, n, distinct, owner, place, counts in _counted(batch.column(len(fields)).to_pylist(), profile):
                bundled = bundle(n, distinct, owner, place, counts, profile)
                seen = np.bincount(owner, minlength=n) > 0
                cosines = (bundled @ matrix) / np.maximum(np.linalg.norm(bundled, axis=1, keepdims=True), 1e-9)
                for k, some in enumerate(seen):
                    best = int(np.argmax(cosines[k])) if names and some else -1
                    labels.append(names[best] if best >= 0 else "und")
                    scores.append(float(min(max(cosines[k, best], 0.0), 1.0)) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double"])
    return map_batches(docs.select(*keep, F.col("text").alias("text__")), run, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    out = predict(docs, learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLE: dict[str, str] = {}
