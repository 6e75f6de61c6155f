"""Operator 7: tokens of whole documents attributed to sections by their offsets."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .base import map_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's tokenizer parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "most")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding and the bytes of each of its tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first character, character after the last) of each token; tokens that share a character overlap."""
    coding, sizes = encoder(path)
    ids = np.array(coding.encode_ordinary(text), np.int64)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    ends = np.cumsum(sizes[ids])
    if len(raw) == len(text):
        return ids, ends - sizes[ids], ends
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return ids, character[ends - sizes[ids]] if len(ids) else ends, character[ends - 1] + 1 if len(ids) else ends


def line_sections(text: str) -> np.ndarray:
    """First characters of the lines, each of which keeps its line feed."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    after = np.nonzero(raw == 10)[0] + 1
    return np.concatenate(([0], after[after < len(raw)])) if len(raw) else np.zeros(0, np.int64)


def attribute(starts: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a boundary) of each section.

    ``start``/``end``: the section of the token's first/last character;
    ``most``: the one with most of its characters, the earlier at a tie. A
    crossing token counts once as a token, in one section, and as crossing in
    the same section.
    """
    low = np.searchsorted(starts, first, "right") - 1
    high = np.searchsorted(starts, last - 1, "right") - 1
    where = high.copy() if rule == "end" else low.copy()
    crossing = np.nonzero(low != high)[0]
    if rule == "most":
        stops = np.append(starts[1:], length)
        for t in crossing:
            own = np.arange(low[t], high[t] + 1)
            where[t] = own[np.argmax(np.minimum(stops[own], last[t]) - np.maximum(starts[own], first[t]))]
    return np.bincount(where, minlength=len(starts)), np.bincount(where[crossing], minlength=len(starts))


def count_tokens(docs: DataFrame, rule: str = "most", sections: Callable[[str], np.ndarray] = line_sections, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, first_char, n_chars, n_tokens, n_crossing) for every section of every row of ``docs(doc_id, text)``.

    Each whole text is encoded once; sections are numbered from 0 in its
    order and cover it. The tokens of a text's sections add up to its tokens.
    A null or empty text has one section 0 without characters or tokens.
    Repeated rows are counted alike; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "section", "first_char", "n_chars", "n_tokens", "n_crossing"]
        for batch in batches:
            ids, texts, held, rows = batch.column(0), batch.column(1), [], []
            for k in range(len(ids)):
                text = texts[k].as_py()
                if not text:
                    held.append(np.zeros((1, 5), np.int64))
                else:
                    starts = sections(text)
                    _, first, last = token_spans(text, path)
                    held.append(np.stack([np.arange(len(starts)), starts, np.diff(np.append(starts, len(text))), *attribute(starts, first, last, len(text), rule)], 1))
                rows.append(np.full(len(held[-1]), k))
            if held:
                flat = np.concatenate(held)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(rows))), *(pa.array(np.ascontiguousarray(flat[:, c])) for c in range(5))], names)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, section long, first_char long, n_chars long, n_tokens long, n_crossing long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE: dict[str, str] = {}
