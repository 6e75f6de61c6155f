"""Operator 3: documents for source quotas by minimum-cost flow over membership patterns."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import materialize, table, word_count

EPOCHS = 2
#: Patterns or sources up to which their rows are sent to all tasks.
FEW = 10_000


def share_targets(sizes: dict, weights: dict, total: float, most: float = EPOCHS) -> dict:
    """Targets by weight that stop at ``most`` times the source's size; the excess is shared again by weight until none is above."""
    out = {s: 0.0 for s in sizes}
    open_, left = [s for s in sizes if weights[s] > 0], float(total)
    while open_ and left > 0:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if unit * weights[s] >= most * sizes[s]]
        if not full:
            for s in open_:
                out[s] = unit * weights[s]
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def route(patterns: dict, quotas: dict, epochs: int = EPOCHS) -> dict:
    """{(pattern, source): tokens} of a maximum flow of least cost from patterns to the quotas of their sources.

    A pattern gives its tokens once for nothing, again at cost 1, a third time
    at cost 2 and so on, so repetition is spread before it deepens. Shortest
    augmenting paths on the residual graph; patterns and sources are few.
    """
    names = ["from", "to", *(("p", p) for p in patterns), *(("s", s) for s in quotas)]
    at = {n: k for k, n in enumerate(names)}
    arcs: list[list] = []
    leaving: list[list[int]] = [[] for _ in names]

    def arc(a, b, room, cost):
        for u, v, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            leaving[at[u]].append(len(arcs))
            arcs.append([at[v], float(r), c])

    carried = {}
    for p, (members, tokens) in patterns.items():
        for k in range(epochs):
            arc("from", ("p", p), tokens, k)
        for s in members:
            if s in quotas:
                carried[p, s] = len(arcs)
                arc(("p", p), ("s", s), tokens * epochs, 0)
    for s, quota in quotas.items():
        arc(("s", s), "to", quota, 0)
    while True:
        cost, by, waiting, inside = [float("inf")] * len(names), [-1] * len(names), deque([0]), {0}
        cost[0] = 0
        while waiting:
            u = waiting.popleft()
            inside.discard(u)
            for e in leaving[u]:
                v, room, c = arcs[e]
                if room > 1e-9 and cost[u] + c < cost[v] - 1e-12:
                    cost[v], by[v] = cost[u] + c, e
                    if v not in inside:
                        inside.add(v)
                        waiting.append(v)
        if by[1] < 0:
            break
        path, v = [], 1
        while v:
            path.append(by[v])
            v = arcs[by[v] ^ 1][0]
        amount = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= amount
            arcs[e ^ 1][1] += amount
    return {key: arcs[e ^ 1][1] for key, e in carried.items()}


def _order(seed: int, doc_id: Column) -> Column:
    """32 bits of a seeded hash that any SQL engine can make."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")


def _cuts(docs: DataFrame, wanted: dict[str, float]) -> dict[str, int]:
    """For each pattern the hash below which its documents come nearest to the wanted tokens.

    The hashes of a pattern are cut into 2^11 ranges whose tokens are summed;
    the range with the boundary is cut again, and once more, to single
    hashes. A level is one pre-aggregated sum, so no group is sorted whole.
    """
    spark = docs.sparkSession
    low, left, bits = {p: 0 for p in wanted}, dict(wanted), (21, 10, 0)
    top = 1 << 32
    width = top
    for shift in bits:
        schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("low", T.LongType())])
        bounds = spark.createDataFrame([(p, x) for p, x in low.items()], schema)
        inside = docs.join(F.broadcast(bounds) if len(low) <= FEW else bounds, "pattern").where((F.col("order") >= F.col("low")) & (F.col("order") < F.col("low") + F.lit(width)))
        sums = inside.groupBy("pattern", F.shiftright(F.col("order") - F.col("low"), shift).alias("part")).agg(F.sum("size").alias("size"))
        by: dict[str, list] = {}
        for r in sums.orderBy("pattern", "part").toLocalIterator():
            by.setdefault(r["pattern"], []).append((r["part"], r["size"]))
        for p, parts in by.items():
            for part, size in parts:
                if size > left[p] or (shift == 0 and size > 0 and left[p] <= 0):
                    if shift == 0 and size - left[p] < left[p]:
                        part += 1
                    low[p] += part << shift
                    break
                left[p] -= size
            else:
                low[p] += (parts[-1][0] + 1) << shift
                left[p] = 0.0
        width = 1 << shift
    return low


def _patterned(docs: DataFrame, seed: int) -> DataFrame:
    pattern = F.coalesce(F.to_json(F.array_sort(F.array_distinct("sources"))), F.lit("[]"))
    return docs.withColumns({"pattern": pattern, "order": _order(seed, F.col("doc_id"))})


def plan_mix(docs: DataFrame, quotas: dict, seed: int = 11, epochs: int = EPOCHS) -> list[tuple[str, int, int]]:
    """(pattern, whole, cut) rows for ``docs(doc_id, size, sources)``: a pattern's documents are taken ``whole`` times, and once more where their hash is below ``cut``.

    Documents are summed by membership pattern (what reaches the driver is one
    row a pattern), the flow gives each pattern its words, and a pattern takes
    all its documents as often as fits whole and the rest in the order of a
    seeded hash, to the document boundary nearest to its words.
    """
    held = _patterned(docs, seed)
    totals = {r["pattern"]: r["size"] for r in held.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    members = {p: (json.loads(p), size) for p, size in totals.items()}
    given = dict.fromkeys(members, 0.0)
    for (p, _), tokens in route(members, quotas, epochs).items():
        given[p] += tokens
    whole, rest = {}, {}
    for p, (_, size) in members.items():
        whole[p] = min(epochs, int((given[p] + 1e-6) // size)) if size else 0
        rest[p] = given[p] - whole[p] * size if size and whole[p] < epochs else 0.0
    cuts = _cuts(held.select("pattern", "order", "size"), {p: x for p, x in rest.items() if x > 0.5})
    return [(p, whole[p], cuts.get(p, 0)) for p in sorted(members)]


def take(docs: DataFrame, plan: list[tuple[str, int, int]], seed: int = 11) -> DataFrame:
    """The rows of ``docs(doc_id, size, sources, ...)`` with ``taken``, the words the mix takes of each."""
    schema = T.StructType([T.StructField("p__", T.StringType()), T.StructField("whole__", T.LongType()), T.StructField("cut__", T.LongType())])
    rows = docs.sparkSession.createDataFrame(plan, schema)
    rows = F.broadcast(rows) if len(plan) <= FEW else rows
    pattern = F.coalesce(F.to_json(F.array_sort(F.array_distinct("sources"))), F.lit("[]"))
    joined = docs.withColumn("p__", pattern).join(rows, "p__")
    taken = F.col("size") * (F.col("whole__") + (_order(seed, F.col("doc_id")) < F.col("cut__")).cast("long"))
    return joined.select(*docs.columns, taken.alias("taken"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, seed: int = 11) -> DataFrame:
    """The rows of ``docs(doc_id, text, source, ...)`` with size, source_size, target and taken.

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times all words; see :func:`share_targets` and :func:`plan_mix`.
    Null and empty texts have size 0 and are taken 0 times. Repeated rows are
    taken alike, and the same seed always takes the same documents. An empty
    table gives an empty result. Columns of ``docs`` named as the four are
    replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    sizes = {r["source"]: r["size"] for r in rows}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    targets = share_targets({s: sizes[s] for s in order}, {s: weights[k % len(weights)] for k, s in enumerate(order)}, share * sum(sizes.values()))
    plan = plan_mix(sized.withColumn("sources", F.array("source")), targets, seed)
    full = docs.select(F.struct(*docs.columns).alias("row__"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.array("source").alias("sources"))
    taken = take(full, plan, seed)
    schema = T.StructType([T.StructField("s__", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    known = docs.sparkSession.createDataFrame([(s, sizes[s], targets[s]) for s in order], schema)
    known = F.broadcast(known) if len(order) <= FEW else known
    out = taken.join(known, F.col("source").eqNullSafe(F.col("s__")))
    return out.select(*[F.col("row__").getField(c).alias(c) for c in docs.columns], "size", "source_size", "target", "taken")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text", "source")


QUERIES = {"op3_mixing": op3_mixing}
ORACLE: dict[str, str] = {}
