"""Clusters of rows of several bidders in which no bidder appears twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .match import keep_checkpoints


def constrained_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster) for every row of ``nodes(id, bidder)``; cluster is its smallest id.

    Edges ``(a, b, score)`` are taken from the best score down, the smaller
    ends first at a tie, and join two clusters unless they share a bidder.
    Each round joins every edge that is the first open one of both its
    clusters, which gives the same clusters as one edge after the other: no
    edge before it touches either. An edge whose clusters share a bidder
    stays closed, so the open edges shrink each round. A cluster's bidders
    are its only collected group and no more than there are bidders. A long
    chain of ever better scores takes a round a link.

    Edges with a null end or score, loops and ends that are no node join
    nothing; a null bidder conflicts with none. ids are whole numbers, once each.
    """
    keep_checkpoints(nodes.sparkSession)
    state = nodes.select("id", "bidder", F.col("id").alias("cluster")).checkpoint()
    known = edges.where("score is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    live = known.groupBy("a", "b").agg(F.max("score").alias("score")).withColumns({"ca": F.col("a"), "cb": F.col("b")})
    while True:
        held = state.groupBy("cluster").agg(F.collect_set("bidder").alias("set"))
        side = lambda c: held.select(F.col("cluster").alias(c), F.col("set").alias(f"s{c}"))
        live = live.join(side("ca"), "ca").join(side("cb"), "cb").where(~F.arrays_overlap("sca", "scb")).select("a", "b", "score", "ca", "cb").checkpoint()
        if live.isEmpty():
            return state.select("id", "cluster")
        edge = F.struct("score", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), "ca", "cb")
        first = live.select(edge.alias("e"), F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.max("e").alias("e"))
        joined = first.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        joined = joined.select(F.greatest("e.ca", "e.cb").alias("from"), F.least("e.ca", "e.cb").alias("to")).checkpoint()
        moved = lambda df, c: df.join(joined.withColumnRenamed("from", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        state = moved(state, "cluster").select("id", "bidder", "cluster").checkpoint()
        live = moved(moved(live, "ca"), "cb").where("ca <> cb")


#: The most edges of a group that one task takes in its memory.
LARGE = 300_000


def _in_order(nodes: dict, edges: list) -> dict:
    """The cluster of every node (id: bidder) by taking one edge (a, b, score) after the other."""
    best: dict = {}
    for a, b, score in edges:
        if a in nodes and b in nodes:
            rank = (score != score, score)
            best[a, b] = max(best.get((a, b), rank), rank, key=lambda r: (r[0], 0 if r[0] else r[1]))
    up, bidders = {i: i for i in nodes}, {i: set() if b is None else {b} for i, b in nodes.items()}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in sorted(best, key=lambda e: (not best[e][0], 0 if best[e][0] else -best[e][1], *e)):
        low, high = sorted((top(a), top(b)))
        if low != high and bidders[low].isdisjoint(bidders[high]):
            up[high] = low
            few, more = sorted((bidders[low], bidders.pop(high)), key=len)
            more |= few
            bidders[low] = more
    return {i: top(i) for i in nodes}


def clusters_within(nodes: DataFrame, edges: DataFrame, *by: str, large: int = LARGE) -> DataFrame:
    """:func:`constrained_clusters` of nodes(id, bidder) and edges(a, b, score) that both have the columns ``by``, whose groups no edge leaves.

    A group is taken in one task, edge after edge, so that a long chain takes
    no rounds; one of more than ``large`` edges is taken by rounds.
    """
    over = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n__")).where(F.col("n__") > large).select(*[F.col(c).alias(f"{c}__") for c in by])
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}__")) for c in by))
    of = lambda df, how: df.join(F.broadcast(over), same, how)
    kinds = {c: dict(df.dtypes)[c] for df, cs in ((nodes, ("id", "bidder")), (edges, ("a", "b", "score"))) for c in cs}
    row = lambda df, own: df.select(*by, *[(F.col(c) if c in own else F.lit(None).cast(kinds[c])).alias(c) for c in kinds])
    known = edges.where("score is not null and a <> b").select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    kind = kinds["id"]

    def solved(group):
        import pyarrow as pa

        held = group.select(["id", "bidder", "a", "b", "score"]).to_pydict()
        rows = list(zip(*held.values()))
        found = _in_order({r[0]: r[1] for r in rows if r[0] is not None}, [r[2:] for r in rows if r[2] is not None])
        at = group.schema.field("id").type
        return pa.table({"id": pa.array(found.keys(), at), "cluster": pa.array(found.values(), at)})

    both = row(nodes, ("id", "bidder")).unionByName(row(known, ("a", "b", "score")))
    out = of(both, "left_anti").groupBy(*by).applyInArrow(solved, f"id {kind}, cluster {kind}")
    if over.isEmpty():
        return out
    return out.unionByName(constrained_clusters(of(nodes, "left_semi"), of(edges, "left_semi")))
