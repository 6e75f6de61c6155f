"""Rows unlike the others by several features at once: an isolation forest over a bounded sample, scored for all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trees, rows a tree, rows from which the signal is taken, signal that counts, points a whole signal.
TREES, SUBSAMPLE, LEAST_ROWS, LEAST_SIGNAL, POINTS = 160, 256, 30, 0.92, 12.0


def features(rows: DataFrame) -> list[Column]:
    """Price and quantity deviation within ten, 1 - match score, unlike units, and the logarithm of the price."""
    within = lambda c: F.least(F.lit(10.0), F.greatest(F.lit(-10.0), F.coalesce(F.col(c), F.lit(0.0))))
    unlike = F.coalesce((F.col("reference_unit") != "") & (F.col("candidate_unit") != "") & (F.col("reference_unit") != F.col("candidate_unit")), F.lit(False))
    return [within("price_delta_pct"), within("quantity_delta_pct"), 1 - F.col("score"), unlike.cast("double"), F.log1p(F.greatest(F.col("unit_price_total"), F.lit(0.0)))]


def _mean_path(n):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_forest(sample: np.ndarray, seed: int = 42, trees: int = TREES, size: int = SUBSAMPLE) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays (feature, cut, left, right, depth at a leaf); a node without a feature is a leaf."""
    draw, size, forest = np.random.default_rng(seed), min(size, len(sample)), []
    limit = int(np.ceil(np.log2(max(size, 2))))
    for _ in range(trees):
        nodes: list[list] = []
        waiting = [(sample[draw.choice(len(sample), size, replace=False)], 0, None)]
        while waiting:
            part, depth, parent = waiting.pop()
            at = len(nodes)
            if parent is not None:
                nodes[parent[0]][parent[1]] = at
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.nonzero(high > low)[0]
            if depth >= limit or len(part) <= 1 or not len(open_):
                nodes.append([-1, 0.0, 0, 0, depth + float(_mean_path(len(part)))])
                continue
            f = int(draw.choice(open_))
            cut = float(draw.uniform(low[f], high[f]))
            nodes.append([f, cut, 0, 0, 0.0])
            waiting += [(part[part[:, f] <= cut], depth + 1, (at, 2)), (part[part[:, f] > cut], depth + 1, (at, 3))]
        forest.append(tuple(np.array([n[k] for n in nodes]) for k in range(5)))
    return forest


def depths(forest, rows: np.ndarray) -> np.ndarray:
    """Mean depth of every row over the trees."""
    total = np.zeros(len(rows))
    for feature, cut, left, right, depth in forest:
        at = np.zeros(len(rows), int)
        while (inner := feature[at].astype(int) >= 0).any():
            f = np.maximum(feature[at].astype(int), 0)
            step = np.where(rows[np.arange(len(rows)), f] <= cut[at], left[at], right[at]).astype(int)
            at = np.where(inner, step, at)
        total += depth[at]
    return total / len(forest)


def forest_signal(rows: DataFrame, key: str, sample: int = 20_000, seed: int = 42) -> DataFrame:
    """(key, signal) of the details of ``rows`` with a price: how far a row's score lies from the 95th towards the 5th percentile, from 0 to 1.

    The forest is grown from at most ``sample`` rows, those of the lowest hash
    of the key, and scores every row. Fewer than LEAST_ROWS rows have no signal.
    """
    usable = rows.where("row_type = 'detail' and unit_price_total is not null").select(key, F.array(*features(rows)).alias("x"))
    drawn = usable.orderBy(F.xxhash64(key), key).limit(sample).select("x").collect()
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, score double"
    if len(drawn) < LEAST_ROWS:
        return usable.select(key, F.lit(0.0).alias("signal")).limit(0)
    data = np.array([r["x"] for r in drawn])
    shared, norm = rows.sparkSession.sparkContext.broadcast(grow_forest(data, seed)), float(_mean_path(min(SUBSAMPLE, len(data))))

    def run(frames):
        for frame in frames:
            if len(frame):
                yield frame[[key]].assign(score=-(2.0 ** (-depths(shared.value, np.stack(frame["x"].to_numpy())) / norm)))

    scored = usable.mapInPandas(run, schema)
    ends = scored.agg(F.percentile("score", F.lit(0.05)).alias("low"), F.percentile("score", F.lit(0.95)).alias("high"))
    signal = (F.col("high") - F.col("score")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))
    return scored.crossJoin(F.broadcast(ends)).select(key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), signal)).alias("signal"))
