"""Forests of a grid of splits, feature sets and seeds, grown from counts of distinct binned rows.

Trees see features as at most 32 bins of equal shares, so rows with the same bins and
label are alike: the training rows of a forest are a table of counts with at most
2 * 32 ** features entries, however many rows there are.  A bag takes every row a
Poisson(1) number of times, so it takes all rows of an entry Poisson(count) times.
Spark makes the counts, and deals batches of trees to tasks; a test row's score is
that of its entry.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.sources.workspace import written

from . import metrics, ranking

#: Bits of a bin, and trees that a task grows from one read of the counts.
BIN_BITS, BATCH = 5, 50
BINS = 1 << BIN_BITS


def binned(df: DataFrame, models: dict[str, list[str]], target: str, cells: list[str], roles: str = "roles") -> DataFrame:
    """_cell, _model (numbers), code (bins of the model's features) and the rows of both labels in training (a0, a1) and test (t0, t1).

    ``roles`` holds two bits a cell, see ``splits.role_bits``.  Missing features take the
    cell's training median; edges are exact quantiles of its training rows.
    """
    names = list(dict.fromkeys(f for features in models.values() for f in features))
    if max(map(len, models.values())) > 4:
        raise ValueError("four features at most: counts of more would not stay bounded")
    bits = lambda c: F.col("_roles").bitwiseAND(F.lit(3 << (2 * c)))
    dealt = F.array(*[F.when(bits(c) != 0, F.struct(F.lit(c).alias("_cell"), (bits(c) == 2 << (2 * c)).alias("_test"))) for c in range(len(cells))])
    rows = df.where(F.col(target).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in names], F.col(target).cast("int").alias("_y"), F.col(roles).alias("_roles"))
    rows = written(rows.select(*names, "_y", F.inline(F.filter(dealt, lambda x: x.isNotNull()))), "forest-rows")
    middle = ranking.medians(rows.where("NOT _test"), names, ["_cell"]).select("_cell", *[F.coalesce(f, F.lit(0.0)).alias(f"_m_{f}") for f in names])
    rows = ranking.join_on(rows, written(middle, "medians"), ["_cell"])
    rows = rows.select("_cell", "_test", "_y", *[F.coalesce(f, f"_m_{f}").alias(f) for f in names])
    edges = ranking.edges(rows.where("NOT _test").unpivot(["_cell"], names, "_feature", "_value"), "_value", ["_cell", "_feature"], BINS)
    edges = edges.groupBy("_cell").agg(*[F.max(F.when(F.col("_feature") == f, F.col("edges"))).alias(f"_e_{f}") for f in names])
    rows = ranking.join_on(rows, written(edges, "edges"), ["_cell"])
    at = {f: metrics.bin_of(F.col(f), F.col(f"_e_{f}")) for f in names}
    code = lambda features: sum((F.shiftleft(f"_b_{f}", BIN_BITS * i) for i, f in enumerate(features)), F.lit(0))
    both = F.array(*[F.struct(F.lit(m).alias("_model"), code(features).alias("code")) for m, features in enumerate(models.values())])
    rows = rows.select("_cell", "_test", "_y", *[at[f].alias(f"_b_{f}") for f in names]).select("_cell", "_test", "_y", F.inline(both))
    n = lambda test, y: F.count_if((F.col("_test") == F.lit(test)) & (F.col("_y") == y))
    return rows.groupBy("_cell", "_model", "code").agg(n(False, 0).alias("a0"), n(False, 1).alias("a1"), n(True, 0).alias("t0"), n(True, 1).alias("t1"))


def tree(code: np.ndarray, y: np.ndarray, taken: np.ndarray, tests: np.ndarray, features: int, balance: np.ndarray, rng, leaf: int, depth: int) -> np.ndarray:
    """The share of positives (weighted by ``balance``) in the leaf of each of ``tests``, for one tree over entries taken ``taken`` times.

    All nodes of a level are split at once, each at the best bin of sqrt(features) features
    by the Gini impurity, with ``leaf`` taken rows at least on both sides.
    """
    kept = taken > 0
    code, y, taken = code[kept], y[kept], taken[kept].astype(float)
    node, at, open_ = np.zeros(len(code), np.int64), np.zeros(len(tests), np.int64), np.arange(len(tests))
    share, k = np.empty(len(tests)), 1
    for level in range(depth + 1):
        total = np.bincount(node * 2 + y, taken, 2 * k).reshape(k, 2)
        mass = total * balance
        own = mass[:, 1] / np.maximum(mass.sum(1), 1e-300)
        gain, shift, cut = np.zeros(k), np.zeros(k, np.int64), np.zeros(k, np.int64)
        if level < depth:
            drawn = BIN_BITS * rng.random((k, features)).argsort(1)[:, : math.ceil(math.sqrt(features))]
            before = (mass**2).sum(1) / np.maximum(mass.sum(1), 1e-300)
            for j in range(drawn.shape[1]):
                place = (node * BINS + ((code >> drawn[node, j]) & (BINS - 1))) * 2 + y
                left = np.bincount(place, taken, k * BINS * 2).reshape(k, BINS, 2).cumsum(1)[:, :-1]
                right = total[:, None] - left
                solid = (left.sum(2) >= leaf) & (right.sum(2) >= leaf)
                l, r = left * balance, right * balance
                after = (l**2).sum(2) / np.maximum(l.sum(2), 1e-300) + (r**2).sum(2) / np.maximum(r.sum(2), 1e-300)
                better = np.where(solid, after - before[:, None], 0.0)
                best = better.argmax(1)
                more = better[np.arange(k), best]
                here = more > np.maximum(gain, 1e-9 * before)
                gain[here], shift[here], cut[here] = more[here], drawn[here, j], best[here]
        split = gain > 0
        done = ~split[at]
        share[open_[done]] = own[at[done]]
        if not split.any():
            break
        new = 2 * (split.cumsum() - 1)
        open_, at = open_[~done], at[~done]
        at = new[at] + (((tests[open_] >> shift[at]) & (BINS - 1)) > cut[at])
        kept = split[node]
        code, y, taken, node = code[kept], y[kept], taken[kept], node[kept]
        node = new[node] + (((code >> shift[node]) & (BINS - 1)) > cut[node])
        k = 2 * int(split.sum())
    return share


def scores(counts: DataFrame, models: dict[str, list[str]], seeds: list[int], trees: int = 300, leaf: int = 5, depth: int = 12) -> DataFrame:
    """_cell, _model, seed, code, probability: the mean over the trees of each forest, for every code with test rows.

    A group is a batch of trees of one forest with the counts it grows from; bags depend on the
    forest's place in the grid and the tree's number only, not on how Spark deals the rows.
    """
    sizes = [len(f) for f in models.values()]

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        cell, model, seed, first = map(int, key)
        part = part.sort_values("code")
        codes, n = part["code"].to_numpy(np.int64), part[["a0", "a1"]].to_numpy(np.int64)
        tests = codes[part["tested"].to_numpy(bool)]
        count = n.sum(0)
        balance = n.sum() / (2.0 * np.maximum(count, 1))
        code, y, times = np.repeat(codes, 2), np.tile([0, 1], len(codes)), n.ravel()
        kept = times > 0
        code, y, times, total = code[kept], y[kept], times[kept], np.zeros(len(tests))
        for t in range(first, min(first + BATCH, trees)):
            rng = np.random.default_rng([seed, cell, model, t])
            total += tree(code, y, rng.poisson(times), tests, sizes[model], balance, rng, leaf, depth)
        return pd.DataFrame({"_cell": cell, "_model": model, "seed": seed, "code": tests, "total": total})

    keys = ["_cell", "_model", "seed", "_first"]
    batches = range(0, trees, BATCH)
    dealt = counts.select("_cell", "_model", "code", "a0", "a1", (F.col("t0") + F.col("t1") > 0).alias("tested"))
    dealt = dealt.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("_first", F.explode(F.array(*map(F.lit, batches))))
    groups = counts.select("_cell", "_model").distinct().count() * len(seeds) * len(batches)
    grown = dealt.repartition(max(1, groups), *keys).groupBy(*keys).applyInPandas(grow, "_cell int, _model int, seed int, code int, total double")
    # rounded: equal shares stay equal in whatever order batches are added
    return grown.groupBy("_cell", "_model", "seed", "code").agg(F.round(F.sum("total") / trees, 12).alias("probability"))


def areas(df: DataFrame, models: dict[str, list[str]], target: str, cells: list[str], seeds: list[int], roles: str = "roles", trees: int = 300, leaf: int = 5, depth: int = 12) -> DataFrame:
    """cell, model, seed, auroc of the test rows of every class-balanced forest of the grid."""
    counts = written(binned(df, models, target, cells, roles), "forest-counts")
    found = written(scores(counts, models, seeds, trees, leaf, depth), "forest-scores")
    tested = counts.select("_cell", "_model", "code", F.inline(F.array(*[F.struct(F.lit(y).alias("label"), F.col(f"t{y}").alias("times")) for y in (0, 1)]))).where("times > 0")
    a = ranking.areas(found.join(tested, ["_cell", "_model", "code"]), "label", "probability", ["_cell", "_model", "seed"], weight="times")
    name = lambda options, c: F.element_at(F.array(*map(F.lit, options)), F.col(c) + 1)
    return a.select(name(cells, "_cell").alias("cell"), name(list(models), "_model").alias("model"), "seed", "auroc")
