"""Forests grown from counts of distinct binned rows."""

import time

import numpy as np
import pandas as pd
from longspan.operators import forest
from longspan.queries import models
from pyspark.sql import functions as F


def plain(x, y, w, at, balance, leaf, depth):
    """The leaf share of ``at`` in a tree over one feature, by recursion."""
    n = np.array([w[y == 0].sum(), w[y == 1].sum()])
    score = lambda c: ((c * balance) ** 2).sum() / (c * balance).sum()
    best = (1e-9 * score(n), None)
    for cut in range(31) if depth else ():
        low = x <= cut
        a = np.array([w[low & (y == 0)].sum(), w[low & (y == 1)].sum()])
        if a.sum() >= leaf and (n - a).sum() >= leaf and score(a) + score(n - a) - score(n) > best[0]:
            best = (score(a) + score(n - a) - score(n), cut)
    if best[1] is None:
        return n[1] * balance[1] / (n * balance).sum()
    side = x <= best[1] if at <= best[1] else x > best[1]
    return plain(x[side], y[side], w[side], at, balance, leaf, depth - 1)


def test_tree_equals_recursion():
    rng = np.random.default_rng(3)
    x, y = np.repeat(np.arange(32), 2), np.tile([0, 1], 32)
    for depth in (0, 1, 3, 12):
        w, balance = rng.poisson(rng.integers(0, 6, 64)), np.array([0.7, 1.6])
        got = forest.tree(x, y, w, np.arange(32), 1, balance, rng, 5, depth)
        assert np.allclose(got, [plain(x, y, w, at, balance, 5, depth) for at in range(32)])


def frame(spark, n=4000):
    rng = np.random.default_rng(1)
    a, b, c = rng.random(n), rng.random(n), rng.random(n)
    y = (((a > 0.5) ^ (b > 0.5)) ^ (rng.random(n) < 0.1)).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "y": y, "roles": np.where(np.arange(n) % 4 == 0, 2, 1) + 4 * np.where(np.arange(n) % 5 == 0, 0, 1)}))
    return rows.withColumn("c", F.when(F.col("c") < 0.9, F.col("c")))


def test_counts_hold_every_row_once_a_cell_and_model(spark):
    got = forest.binned(frame(spark), {"one": ["a"], "all": ["a", "b", "c"]}, "y", ["0", "1"])
    sums = {(r["_cell"], r["_model"]): (r.a, r.t) for r in got.groupBy("_cell", "_model").agg(F.sum(F.expr("a0 + a1")).alias("a"), F.sum(F.expr("t0 + t1")).alias("t")).collect()}
    assert sums == {(0, 0): (3000, 1000), (0, 1): (3000, 1000), (1, 0): (3200, 0), (1, 1): (3200, 0)}
    assert got.where("_model = 0").count() == 64


def test_areas_find_an_interaction_and_do_not_depend_on_partitions(spark):
    areas = lambda df: {(r.model, r.seed): r.auroc for r in forest.areas(df, {"one": ["a"], "two": ["a", "b"]}, "y", ["0"], [1, 2], trees=60).collect()}
    df = frame(spark).withColumn("roles", F.col("roles").bitwiseAND(F.lit(3)))
    got = areas(df)
    assert all(0.4 < got["one", s] < 0.6 and got["two", s] > 0.85 for s in (1, 2))
    assert got == areas(df.repartition(7))


def test_forest_grid_is_done_in_time(spark, sf_dir):
    start = time.time()
    got = {(r.kind, r.contrast): r for r in models.mdl05_mdl06_spl08_forest_grid(spark, sf_dir).collect()}
    assert {k: r.n_cells for k, r in got.items()} == {(k, c): n for k, n in (("logistic", 3), ("forest", 9)) for c in ("day_plus_prior", "history_plus_prior")}
    assert all(r.least_delta <= r.median_delta <= r.largest_delta for r in got.values())
    assert time.time() - start < 240  # one forest of the grid alone took some 50 s at sf0.01 before
