"""Two-level ranks, exact quantiles, and draws by matrix products and by arithmetic partners, against brute force."""

import numpy as np
import pandas as pd
import pytest
from longspan.functions.hashing import PRIME, draw_hash, partners, round_tables, scrambled
from longspan.operators import draws, ranking
from longspan.sources.workspace import written
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(3)
    n = 3000
    df = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], n, p=[0.7, 0.2, 0.05, 0.05]), "id": np.arange(n), "v": np.round(rng.normal(0, 3, n), 1), "y": rng.integers(0, 2, n)})
    df.loc[rng.choice(n, 60, replace=False), "v"] = np.nan
    df.loc[df.index[:900], "v"] = 1.5  # a hot value
    return df


@pytest.fixture(scope="module")
def rows(spark, panel):
    return spark.createDataFrame(panel.astype(object).where(panel.notna(), None), "g string, id long, v double, y int").cache()


def groups(df):
    return {None if isinstance(k, float) else k: x for k, x in df.groupby("g", dropna=False)}


def test_numbered_and_running_sums(rows, panel):
    got = ranking.numbered(rows, ["g"], ["v", "id"]).toPandas()
    more = ranking.running(rows, ["g"], ["v", "id"], {"s": F.col("y").cast("long")}).toPandas().set_index("id")["s"]
    for k, x in groups(got).items():
        x = x.sort_values("i")
        want = groups(panel)[k].sort_values(["v", "id"], na_position="first")
        assert x["i"].tolist() == list(range(len(want))) and set(x["n"]) == {len(want)} and x["id"].tolist() == want["id"].tolist()
        assert more[want["id"]].tolist() == (want["y"].cumsum() - want["y"]).tolist()


@pytest.mark.parametrize("limit", [0, 10**6])
def test_ranks_and_areas(rows, panel, limit):
    ranked = ranking.average_ranks(rows, {"r": F.col("v")}, ["g"], limit).toPandas().set_index("id")["r"]
    want = panel.groupby("g", dropna=False)["v"].rank()
    assert np.allclose(ranked[panel["id"]].astype(float), want, equal_nan=True)
    got = {r["g"]: r for r in ranking.areas(rows.where("v IS NOT NULL"), "y", "v", ["g"], limit).collect()}
    for k, x in groups(panel.dropna(subset=["v"])).items():
        pos, neg = x["v"][x["y"] == 1].to_numpy(), x["v"][x["y"] == 0].to_numpy()
        d = pos[:, None] - neg[None]
        assert abs(got[k]["auroc"] - ((d > 0) + (d == 0) / 2).mean()) < 1e-12 and got[k]["n_positive"] == len(pos)


def test_no_window_holds_a_group(rows):
    """Windows over rows are keyed by range too; the others are over one row a range."""
    df = ranking.running(rows, ["g"], ["v"], {"s": F.lit(1)})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert windows and all("_part" in line for line in windows)


def test_adjusted_p(rows, panel):
    p = rows.withColumn("p", F.round(F.abs(F.sin("id")), 2)).withColumn("p", F.when(F.col("v").isNotNull(), F.col("p")))
    got = ranking.adjusted_p(p, "p", ["g"]).toPandas()
    for x in groups(got).values():
        known = x.dropna(subset=["p"]).sort_values("p")
        raw = known["p"].to_numpy() * len(known) / np.arange(1, len(known) + 1)
        assert np.allclose(known["q"], np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)) and x["q"].isna().sum() == x["p"].isna().sum()


def test_quantiles_by_refinement(spark, rows, panel):
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["share"]): r["quantile"] for r in ranking.quantiles(rows, "v", ["g"], shares).collect()}
    upper = {(r["g"], r["share"]): r["quantile"] for r in ranking.quantiles(rows, "v", ["g"], shares, interpolate=False).collect()}
    for k, x in groups(panel).items():
        v = x["v"].dropna()
        for s in shares:
            assert abs(got[k, s] - np.quantile(v, s)) < 1e-12 and upper[k, s] == np.quantile(v, s, method="higher")
    odd = spark.createDataFrame([(-0.0,), (0.0,), (-1e300,), (5e-324,), (float("inf"),), (float("nan"),), (None,)], "v double")
    assert ranking.quantiles(odd, "v", [], [0.5]).collect()[0]["quantile"] == 0.0
    assert ranking.quantiles(odd.limit(0), "v", [], [0.5]).count() == 0


@pytest.mark.parametrize("limit", [0, 10**6])
def test_weighted_shares(rows, panel, limit):
    """Counts of distinct values have the quantiles of the rows that they count."""
    counts = rows.where("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("times"))
    got = {r["g"]: r["q"] for r in ranking.shares_of(counts, "v", ["g"], [0.1, 0.5, 0.8], limit=limit, weight="times").collect()}
    for k, x in groups(panel).items():
        assert np.allclose(got[k], np.quantile(x["v"].dropna(), [0.1, 0.5, 0.8]))


def test_bootstrap_sums_are_weighted_sums(rows, panel, monkeypatch):
    monkeypatch.setattr(draws, "BLOCK", 128)
    monkeypatch.setattr(draws, "BATCH", 16)
    known = panel.dropna(subset=["v"])
    got = {(r["g"], r["draw"]): r for r in draws.bootstrap_sums(rows.dropna(subset=["v"]), {"one": F.lit(1), "v": F.col("v")}, 40, ["g"], ["id"]).collect()}
    for k, x in groups(known).items():
        w = draws.slot_counts(len(x), np.arange(40))
        assert (w.sum(1) == len(x)).all()
        for d in range(40):
            assert got[k, d]["one"] == len(x) and abs(got[k, d]["v"] - w[d] @ x.sort_values("id")["v"].to_numpy()) < 1e-8


def test_slot_counts_are_draws_with_replacement():
    w = draws.slot_counts(50, np.arange(4000))
    share = [(w == k).mean() for k in range(4)]
    want = [0.364, 0.372, 0.186, 0.061]  # binomial of 50 slots and 1/50
    assert all(abs(a - b) < 0.01 for a, b in zip(share, want))
    assert abs(np.corrcoef(w[:, 3], w[:, 7])[0, 1]) < 0.06


@pytest.mark.parametrize("cells", [64, 1 << 21])
def test_part_sums_over_stretches(monkeypatch, cells):
    """Scores longer than a stretch of cells tie with themselves only, whatever the stretches."""
    monkeypatch.setattr(draws, "CELLS", cells)
    rng = np.random.default_rng(8)
    place, cluster = np.repeat([0, 1, 2], [5, 30, 9]), rng.integers(0, 12, 44)
    p, n, w = rng.integers(0, 3, 44).astype(float), rng.integers(0, 3, 44).astype(float), rng.integers(0, 4, (12, 6)).astype(float)
    got = draws.part_sums(cluster, place, p, n, w)
    twice = 2 * (place[:, None] > place[None]) + (place[:, None] == place[None])
    for d in range(6):
        a, b = w[cluster, d] * p, w[cluster, d] * n
        assert got[d].tolist() == [a @ twice @ b, a.sum(), b.sum()]


def test_cluster_areas_keep_nothing_of_the_square_of_clusters(spark, monkeypatch):
    """Tables that are written have a row for each cell at most, so their bytes do not grow with pairs of clusters."""
    kept = []
    monkeypatch.setattr(draws, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    df = spark.range(6000).select((F.col("id") % 3000).alias("c"), (F.col("id") % 2).cast("int").alias("y"), F.sin("id").alias("a"))
    assert draws.cluster_areas(df, ["c"], "y", {"a": "a"}, 8).count() == 8
    size = lambda t: F.sum(sum((F.length(f.name) for f in t.schema.fields if f.dataType.typeName() == "binary"), F.lit(0)))
    assert max(t.count() for t in kept) <= 6000 and sum(t.agg(size(t)).first()[0] for t in kept) <= 16 * 6000


@pytest.mark.parametrize("block", [16, 1024])
def test_cluster_areas_equal_drawn_rows(spark, monkeypatch, block):
    monkeypatch.setattr(draws, "BLOCK", block)
    monkeypatch.setattr(draws, "BATCH", 7)
    rng = np.random.default_rng(5)
    sizes = [1, 400] + rng.integers(1, 12, 38).tolist()  # one cluster has half of all rows
    x = pd.DataFrame([(c, int(rng.integers(0, 2)), round(float(rng.normal()), 1), round(float(rng.normal()), 2)) for c, n in enumerate(sizes) for _ in range(n)], columns=["c", "y", "a", "b"])
    df = spark.createDataFrame(x)
    got = {(r["draw"], r["kind"]): r["auroc"] for r in draws.cluster_areas(df, ["c"], "y", {"a": "a", "b": "b"}, 20).collect()}
    assert len(got) == 40
    order = {r["c"]: r["i"] for r in ranking.numbered(df.select("c").distinct(), [], ["c"]).collect()}
    w = draws.slot_counts(len(sizes), np.arange(20))
    for d in range(20):
        times = x["c"].map(lambda c: w[d, order[c]])  # noqa: B023
        drawn = x.loc[x.index.repeat(times)]
        for kind in "ab":
            pos, neg = drawn[kind][drawn["y"] == 1].to_numpy(), drawn[kind][drawn["y"] == 0].to_numpy()
            away = pos[:, None] - neg[None]
            assert abs(got[d, kind] - ((away > 0) + (away == 0) / 2).mean()) < 1e-9


def test_partners_are_permutations_of_all_kinds():
    for n in (1, 2, 5, 33, 100):
        p = partners(np.arange(n), n, np.arange(2000), 99)
        assert (np.sort(p, 1) == np.arange(n)).all()
        seen = np.array([np.bincount(p[:, i], minlength=n) for i in range(n)])
        if n > 1:
            assert ((seen - 2000 / n) ** 2 / (2000 / n)).sum() / (n - 1) ** 2 < 2.5
    assert len({tuple(r) for r in partners(np.arange(5), 5, np.arange(2000), 7).tolist()}) == 120


@pytest.mark.parametrize("block", [32, 65536])
def test_permutation_sums(spark, block):
    rng = np.random.default_rng(8)
    x = pd.DataFrame({"s": rng.choice(["p", "q", "r"], 200, p=[0.8, 0.15, 0.05]), "id": rng.permutation(200), "a": rng.normal(size=200), "b": rng.normal(size=200), "c": rng.normal(size=200)})
    x.loc[3:40:5, "b"] = np.nan
    df = spark.createDataFrame(x.astype(object).where(x.notna(), None), "s string, id long, a double, b double, c double")
    got = {r["draw"]: r for r in draws.permutation_sums(df, "s", ["id"], F.array("a", "b"), F.array("c", "b"), 30, draws.cross_products, ["ac", "ab", "bc", "bb"], block).collect()}
    cosines = {r["draw"]: r for r in draws.permutation_sums(df, "s", ["id"], F.array("a", "b", "c"), F.array("c", "b", "a"), 30, draws.masked_cosines(2), ["sum", "n"], block).collect()}
    seeds = {r["s"]: r["k"] for r in df.select("s", F.pmod(draw_hash(F.col("s")), F.lit(PRIME)).alias("k")).distinct().collect()}
    for d in range(30):
        want, total, count = np.zeros(4), 0.0, 0
        for s, part in x.groupby("s"):
            part = part.sort_values("id")
            j = partners(np.arange(len(part)), len(part), np.array([d]), seeds[s])[0]
            mine, other = part[["a", "b", "c"]].to_numpy(), part[["a", "b", "c"]].to_numpy()[j]
            want += np.array([np.nansum(mine[:, 0] * other[:, 2]), np.nansum(mine[:, 0] * other[:, 1]), np.nansum(mine[:, 1] * other[:, 2]), np.nansum(mine[:, 1] * other[:, 1])])
            for u, v in zip(mine, other[:, ::-1]):
                k = ~np.isnan(u) & ~np.isnan(v)
                if k.sum() >= 2:
                    total, count = total + u[k] @ v[k] / np.sqrt((u[k] @ u[k]) * (v[k] @ v[k])), count + 1
        assert abs(got[d]["ac"] - want[0]) < 1e-9 and abs(got[d]["ab"] - want[1]) < 1e-9
        assert abs(cosines[d]["sum"] - total) < 1e-9 and cosines[d]["n"] == count


def test_partners_by_tables_are_those_of_the_rounds():
    """Every place of an uneven size, sent on round by round."""
    n, seed = 1000, 12345
    tables = round_tables(n, np.arange(3), seed)
    assert max(t.shape[1] for t in tables) == 32
    got = partners(np.arange(n), n, np.arange(3), seed, tables)
    for d in range(3):
        x, todo = np.arange(n), np.arange(n)
        while len(todo):
            half = [x[todo] >> 5, x[todo] & 31]
            for r in range(6):
                half[r % 2] = half[r % 2] ^ (scrambled(half[1 - r % 2], scrambled(np.int64(d * 6 + r + 1), seed)) & 31)
            x[todo] = (half[0] << 5) | half[1]
            todo = np.flatnonzero(x >= n)
        assert (got[d] == x).all()


def test_draws_are_dealt_to_more_tasks_than_one(spark):
    sizes = spark.createDataFrame([(600_000,)], "n long")
    used = draws.weights(sizes, [], 24).withColumn("task", F.spark_partition_id()).select("draw", "task").distinct().collect()
    assert len({r.draw for r in used}) == 8 and len({r.task for r in used}) > 1  # before, all batches were one task's
