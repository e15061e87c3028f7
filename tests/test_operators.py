"""Hand-made fixtures for the rules that are easy to get wrong."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from longspan.functions import numeric
from longspan.operators import cluster, linear, metrics, ranking, resample, splits
from longspan.operators.sequence import lz_rate, novel_lengths
from longspan.operators.windows import Trajectory, benjamini_hochberg, tomorrow
from longspan.sources import validate
from pyspark.sql import Window
from pyspark.sql import functions as F

T = Trajectory()
DAY = dt.date(2024, 1, 1)


def series(spark, values, days=None, unit=1):
    days = days or range(len(values))
    return spark.createDataFrame([(0, unit, DAY + dt.timedelta(days=int(i)), v) for i, v in zip(days, values)], "cohort int, unit int, date date, x double")


def column(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def test_trailing_mean_needs_seven_values(spark):
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0]).withColumn("m", T.trailing_mean(F.col("x"), 7))
    assert column(df, "m") == [None] * 8
    df = series(spark, [float(i) for i in range(9)]).withColumn("m", T.trailing_mean(F.col("x"), 7))
    assert column(df, "m") == [None] * 7 + [3.0, 4.0]


def test_leading_mean_needs_six_following_rows(spark):
    df = series(spark, [float(i) for i in range(1, 9)]).withColumn("m", T.leading_mean(F.col("x")))
    assert column(df, "m") == [5.0, 5.5] + [None] * 6


def test_tomorrow_is_a_calendar_day(spark):
    df = tomorrow(series(spark, [1.0, 2.0, 3.0], [0, 2, 3]), "x", ["cohort", "unit"])
    assert [(r["x"], r["target_value"]) for r in df.collect()] == [(2.0, 3.0)]


def test_last_known_and_days(spark):
    df = series(spark, [1.0, None, None, 4.0], [0, 1, 5, 6]).withColumn("v", T.last_known(F.col("x"))).withColumn("d", T.days_since_known(F.col("x")))
    assert column(df, "v") == [None, 1.0, 1.0, 1.0] and column(df, "d") == [None, 1, 5, 6]


def test_constant_groups(spark):
    df = series(spark, [2.0, 2.0, 2.0]).withColumn("z", numeric.zscore(F.col("x"), T.all)).withColumn("n", numeric.zscore(F.col("x"), T.all, None)).withColumn("y", F.lit(1.0))
    assert column(df, "z") == [0.0] * 3 and column(df, "n") == [None] * 3
    assert metrics.pearson(df, "x", "y", ["cohort"], 2).first()["r"] is None


def test_half_even_split(spark):
    df = splits.within_unit(series(spark, [1.0] * 30), T, 0.35)
    assert df.where("role = 'test'").count() == 10
    assert splits.within_unit(series(spark, [1.0] * 3), T, 0.35).count() == 0


def test_regimes_cover_and_do_not_leak(spark):
    df = splits.with_regimes(series(spark, [float(i) for i in range(23)]), T)
    got = {}
    for r in df.collect():
        got.setdefault((r["regime"], r["half"], r["role"]), []).append(r["position"])
    for regime in ("fixed", "expanding", "disjoint"):
        for half in ("early", "late"):
            assert max(got[regime, half, "train"]) < min(got[regime, half, "test"])
    assert sorted(got["fixed", "early", "test"] + got["fixed", "late", "test"]) == list(range(14, 23))
    assert sorted(got["expanding", "late", "train"]) == list(range(19))
    assert not set(got["disjoint", "early", "test"]) & set(got["disjoint", "late", "train"])


def test_auroc_with_ties_and_symmetry(spark):
    df = spark.createDataFrame(list(zip([1, 0, 1, 0, 0], [0.3, 0.3, 0.9, 0.1, 0.5])), "y int, s double").withColumn("g", F.lit(1))
    a = metrics.auroc(df, "y", "s", ["g"]).first()["auroc"]
    b = metrics.auroc(df.withColumn("s", 1 - F.col("s")), "y", "s", ["g"]).first()["auroc"]
    assert a == 0.75 and math.isclose(a + b, 1)
    assert metrics.auroc(df.where("y = 1"), "y", "s", ["g"]).first()["auroc"] is None


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    e = ranking.edges(df, "x", [], 2).withColumnRenamed("edges", "e")
    b = df.join(e, F.lit(True)).withColumn("b", metrics.bin_of(F.lit(5.5), F.col("e"))).first()["b"]
    assert b == 0
    two = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, g int")
    assert metrics.binned_entropy(two.where("x = 1"), "x", ["g"], ["g"]).first()["entropy"] == 0.0


def test_average_rank(spark):
    df = series(spark, [3.0, None, 1.0, 3.0]).withColumn("r", numeric.average_rank(F.col("x"), ["cohort"]))
    assert column(df, "r") == [2.5, None, 1.0, 2.5]


def test_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(0)
    data = [(int(i % 3), float(a), float(b), float(a + 2 * b + c)) for i, (a, b, c) in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(data, "cohort int, u double, v double, y double").withColumn("g", F.lit(1))
    out = linear.residual(df, "y", ["u", "v"], ["g"], "cohort", "r").toPandas()
    x = np.column_stack([out["u"], out["v"], *[(out["cohort"] == c).astype(float) for c in range(3)]])
    want = out["y"] - x @ (np.linalg.pinv(x) @ out["y"])
    assert np.allclose(out["r"], want, atol=1e-9) and np.allclose(x.T @ out["r"], 0, atol=1e-8)


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=50)
    df = spark.createDataFrame([(1, "train" if i < 40 else "test", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "g int, role string, a double, b double, c double, y double")
    got = linear.ridge(df, ["a", "b", "c"], "y", ["g"]).select("y", "prediction").toPandas().sort_values("y")["prediction"]
    t = x[:40]
    z, m, s = (x - t.mean(0)) / t.std(0), y[:40].mean(), (t - t.mean(0)) / t.std(0)
    beta = np.linalg.solve(s.T @ s + np.eye(3), s.T @ (y[:40] - m))
    assert np.allclose(got, (m + z @ beta)[np.argsort(y)], atol=1e-9)


def test_logistic_separates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    df = spark.createDataFrame([("train", float(v), int(v + rng.normal() * 0.5 > 0)) for v in x], "role string, x double, label int").withColumn("g", F.lit(1))
    assert metrics.auroc(linear.logistic(df, ["x"], "label"), "label", "probability", ["g"]).first()["auroc"] > 0.9


def test_step_up(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(p)], "g int, i int, p double")
    q = [r["q"] for r in benjamini_hochberg(df, "p", ["g"]).orderBy("i").collect()]
    assert q[3] is None and np.allclose([q[0], q[1], q[2], q[4]], [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_permutation_p_is_bounded(spark):
    null = spark.createDataFrame([(float(i),) for i in range(9)], "s double")
    assert resample.permutation_p(null, "s", F.lit(100.0)).first()["p"] == 0.1
    assert resample.permutation_p(null, "s", F.lit(-1.0)).first()["p"] == 1.0


def naive_novel(s):
    out = []
    for i in range(len(s)):
        k = 1
        while k <= len(s) - i and any(s[j : j + k] == s[i : i + k] for j in range(i)):
            k += 1
        out.append(min(k, len(s) - i + 1))
    return out


def test_novel_lengths():
    rng = np.random.default_rng(3)
    for n in (1, 5, 30, 60):
        s = rng.integers(0, 3, n)
        assert novel_lengths(s).tolist() == naive_novel(s.tolist())
    assert lz_rate([0] * 19) is None and 0 < lz_rate([0] * 30) < 1 and lz_rate(None) is None


def test_fisher_and_probit(spark):
    r = spark.createDataFrame([(0.5, 30), (None, 30), (0.1, 3)], "r double, n int").select(numeric.fisher_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert math.isclose(r[0]["p"], math.erfc(math.atanh(0.5) * math.sqrt(27) / math.sqrt(2)), rel_tol=1e-9) and r[1]["p"] is None and r[2]["p"] is None


def test_parse_feature(spark):
    r = spark.createDataFrame([("f_steps:avg_norm:allday",), ("f_steps:avg:x:y",), ("odd",)], "n string").select(numeric.parse_feature(F.col("n")).alias("p")).collect()
    assert tuple(r[0]["p"]) == ("f_steps", "avg", "norm", "allday") and r[1]["p"]["segment"] == "x:y" and r[2]["p"]["feature"] is None


def test_nan_becomes_null(spark):
    df = numeric.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert df.where("x IS NULL").count() == 1


def test_one_to_one_contract(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(validate.ContractError):
        validate.join_one_to_one(a, a.distinct(), ["k"])
    with pytest.raises(validate.ContractError):
        validate.require_bounds(spark.createDataFrame([("x",)], "v string"), {"v": (0, 1)})
    assert validate.require_bounds(spark.createDataFrame([("0.5",), (None,)], "v string"), {"v": (0, 1)}).dtypes == [("v", "double")]
    with pytest.raises(validate.ContractError):
        validate.close(1.0, 1.1)


def test_masked_cosine(spark):
    df = spark.createDataFrame([([1.0, None, 2.0, 3.0, 4.0], [1.0, 5.0, 2.0, 3.0, 4.0]), ([1.0, None, None, None, 4.0], [1.0] * 5)], "a array<double>, b array<double>")
    got = [r["c"] for r in df.select(cluster.masked_cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert math.isclose(got[0], 1.0) and got[1] is None


def test_no_cohort_is_its_own_model(spark):
    out = splits.leave_one_out(series(spark, [1.0, 2.0]), [0, 1])
    assert {(r["held_out"], r["role"]) for r in out.collect()} == {(0, "test"), (1, "train")}
    assert Window is not None


def test_simulated_areas_are_near_the_true_ones(spark):
    designs = spark.createDataFrame([(u, 20, 30) for u in range(20)], "unit long, n_positive long, n_negative long")
    got = resample.simulate_power(designs, [0.5, 0.7], 10).groupBy("true_auc").agg(F.avg("mean_auc").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["n"] == 10 and abs(r["m"] - r["true_auc"]) < 0.02 for r in got) and len(got) == 2


def test_dealt_profiles_stay_in_their_cohort(spark):
    pairs = spark.createDataFrame([(c, u, [1.0 + 9 * c, 2.0, 3.0, 4.0], [1.0 + 9 * c, 2.0, 3.0, 4.0]) for c in (0, 1) for u in range(3)], "cohort int, unit int, early array<double>, late array<double>")
    dealt = resample.permuted_profiles(pairs, 4).collect()
    assert len(dealt) == 4 and all(abs(r["mean_cosine"] - 1.0) < 1e-12 for r in dealt)


def test_automaton_is_linear_and_right(spark):
    import time

    from longspan.operators.sequence import lz_rate, novel_lengths

    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (30, 1), (60, 2), (80, 3), (50, 5)):
        for _ in range(20):
            s = rng.integers(0, k, n)
            assert novel_lengths(s).tolist() == naive_novel(s.tolist())
    times = []
    for n in (25_000, 100_000):
        start = time.process_time()
        novel_lengths(rng.integers(0, 5, n))
        times.append(time.process_time() - start)
    assert times[1] < 9 * times[0] + 0.5
    assert lz_rate([1] * 10) is None and 0 < lz_rate([1, 2] * 50) < 0.5


def test_tolerance_diff(spark):
    schema = "k string, i int, v double, w double"
    e = spark.createDataFrame([("a", 1, 1.0, None), ("b", 1, 2.0, 2.0), (None, 1, 3.0, float("nan")), ("c", 1, 0.0, 5.0)], schema)
    a = spark.createDataFrame([("a", 1, 1.0 + 1e-13, None), ("b", 1, 2.0 + 1e-11, None), (None, 1, 3.0, float("nan")), ("d", 1, 0.0, 5.0)], schema)
    got = {(r["k"], r["column"], r["problem"]) for r in validate.differences(e, a, ["k", "i"], {"v": 1e-12, "w": 1e-12}).collect()}
    assert got == {("b", "v", "differs"), ("b", "w", "differs"), ("c", "v", "missing"), ("c", "w", "missing"), ("d", "v", "extra"), ("d", "w", "extra")}
    assert validate.require_same(e, e, ["k", "i"], {"v": 0.0}) is e
    with pytest.raises(validate.ContractError):
        validate.require_same(e, a, ["k", "i"], {"v": 1e-12})


def test_csv_cache_follows_the_files(spark, tmp_path):
    from longspan.sources import ingest

    source, cache = tmp_path / "csv", f"file://{tmp_path}/cache"
    source.mkdir()
    (source / "a.csv").write_text("x,y,z\n1,2,3\n4,5,6\n")
    first = ingest.cached_csv(spark, f"file://{source}", ["x", "y"], cache)
    assert sorted(map(tuple, first.collect())) == [(1, 2), (4, 5)]
    place = first.inputFiles()
    again = ingest.cached_csv(spark, f"file://{source}", ["y", "x"], cache)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert again.inputFiles() == place and "FileScan parquet" in plan and "FileScan csv" not in plan
    (source / "a.csv").write_text("x,y,z\n1,2,3\n4,5,7\n7,8,9\n")
    assert ingest.cached_csv(spark, f"file://{source}", ["x", "y"], cache).count() == 3
    assert ingest.cached_csv(spark, f"file://{source}", ["x"], cache).columns == ["x"]
    (source / "b.csv").write_text("x,y,z\n0,0,0\n")
    assert ingest.cached_csv(spark, f"file://{source}", ["x", "y"], cache).count() == 4


def test_as_of_sees_no_same_day(spark):
    left = spark.createDataFrame([("u", "2024-01-03", 1.0), ("u", "2024-01-05", 2.0), ("v", "2024-01-05", 3.0)], "k string, d string, x double").withColumn("date", F.to_date("d")).drop("d")
    right = spark.createDataFrame([("u", "2024-01-01", 10.0), ("u", "2024-01-03", 11.0), ("u", "2024-01-04", None), ("v", "2024-01-05", 12.0)], "k string, d string, o double").withColumn("date", F.to_date("d")).drop("d")
    from longspan.operators.windows import as_of

    got = {(r["k"], r["x"]): (r["prior_o"], r["days_since_o"]) for r in as_of(left, right, ["k"], ["o"]).collect()}
    assert got == {("u", 1.0): (10.0, 2), ("u", 2.0): (11.0, 2), ("v", 3.0): (None, None)}


def test_sampled_areas_are_those_of_samples():
    rng, shift = np.random.default_rng(6), resample.shift_of(0.62)
    for p, n in ((3, 11), (9, 4)):
        a = resample.sampled_areas(p, n, shift, (40_000,), rng)
        pos, neg = rng.standard_normal((40_000, p)) + shift, rng.standard_normal((40_000, n))
        b = (pos[:, :, None] > neg[:, None]).mean((1, 2))
        assert abs(a.mean() - b.mean()) < 0.004 and abs(a.std() - b.std()) < 0.004 and all(abs(np.quantile(a, q) - np.quantile(b, q)) < 0.03 for q in (0.05, 0.5, 0.95))


def test_ridge_models_are_the_single_ones(spark):
    rng = np.random.default_rng(9)
    rows = [(int(g), "train" if rng.random() < 0.7 else "test", *(float(v) for v in rng.normal(1e3, 1, 3)), float(rng.normal())) for g in (0, 1) for _ in range(60)]
    df = spark.createDataFrame([(*r[:2], None if i % 9 == 0 else r[2], *r[3:]) for i, r in enumerate(rows)], "g int, role string, a double, b double, c double, y double")
    models = {"one": (["a"], 1.0), "two": (["a", "c"], 3.0), "plain": (["b", "c"], 0.0)}
    got = linear.ridge_models(df, models, "y", ["g"]).toPandas()
    for name, (features, alpha) in models.items():
        want = linear.ridge(df, features, "y", ["g"], alpha=alpha).toPandas()
        assert np.allclose(sorted(got[name]), sorted(want["prediction"]), atol=1e-8)


def test_logistic_grid_is_the_single_fits(spark):
    rng = np.random.default_rng(12)
    rows = [("c", u, f"2024-01-{1 + t:02d}", int(rng.random() < 0.4), float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal())) for u in range(12) for t in range(int(rng.integers(3, 20)))]
    df = spark.createDataFrame(rows, "cohort string, unit int, d string, label int, a double, b double").withColumn("date", F.to_date("d")).cache()
    t = Trajectory()
    shares, sets = [0.25, 0.45], {"one": ["a"], "two": ["a", "b"]}
    grid = linear.logistic_grid(splits.role_bits(df, t, shares), sets, "label", ["x", "y"]).toPandas()
    for cell, share in zip("xy", shares):
        for name, features in sets.items():
            want = linear.logistic(splits.within_unit(df, t, share), features, "label").where("role = 'test'").toPandas()
            got = grid[(grid["cell"] == cell) & (grid["model"] == name)]
            assert len(got) == len(want) and np.allclose(sorted(got["probability"]), sorted(want["probability"]), atol=1e-6)


def test_cohort_files_are_written_by_many_tasks(spark, sf_dir, monkeypatch):
    """No task reads or writes all rows of a cohort's CSV."""
    from longspan.queries import sources

    monkeypatch.setattr(sources, "written", lambda df, name: df.repartition(3))
    root = sources._cohort_files(spark, sf_dir)
    files = sources.ingest.listing(spark, root, "*.csv").groupBy(sources.ingest.path_part(F.col("path"), 4).alias("c")).count().collect()
    assert len(files) == 5 and all(r["count"] > 1 for r in files)


def test_simulated_power_has_no_shuffle_of_drawn_scores(spark):
    """Designs are dealt by unit, and means come together by area and simulation; scores stay where they are drawn."""
    designs = spark.range(40).select(F.col("id").alias("unit"), F.lit(3).cast("long").alias("n_positive"), (F.col("id") % 4).alias("n_negative"))
    plan = resample.simulate_power(designs, [0.5, 0.7], 4)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_pair_distributions_are_those_of_all_orders():
    """without a shift every order of the rows is as likely; with one, mean and spread are those of drawn samples."""
    from itertools import combinations

    def shares(p, n, shift):
        roots = np.exp(-2j * np.pi * np.arange((p * n + 1) // 2 + 1) / (p * n + 1))
        return np.fft.irfft(dict(resample.pair_transforms({i: n for i in range(p + 1)}, shift, roots))[p][n], p * n + 1)

    counts = np.zeros(21)
    for places in combinations(range(9), 4):
        counts[sum(x - k for k, x in enumerate(places))] += 1
    assert np.abs(shares(4, 5, 0.0) - counts / counts.sum()).max() < 1e-8
    f, v = shares(12, 30, resample.shift_of(0.6)), np.arange(361) / 360
    drawn = resample.sampled_areas(12, 30, resample.shift_of(0.6), (40_000,), np.random.default_rng(5))
    assert abs(f @ v - 0.6) < 1e-7 and abs(np.sqrt(f @ (v - 0.6) ** 2) - drawn.std()) < 0.002
    for times in (1, 7, 4000):  # the last one is kept modulo a width
        sums = resample.drawn_sums(f / f.sum(), times, 40_000, np.random.default_rng(times)) / 360 / times
        assert abs(sums.mean() - 0.6) < 0.002 and abs(sums.std() * times**0.5 / drawn.std() - 1) < 0.03


def test_power_of_alike_units_costs_no_more_for_more_of_them(spark):
    """10 million units of two kinds; simulated one by one, this does not end."""
    designs = spark.range(10_000_000).selectExpr("id AS unit", "3 + id % 2 AS n_positive", "4 AS n_negative")
    got = {r["true_auc"]: r for r in resample.sampled_power(designs, [0.5, 0.6], 2000).groupBy("true_auc").agg({"mean_auc": "avg", "simulation": "count"}).collect()}
    assert [got[a]["count(simulation)"] for a in (0.5, 0.6)] == [2000, 2000]
    assert all(abs(got[a]["avg(mean_auc)"] - a) < 1e-5 for a in got)
    few = designs.limit(60)
    both = [resample.sampled_power(few, [0.6], 4000, pairs=p).agg({"mean_auc": "avg"}).first()[0] for p in (0, resample.PAIRS)]
    assert abs(both[0] - both[1]) < 0.003


def test_ridge_of_overlapping_blocks_is_the_ridge_of_each(spark):
    """one pass of products for all blocks, targets and models; far from zero too, and for a block without rows."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3)) + 1e4
    rows = [(i, float(a), float(b), float(c), float(2 * a - b + e), float(c - a + e)) for i, ((a, b, c), e) in enumerate(zip(x, rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double, z double")
    inside = [F.col("i") < 260, (F.col("i") >= 100) & (F.col("i") < 340), F.col("i") < 0]
    models = {"one": (["a"], 10.0, "y"), "all": (["a", "b", "c"], 10.0, "y"), "other": (["a", "b", "c"], 1.0, "z")}
    got = linear.ridge_blocks(df, inside, models, ["a", "b", "c", "y", "z"])
    assert got[2] is None
    for fits, block in zip(got[:2], inside):
        rows = df.withColumn("role", F.when(block, "train").otherwise("test"))
        for name, (features, alpha, target) in models.items():
            want = linear.ridge_models(rows, {"m": (features, alpha)}, target, []).orderBy("i").toPandas()
            intercept, weights = fits[name]
            assert np.allclose(intercept + want[["a", "b", "c", "y", "z"]].to_numpy() @ weights, want["m"], rtol=0, atol=1e-6)
    with pytest.raises(ValueError):
        linear.ridge_blocks(df.withColumn("a", F.nullif("a", F.lit(rows.first()["a"]))), inside, models, ["a", "b", "c", "y", "z"])


def test_forecasts_shuffle_and_sort_weeks_not_target_rows(spark, monkeypatch):
    """Weeks are ordered before they are one row a target; a target's places go over its known rows only."""
    from longspan.plans import robustness

    kept = {}
    monkeypatch.setattr(robustness, "written", lambda df, name: kept.setdefault(name, df))
    days = [DAY + dt.timedelta(days=7 * i) for i in range(30)]
    weeks = spark.createDataFrame([(0, u, d, float(i + u), float(i) if i % 3 else None) for u in range(3) for i, d in enumerate(days)], "cohort int, unit int, date date, a double, b double")
    robustness.forecasts(weeks, ["a", "b"])
    plan = kept["history"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "target" not in "".join(x for x in plan.splitlines() if "Sort [" in x or "Window [" in x)
    rows = kept["history"].where("unit = 1").orderBy("date").collect()
    assert [r["date"] for r in rows if r["target"] == "a"] == days[7:]
    known = [i for i in range(30) if i % 3]
    assert [r["date"] for r in rows if r["target"] == "b"] == [days[i] for i in known[7:]]
    first = next(r for r in rows if r["target"] == "b")
    assert abs(first["reg_history"] - sum(math.log1p(i) for i in known[:7]) / 7) < 1e-12


def test_block_bits_are_the_regimes(spark):
    at, n = F.col("id") % 23, F.lit(23)
    rows = spark.range(23).select(splits.block_bits(at, n).alias("bits"), F.size(splits.regimes(at, n)).alias("n")).collect()
    assert all(bin(r["bits"]).count("1") == r["n"] for r in rows) and len({r["bits"] for r in rows}) > 4


def test_composites_are_one_aggregate(spark):
    from longspan.plans import robustness

    z = ["forecastability_raw_z", "history_skill_z", "observed_sd_z", "observed_entropy_z"]
    rows = [("fixed", 0, 1, "early", t, float(i), None if i else 2.0, 1.0, 0.0) for i, t in enumerate("xxy")] + [("fixed", 0, 2, "early", "z", 5.0, 1.0, 1.0, 1.0)]
    m = spark.createDataFrame(rows, "regime string, cohort int, unit int, half string, target string, " + ", ".join(f"{c} double" for c in z))
    out = robustness.composites(m, {"two": (["x", "y"], 2), "all": (["x", "y", "z"], 1)})
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["scope"], r["unit"]): (r["n_targets"], r["forecastability"], r["history_skill"]) for r in out.collect()}
    assert got == {("two", 1): (2, 1.0, 2.0), ("all", 1): (2, 1.0, 2.0), ("all", 2): (1, 5.0, 1.0)}


def test_whole_numbers_are_those_of_round(spark):
    from longspan.plans import panels

    values = [0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, 12.345, -7.004999, 0.1, 0.29, 1e15, 4503599627370497.5, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(panels.whole("v", 1).alias("a"), F.round("v").cast("long").alias("b"), panels.whole("v").alias("c"), F.round(F.col("v") * 100).cast("long").alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got)


def test_coverage_medians_need_no_buffer_of_all_rows(spark, sf_dir, monkeypatch):
    """Refinement, which large groups take, gives the medians of the buffer."""
    from longspan.queries import robust

    m = spark.range(40).select(F.lit("fixed").alias("regime"), F.when(F.col("id") < 25, "early").otherwise("late").alias("half"), (10 + F.col("id") % 7).alias("n_obs"), (F.col("id") * 37 % 41 / 3.0).alias("observed_sd"), F.lit(0.5).alias("observed_entropy"))
    monkeypatch.setattr(robust, "_metrics", lambda spark, d: m)
    want = {r["half"]: r for r in m.groupBy("half").agg(F.count(F.lit(1)).alias("n_target_halves"), F.median("n_obs").alias("median_obs"), F.round(F.median("observed_sd"), 6).alias("median_sd")).collect()}
    for limit in (robust.MEDIAN_VALUES, 3):
        monkeypatch.setattr(robust, "MEDIAN_VALUES", limit)
        got = {r["half"]: r for r in robust.agg30_coverage_diagnostics(spark, sf_dir).collect()}
        assert all(got[h][c] == want[h][c] for h in want for c in ("n_target_halves", "median_obs", "median_sd"))


def test_holdout_sums_equal_ordered_holdouts(spark):
    rng = np.random.default_rng(5)
    n = 3000
    p = pd.DataFrame({"cohort": np.where(np.arange(n) < 7, 2, np.arange(n) % 2), "unit": np.arange(n), "a": rng.random(n), "b": rng.random(n) * 1e4 + 1e6})
    p["y"] = p["a"] + p["b"] / 1e4 + rng.random(n)
    df = spark.createDataFrame(p).withColumn("y", F.when(F.col("unit") % 11 != 0, F.col("y")))
    h = splits.stratified_holdouts(df, "cohort", "unit", 4)
    sums = {"n": F.count(F.lit(1)), "u": F.sum("unit")}
    want = {(r.rep, r.n, r.u) for r in h.where("role = 'test'").groupBy("rep").agg(*[c.alias(k) for k, c in sums.items()]).collect()}
    for deviations in (8.0, 0.0, float("inf")):  # 0: the band misses places, so all is put in order
        assert {(r.rep, r.n, r.u) for r in splits.holdout_sums(df, "cohort", "unit", sums, 4, deviations=deviations).collect()} == want
    fit = linear.ridge_models(h, {"one": (["a"], 0.0), "two": (["a", "b"], 0.0)}, "y", ["rep"]).where("role = 'test'")
    want = {(r.rep, r.model): r.r2 for r in metrics.regressions(fit, "y", ["one", "two"], ["rep"]).collect()}
    got = {(r.rep, m): r[m] for r in linear.holdout_fits(df, {"one": ["a"], "two": ["a", "b"]}, "y", "cohort", "unit", 4).collect() for m in ("one", "two")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_holdout_fits_write_no_row_a_holdout(spark, monkeypatch):
    sizes, real = {}, splits.written
    monkeypatch.setattr(splits, "written", lambda df, name: (lambda out: (sizes.__setitem__(name, out.count()), out)[1])(real(df, name)))
    df = spark.range(20000).selectExpr("id % 2 AS cohort", "id AS unit", "(id * 7919 % 1000) * 1e0 AS a", "(id * 104729 % 997) * 1e0 AS y")
    assert linear.holdout_fits(df, {"one": ["a"]}, "y", "cohort", "unit", 5).count() == 5
    assert sizes["near-the-last"] < 5 * 20000 / 10  # before, all 100,000 rows were put in order


def test_cohort_files_are_written_by_as_many_tasks_as_hold_rows(spark, sf_dir):
    from pathlib import Path

    from longspan.queries import sources

    small = {"spark.sql.adaptive.enabled": "false", "spark.sql.files.openCostInBytes": "1"}  # else a small table is one task's
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        root = sources._cohort_files(spark, sf_dir).removeprefix("file://")
    finally:
        for k in small:
            spark.conf.unset(k)
    files = [len(list(Path(root).glob(f"INS-W_{c}/FeatureData/steps.csv/part-*"))) for c in range(1, 6)]
    assert min(files) > 1  # one task wrote, and so read, all of a cohort before


def test_a_length_is_computed_once_a_row(spark):
    """Not for every element of the vector, nor for every centroid."""
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    loops = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    u = v.select(cluster.unit(F.col("v")).alias("u"))
    a = cluster.assign(v, "v", [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]).select("cluster")
    assert [r["u"] for r in u.collect()] == [[0.6, 0.8], [0.0, 0.0], None] and [r["cluster"] for r in a.collect()] == [2, 0, None]
    assert loops(u) == 1 and loops(a) == 2  # a sum of squares; and a dot product


def test_directions_do_not_depend_on_how_rows_come(spark):
    rng = np.random.default_rng(5)
    centers = np.eye(4)[:3] * 5
    x = centers[np.arange(90) % 3] + rng.normal(0, 0.5, (90, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, [0.0] * 4), (91, None)]
    tables = [spark.createDataFrame([rows[i] for i in order], "id long, v array<double>").repartition(parts) for order, parts in ((range(92), 1), (rng.permutation(92), 7))]
    found = [cluster.directions(t, "v", "id") for t in tables]
    assert [r["id"] for r in found[0].collect()] == [r["id"] for r in found[1].collect()]
    centroids = [cluster.spherical_kmeans(f, "v", 3, restarts=3) for f in found]
    assert np.allclose(centroids[0], centroids[1], atol=1e-12)
    labels = {r["id"]: r["cluster"] for r in cluster.assign(found[0], "v", centroids[0]).collect()}
    assert all(len({labels[i] for i in range(c, 90, 3)}) == 1 for c in range(3)) and len({labels[i] for i in range(3)}) == 3 and labels[91] is None
