"""Many spherical k-means models in one scan, and the validation of a typology."""

import numpy as np
from longspan.operators import typology
from pyspark.sql import functions as F

SCHEMA = "regime string, cohort int, unit int, early array<double>, late array<double>"


def planted(spark, noise, seed=1):
    rng = np.random.default_rng(seed)
    centres, rows = np.eye(3, 5), []
    for cohort in range(4):
        for unit in range(40):
            c = centres[(unit + cohort) % 3]
            early, late = (c + rng.normal(0, noise, 5) for _ in range(2))
            rows += [(regime, cohort, unit, early.tolist(), late.tolist()) for regime in ("fixed", "disjoint")]
    return spark.createDataFrame(rows, SCHEMA)


def test_planted_types_are_supported_and_noise_is_not(spark):
    models = typology.grid(["fixed", "disjoint"], [0, 1, 2, 3], range(2, 5), 6)
    for noise, supported in ((0.15, {3}), (30.0, set())):
        p = planted(spark, noise).cache()
        folds = typology.validated(p, typology.fit(p, models), 500)
        out = {(r["regime"], r["k"]): r for r in typology.summarised(folds, ["fixed", "disjoint"]).collect()}
        assert len(out) == 6 and {k for (_, k), r in out.items() if r["supported"]} >= supported and (supported or not any(r["supported"] for r in out.values()))
        if supported:
            assert out["fixed", 3]["median_ari"] > 0.9 and out["fixed", 3]["n_successes"] == 4


def test_fit_does_not_depend_on_partitions_and_is_lloyd(spark):
    p = planted(spark, 0.6).where("regime = 'fixed'").cache()
    models = [typology.Model("fixed", 2, 3, i) for i in range(5)]
    a, b = typology.fit(p.repartition(7), models), typology.fit(p.coalesce(1), models)
    key = ("fixed", 2, 3)
    assert np.allclose(a[key], b[key], atol=1e-7)
    x = np.array([r["early"] for r in p.where("cohort <> 2").collect()])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = (x @ a[key].T).argmax(1)
    again = np.array([x[label == c].sum(0) for c in range(3)])
    assert np.allclose(again / np.linalg.norm(again, axis=1)[:, None], a[key], atol=1e-6)  # a fixed point


def test_dealt_tables_are_those_of_permuted_labels():
    rng = np.random.default_rng(2)
    e, late = rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    table = np.zeros((3, 3), int)
    np.add.at(table, (e, late), 1)
    t = typology.dealt_tables(table, 20_000, rng)
    assert (t.sum(2) == table.sum(1)).all() and (t.sum(1) == table.sum(0)).all() and t.min() >= 0
    hits = np.trace(t, axis1=1, axis2=2)
    real = np.array([(e == rng.permutation(late)).sum() for _ in range(20_000)])
    assert abs(hits.mean() - real.mean()) < 0.15 and abs(hits.std() - real.std()) < 0.1


def brute_rand(a, b):
    n = len(a)
    pairs = [(a[i] == a[j], b[i] == b[j]) for i in range(n) for j in range(i)]
    both, x, y = sum(p and q for p, q in pairs), sum(p for p, _ in pairs), sum(q for _, q in pairs)
    expected = x * y / len(pairs)
    return (both - expected) / ((x + y) / 2 - expected)


def test_rand_and_silhouettes(spark):
    rng = np.random.default_rng(3)
    e, late = rng.integers(0, 3, 30), rng.integers(0, 2, 30)
    table = np.zeros((3, 3), int)
    np.add.at(table, (e, late), 1)
    assert abs(typology.adjusted_rand(table[None])[0] - brute_rand(e, late)) < 1e-12
    assert typology.adjusted_rand(np.diag([5, 0, 0])[None])[0] == 1.0 and typology.adjusted_rand(np.array([[[0, 5], [0, 0]]]))[0] == 0.0
    u = rng.normal(size=(30, 4))
    u /= np.linalg.norm(u, axis=1)[:, None]
    d, scores = 1 - u @ u.T, []
    for i in range(30):
        own = [j for j in range(30) if e[j] == e[i] and j != i]
        a, b = d[i, own].mean(), min(d[i, e == c].mean() for c in set(e.tolist()) - {e[i]})
        scores.append((b - a) / max(a, b))
    df = spark.createDataFrame([("x", int(c), v.tolist()) for c, v in zip(e, u)], "g string, e int, u array<double>")
    assert abs(typology.silhouettes(df, ["g"]).collect()[0]["silhouette"] - np.mean(scores)) < 1e-9
    alone = df.where(F.col("e") == 0)
    assert typology.silhouettes(alone, ["g"]).collect()[0]["silhouette"] is None
