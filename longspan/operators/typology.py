"""Many spherical k-means models in one scan, and the validation of a typology on left-out cohorts.

A model belongs to a regime, a left-out cohort (or none), a number of clusters and a
restart.  One scan assigns every vector to the centroids of all models that it
trains and adds up the moves, so restarts, folds and numbers of clusters cost no
scans of their own; models that no longer move drop out.  Starts are drawn in
proportion to the distance to the nearest start so far, by a race of hash-made
exponential times, so they do not depend on how rows are split.  What comes to the
driver is of the size of the models.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.functions.hashing import PRIME, draw_hash, scrambled
from longspan.sources.workspace import written

from .cluster import dot, unit
from .ranking import join_on

#: Rows that a task takes at a time.
SLICE = 512
SEED = 20_260_831


@dataclass(frozen=True)
class Model:
    regime: str
    held_out: object  # a cohort, or None: all rows train
    k: int
    restart: int


def grid(regimes: list[str], cohorts: list, ks: range, restarts: int, all_restarts: int = 0) -> list[Model]:
    """Every regime, left-out cohort and number of clusters with ``restarts`` restarts; and fits on all rows."""
    out = [Model(r, c, k, i) for r in regimes for k in ks for c in cohorts for i in range(restarts)]
    return out + [Model(r, None, k, i) for r in regimes for k in ks for i in range(all_restarts)]


def _slices(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(regime, cohorts, numbers of rows, vectors) of a few rows at a time."""
    for part in parts:
        for regime, rows in part.groupby("regime"):
            for lo in range(0, len(rows), SLICE):
                some = rows.iloc[lo : lo + SLICE]
                yield regime, some["cohort"].to_numpy(), some["number"].to_numpy(np.int64), np.stack(some["u"].to_numpy()).astype(np.float64)


def _by_shape(models: list[Model], at: np.ndarray) -> dict:
    """Numbers of the models of each (regime, k)."""
    out: dict = {}
    for i in at.tolist():
        out.setdefault((models[i].regime, models[i].k), []).append(i)
    return {key: np.array(v) for key, v in out.items()}


def _trains(models: list[Model], at: np.ndarray, cohorts: np.ndarray) -> np.ndarray:
    """rows x models: whether a row is one of a model's training rows."""
    held = np.array([models[i].held_out for i in at], dtype=object)
    return cohorts.astype(object)[:, None] != held[None]


def starts(rows: DataFrame, models: list[Model], centroids: list[np.ndarray]) -> list[np.ndarray]:
    """The models' centroids with one more start each, for those that have fewer than k."""
    open_ = np.array([i for i, m in enumerate(models) if len(centroids[i]) < m.k])
    shapes = _by_shape(models, open_)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[float, list]] = {}
        for regime, cohorts, numbers, x in _slices(parts):
            for (r, _), at in shapes.items():
                if r != regime:
                    continue
                count = len(centroids[at[0]])
                key = scrambled(at.astype(np.int64) * 16 + count, SEED)
                time = -np.log((scrambled(numbers[:, None], key[None]) + 0.5) / PRIME)
                if count:
                    near = (x @ np.concatenate([centroids[i] for i in at]).T).reshape(len(x), len(at), count).max(2)
                    time = time / np.maximum(1.0 - near, 1e-15)  # where all rows are at a start, any of them
                time = np.where(_trains(models, at, cohorts), time, np.inf)
                first = time.argmin(0)
                for j, i in enumerate(at.tolist()):
                    t = float(time[first[j], j])
                    if np.isfinite(t) and (i not in best or t < best[i][0]):
                        best[i] = (t, x[first[j]].tolist())
        if best:
            yield pd.DataFrame({"model": list(best), "time": [t for t, _ in best.values()], "u": [v for _, v in best.values()]})

    found = rows.mapInPandas(run, "model int, time double, u array<double>").groupBy("model").agg(F.min_by("u", "time").alias("u")).collect()
    out = list(centroids)
    for r in found:
        out[r["model"]] = np.vstack([out[r["model"]], [r["u"]]]) if len(out[r["model"]]) else np.array([r["u"]])
    return out


def moves(rows: DataFrame, models: list[Model], centroids: list[np.ndarray], open_: np.ndarray) -> dict[int, np.ndarray]:
    """For each open model the sums (k x (dimension + 2)): vectors, rows and similarity of each cluster."""
    shapes = _by_shape(models, open_)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for regime, cohorts, _, x in _slices(parts):
            for (r, k), at in shapes.items():
                if r != regime:
                    continue
                near = (x @ np.concatenate([centroids[i] for i in at]).T).reshape(len(x), len(at), k)
                label, close, mine = near.argmax(2), near.max(2), _trains(models, at, cohorts)
                wide = np.concatenate([x, np.ones((len(x), 1))], 1)
                sums = total.setdefault((r, k), np.zeros((len(at), k, x.shape[1] + 2)))
                for c in range(k):
                    own = (label == c) & mine
                    sums[:, c, :-1] += own.T.astype(np.float64) @ wide
                    sums[:, c, -1] += (own * close).sum(0)
        for key, sums in total.items():
            yield pd.DataFrame({"model": shapes[key], "sums": [s.ravel().tolist() for s in sums]})

    added = rows.mapInPandas(run, "model int, sums array<double>").select("model", F.posexplode("sums").alias("at", "v")).groupBy("model", "at").agg(F.sum("v").alias("v")).toArrow().sort_by([("model", "ascending"), ("at", "ascending")])
    model, v = added.column("model").to_numpy(), added.column("v").to_numpy()
    edges = np.flatnonzero(np.append(True, np.diff(model) != 0)) if len(model) else np.zeros(0, int)
    return {int(model[a]): v[a:b].reshape(models[model[a]].k, -1) for a, b in zip(edges, [*edges[1:], len(model)])}


def fit(profiles: DataFrame, models: list[Model], vector: str = "early", iterations: int = 100) -> dict[tuple, np.ndarray]:
    """Centroids of the best restart of each (regime, held_out, k); rows of ``profiles``: regime, cohort, unit and the vector.

    A row without direction trains nothing.  A cluster that loses all rows keeps its
    centroid.  Groups with fewer rows than clusters give fewer centroids.
    """
    number = F.pmod(draw_hash(F.col("cohort"), F.col("unit")), F.lit(PRIME)).alias("number")
    rows = written(profiles.where(F.exists(F.col(vector), lambda x: F.abs(x) > 1e-12)).select("regime", "cohort", number, unit(F.col(vector)).alias("u")), "directions")
    centroids: list[np.ndarray] = [np.zeros((0, 0)) for _ in models]
    for _ in range(max((m.k for m in models), default=0)):
        centroids = starts(rows, models, centroids)
    usable = [i for i, m in enumerate(models) if len(centroids[i]) == m.k]
    open_, objective = np.array(usable, int), np.full(len(models), -np.inf)
    for _ in range(iterations):
        if not len(open_):
            break
        still = []
        for i, sums in moves(rows, models, centroids, open_).items():
            objective[i] = sums[:, -1].sum()
            size = np.linalg.norm(sums[:, :-2], axis=1)
            new = np.where((size > 1e-12)[:, None], sums[:, :-2] / np.maximum(size, 1e-300)[:, None], centroids[i])
            if np.abs(new - centroids[i]).max() > 1e-9:
                still.append(i)
            centroids[i] = new
        open_ = np.array(still, int)
    best: dict[tuple, tuple] = {}
    for i in usable:
        key = (models[i].regime, models[i].held_out, models[i].k)
        if key not in best or objective[i] > best[key][0] + 1e-9:
            best[key] = (objective[i], centroids[i])
    return {key: c[np.lexsort(c.T[::-1])] for key, (_, c) in best.items()}


def assigned(profiles: DataFrame, found: dict[tuple, np.ndarray]) -> DataFrame:
    """regime, k, cohort, unit, u (direction of the early vector) and the early and late labels of left-out rows, by their cohort's models."""
    kinds = {f.name: f.dataType.simpleString() for f in profiles.schema.fields}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        direction = lambda rows: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None])(np.stack(rows.to_numpy()).astype(np.float64))
        for part in parts:
            for (regime, cohort), rows in part.groupby(["regime", "cohort"]):
                early, late = direction(rows["early"]), direction(rows["late"])
                for (r, held, k), c in found.items():
                    if r == regime and held == cohort:
                        yield pd.DataFrame({"regime": r, "k": k, "cohort": rows["cohort"], "unit": rows["unit"], "u": list(early), "e": (early @ c.T).argmax(1), "l": (late @ c.T).argmax(1)})

    return profiles.select("regime", "cohort", "unit", "early", "late").mapInPandas(run, f"regime string, k int, cohort {kinds['cohort']}, unit {kinds['unit']}, u array<double>, e int, l int")


def dealt_tables(table: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """draws x k x k tables with the margins of ``table``, as random relabelling gives them; costs cells, not rows."""
    k = len(table)
    out, left = np.zeros((draws, k, k), np.int64), np.tile(table.sum(0), (draws, 1))
    for i in range(k):
        need = np.full(draws, table[i].sum())
        for j in range(k):
            rest = left[:, j + 1 :].sum(1)
            out[:, i, j] = rng.hypergeometric(left[:, j], rest, need) if j + 1 < k else need
            need = need - out[:, i, j]
        left = left - out[:, i]
    return out


def adjusted_rand(tables: np.ndarray) -> np.ndarray:
    pairs = lambda n: n * (n - 1) / 2.0
    both, rows, columns = pairs(tables).sum((1, 2)), pairs(tables.sum(2)).sum(1), pairs(tables.sum(1)).sum(1)
    expected, top = rows * columns / np.maximum(pairs(tables.sum((1, 2))), 1), (rows + columns) / 2
    flat = np.abs(top - expected) <= 1e-12
    same = np.array([(np.count_nonzero(t, axis=0) <= 1).all() and (np.count_nonzero(t, axis=1) <= 1).all() and np.trace(t) == t.sum() for t in tables])
    return np.where(flat, same.astype(float), (both - expected) / np.where(flat, 1.0, top - expected))


def agreement(labels: DataFrame, permutations: int = 10_000) -> DataFrame:
    """regime, k, cohort: size, accuracy, adjusted Rand index and both permutation p, least prevalence of a cluster."""
    cells = labels.groupBy("regime", "k", "cohort", "e", "l").agg(F.count(F.lit(1)).alias("n"))
    kind = labels.schema["cohort"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        regime, k, cohort = key
        table = np.zeros((k, k), np.int64)
        table[rows["e"], rows["l"]] = rows["n"]
        null = dealt_tables(table, permutations, np.random.default_rng([SEED, k, zlib.crc32(f"{regime}|{cohort}".encode())]))
        n, ari = table.sum(), float(adjusted_rand(table[None])[0])
        p = lambda hits: float((1 + hits.sum()) / (permutations + 1))
        return pd.DataFrame([{
            "regime": regime, "k": k, "cohort": cohort, "n_units": n, "accuracy": np.trace(table) / n, "ari": ari, "least_prevalence": table.sum(1).min() / n,
            "accuracy_p": p(np.trace(null, axis1=1, axis2=2) >= np.trace(table)), "ari_p": p(adjusted_rand(null) >= ari - 1e-12),
        }])

    return cells.groupBy("regime", "k", "cohort").applyInPandas(run, f"regime string, k int, cohort {kind}, n_units long, accuracy double, ari double, least_prevalence double, accuracy_p double, ari_p double")


def silhouettes(labels: DataFrame, by: list[str], label: str = "e") -> DataFrame:
    """by, silhouette: mean silhouette by cosine distance, from sums of directions; a cluster of one row has 0."""
    flat = labels.select(*by, label, F.posexplode("u").alias("at", "x")).groupBy(*by, label, "at").agg(F.sum("x").alias("s"))
    sums = flat.groupBy(*by, label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda p: p["s"]).alias("total"))
    sizes = labels.groupBy(*by, label).agg(F.count(F.lit(1)).alias("m"))
    clusters = join_on(sums, sizes, [*by, label]).groupBy(*by).agg(F.collect_list(F.struct(F.col(label).alias("of"), "total", "m")).alias("clusters"))  # k of them
    rows = join_on(labels, written(clusters, "cluster-sums"), by)
    own = F.element_at(F.filter("clusters", lambda c: c["of"] == F.col(label)), 1)
    within = F.when(own["m"] > 1, (own["m"] - dot(F.col("u"), own["total"])) / F.nullif(own["m"] - 1, F.lit(0)))
    away = F.array_min(F.transform(F.filter("clusters", lambda c: c["of"] != F.col(label)), lambda c: 1 - dot(F.col("u"), c["total"]) / c["m"]))
    rows = rows.select(*by, within.alias("a"), away.alias("b"))
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNull(), 0.0).when(top > 1e-12, (F.col("b") - F.col("a")) / F.nullif(top, F.lit(0.0))).otherwise(F.when(F.col("b").isNotNull(), 0.0))
    return rows.groupBy(*by).agg(F.avg(score).alias("silhouette"))


def validated(profiles: DataFrame, found: dict[tuple, np.ndarray], permutations: int = 10_000) -> DataFrame:
    """Each left-out cohort's agreement with silhouette, and whether the fold succeeds."""
    by = ["regime", "k", "cohort"]
    labels = written(assigned(profiles, found), "typology-labels")
    folds = join_on(agreement(labels, permutations), silhouettes(labels, by), by, "left")
    return folds.withColumn("succeeds", (F.col("ari") > 0.2) & (F.col("accuracy_p") < 0.05) & (F.col("least_prevalence") >= 0.1))


def summarised(folds: DataFrame, regimes: list[str]) -> DataFrame:
    """regime, k: medians over folds, successes, and whether ``k`` is supported: in every regime a median above 0.2 and 3 successes."""
    out = folds.groupBy("regime", "k").agg(
        F.median("ari").alias("median_ari"), F.median("accuracy").alias("median_accuracy"), F.median("silhouette").alias("median_silhouette"),
        F.count_if("succeeds").alias("n_successes"), F.min("least_prevalence").alias("least_prevalence"),
    )
    good = out.groupBy("k").agg((F.count_if((F.col("median_ari") > 0.2) & (F.col("n_successes") >= 3)) == len(regimes)).alias("supported"))
    return out.join(F.broadcast(good), "k")  # a row for each k
