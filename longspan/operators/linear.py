"""Linear models from sums: one pass gathers every group's normal equations, the driver solves them.

The number of coefficients is small and fixed by the design, the rows are not:
a group's rows never meet, only sums of products do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.functions.numeric import EPS, with_aggregates
from longspan.sources.workspace import written

from . import ranking, splits


def _filled(df: DataFrame, features: list[str], by: list[str], train: Column) -> DataFrame:
    """Median and population scale of each feature in the training rows, then the filled and scaled columns."""
    medians = ranking.medians(df.where(train), features, by).select(*by, *[F.coalesce(f, F.lit(0.0)).alias(f"_m_{f}") for f in features])
    out = df.join(F.broadcast(medians), by) if by else df.join(F.broadcast(medians), F.lit(True))
    for f in features:
        out = out.withColumn(f, F.coalesce(F.col(f).cast("double"), F.col(f"_m_{f}")))
    stats = out.where(train).groupBy(*by).agg(*[x for f in features for x in (F.avg(f).alias(f"_a_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))])
    out = out.join(F.broadcast(stats), by) if by else out.join(F.broadcast(stats), F.lit(True))
    for f in features:
        out = out.withColumn(f, (F.col(f) - F.col(f"_a_{f}")) / F.when(F.col(f"_s_{f}") > EPS, F.col(f"_s_{f}")).otherwise(1.0))
    return out.drop(*[f"_{k}_{f}" for f in features for k in "mas"])


def ridge(df: DataFrame, features: list[str], target: str, by: list[str], role: str = "role", alpha: float = 1.0) -> DataFrame:
    """Adds ``prediction`` by ridge regression on scaled features, fitted on each group's training rows.

    Missing features take the training median, constant ones have no effect, and
    the intercept (the mean of the target) is not penalised.
    """
    train = (F.col(role) == "train") & F.col(target).isNotNull()
    rows = _filled(df, features, by, train)
    k = len(features)
    products = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    cross = [F.sum(F.col(a) * F.col(target)).alias(f"c_{i}") for i, a in enumerate(features)]
    sums = rows.where(train).groupBy(*by).agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s_{i}") for i, f in enumerate(features)], *products, *cross).collect()
    out = []
    for r in sums:  # one row of sums a model, however many rows it was fitted on
        gram = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
        right = np.array([r[f"c_{i}"] - r["mean"] * r[f"s_{i}"] for i in range(k)], float)
        lhs = gram + alpha * np.eye(k)
        beta = np.linalg.lstsq(lhs, right, rcond=None)[0] if alpha == 0 else np.linalg.solve(lhs, right)
        out.append((*[r[b] for b in by], float(r["mean"]), [float(b) for b in beta]))
    schema = ", ".join([f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by] + ["_mean double", "_beta array<double>"])
    models = F.broadcast(df.sparkSession.createDataFrame(out, schema))
    scored = rows.join(models, by) if by else rows.join(models, F.lit(True))
    dot = sum((F.col(f) * F.get("_beta", F.lit(i)) for i, f in enumerate(features)), F.col("_mean"))
    return scored.withColumn("prediction", dot).drop("_mean", "_beta")


def ridge_models(df: DataFrame, models: dict[str, tuple[list[str], float]], target: str, by: list[str], role: str = "role") -> DataFrame:
    """Adds a column with the predictions of each model (features, penalty), fitted on each group's training rows.

    The rows are written once.  One pass gathers the cross-products of all features,
    which are the sufficient statistics of every model: a model's system is a
    sub-block of them.  Features are as in ``ridge``; products are taken about the
    training medians, so large offsets do not cancel.
    """
    rows = written(df, "samples")
    names = list(dict.fromkeys(f for features, _ in models.values() for f in features))
    train = (F.col(role) == "train") & F.col(target).isNotNull()
    middle = written(ranking.medians(rows.where(train), names, by).select(*by, *[F.coalesce(f, F.lit(0.0)).alias(f"_m_{f}") for f in names]), "medians")
    rows = ranking.join_on(rows, middle, by) if by else rows.join(F.broadcast(middle), F.lit(True))
    d = {f: F.coalesce(F.col(f).cast("double") - F.col(f"_m_{f}"), F.lit(0.0)) for f in names}
    y = F.col(target).cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.where(train).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), *[F.sum(d[f]).alias(f"s_{i}") for i, f in enumerate(names)],
        *[F.sum(d[names[i]] * d[names[j]]).alias(f"g_{i}_{j}") for i, j in pairs], *[F.sum(d[f] * y).alias(f"c_{i}") for i, f in enumerate(names)],
    )
    out = []
    for r in sums.collect():  # one row of sums a group, however many rows it has
        k, n = len(names), r["n"]
        mean = np.array([r[f"s_{i}"] for i in range(k)], float) / n
        gram = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) - n * np.outer(mean, mean)
        right = np.array([r[f"c_{i}"] for i in range(k)], float) - n * mean * r["mean"]
        scale = np.sqrt(np.maximum(np.diag(gram) / n, 0))
        scale = np.where(scale > EPS, scale, 1.0)
        gram, right = gram / np.outer(scale, scale), right / scale
        solved = []
        for features, alpha in models.values():
            at = [names.index(f) for f in features]
            block, rhs, beta = gram[np.ix_(at, at)], right[at], np.zeros(k)
            beta[at] = np.linalg.lstsq(block, rhs, rcond=None)[0] if alpha == 0 else np.linalg.solve(block + alpha * np.eye(len(at)), rhs)
            beta = beta / scale
            solved.append([float(r["mean"] - beta @ mean), *map(float, beta)])
        out.append((*[r[b] for b in by], solved))
    schema = ", ".join([f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by] + ["_models array<array<double>>"])
    table = df.sparkSession.createDataFrame(out, schema)
    scored = ranking.join_on(rows, table, by) if by else rows.join(F.broadcast(table), F.lit(True))
    fit = lambda m: sum((d[f] * F.col("_models")[m][i + 1] for i, f in enumerate(names)), F.col("_models")[m][0])
    return scored.withColumns({name: fit(m) for m, name in enumerate(models)}).drop("_models", *[f"_m_{f}" for f in names])


def block_sums(rows: DataFrame, columns: list[str], blocks: Column, centre: list[float]) -> dict[int, np.ndarray]:
    """For each value of ``blocks`` (bits of the blocks that a row is in) the products of (1, columns about ``centre``), summed over its rows.

    A task multiplies whole batches; a row of sums a value and task is all that leaves it.
    """
    k = len(columns) + 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            x = np.column_stack([np.ones(len(part)), part[columns].to_numpy(float) - centre])
            bits = part["_blocks"].to_numpy()
            for b in np.unique(bits):
                at = x[bits == b]
                total[int(b)] = total.get(int(b), 0.0) + at.T @ at
        if total:
            yield pd.DataFrame({"bits": list(total), "sums": [v.ravel() for v in total.values()]})

    parts = rows.select(*columns, blocks.alias("_blocks")).where("_blocks > 0").mapInPandas(run, "bits int, sums array<double>")
    cells = parts.select("bits", F.posexplode("sums").alias("at", "v")).groupBy("bits", "at").agg(F.sum("v").alias("v")).collect()  # k x k numbers a value
    out: dict[int, np.ndarray] = {}
    for r in cells:
        out.setdefault(r.bits, np.zeros(k * k))[r["at"]] = r.v
    return {b: v.reshape(k, k) for b, v in out.items()}


def ridge_blocks(rows: DataFrame, blocks: list[Column], models: dict[str, tuple[list[str], float, str]], columns: list[str]) -> list[dict[str, tuple[float, np.ndarray]] | None]:
    """For each block (condition of its training rows; they may overlap) each model's intercept and a weight for each of ``columns``.

    A model is (features, penalty, target), all among ``columns``, which must be known in every row; features are scaled
    as in ``ridge``.  Rows are read once for their means and once for the products, which are those of every
    model and block; a block without rows has no models.
    """
    known = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("m", F.avg))]).first()
    if any(known[f"n_{c}"] < known["n"] for c in columns):
        raise ValueError("a column has nulls; use ridge_models")
    centre = [float(known[f"m_{c}"] or 0.0) for c in columns]
    bits = F.lit(0)
    for b, inside in enumerate(blocks):
        bits = bits + F.when(inside, 1 << b).otherwise(0)
    sums, out = block_sums(rows, columns, bits.cast("int"), centre), []
    for b in range(len(blocks)):
        total = sum((v for k, v in sorted(sums.items()) if k >> b & 1), np.zeros((len(columns) + 1,) * 2))
        n = total[0, 0]
        if not n:
            out.append(None)
            continue
        mean = total[0, 1:] / n
        gram = total[1:, 1:] - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(gram) / n, 0))
        scale = np.where(scale > EPS, scale, 1.0)
        solved = {}
        for name, (features, alpha, target) in models.items():
            at, y = [columns.index(f) for f in features], columns.index(target)
            block = gram[np.ix_(at, at)] / np.outer(scale[at], scale[at])
            weight = np.zeros(len(columns))
            weight[at] = np.linalg.solve(block + alpha * np.eye(len(at)), gram[at, y] / scale[at]) / scale[at]
            solved[name] = (float(centre[y] + mean[y] - weight @ (mean + centre)), weight)
        out.append(solved)
    return out


def residuals(df: DataFrame, specs: list[tuple[str, list[str], str]], by: list[str], factor: str | None) -> DataFrame:
    """For each (y, controls, out) adds what a least-squares fit on a factor's levels and up to two controls leaves of y.

    By Frisch, Waugh and Lovell: centre everything within the factor's levels, then
    regress on the centred controls by closed form.  Rank deficiency (a control
    that does not vary within levels) drops that control, as a pseudo-inverse does.
    Means and products are aggregates joined back, two for all of ``specs``.
    """
    means, centred, sums = [], {}, []
    for i, (y, controls, _) in enumerate(specs):
        if len(controls) > 2:
            raise ValueError("two controls at most; use residual_wide for more")
        used = F.lit(True)
        for c in [y, *controls]:
            used = used & F.col(c).isNotNull()
        for j, c in enumerate([y, *controls]):
            means.append(F.avg(F.when(used, F.col(c))).alias(f"_m{i}_{j}"))
            centred[f"_c{i}_{j}"] = F.when(used, F.col(c)) - F.col(f"_m{i}_{j}")
        pairs = [(a, b) for a in range(len(controls) + 1) for b in range(max(a, 1), len(controls) + 1)]
        sums += [F.sum(F.col(f"_c{i}_{a}") * F.col(f"_c{i}_{b}")).alias(f"_s{i}_{a}{b}") for a, b in pairs]
    rows = with_aggregates(df, [*by, *([factor] if factor else [])], means).withColumns(centred)
    if sums:
        rows = with_aggregates(rows, by, sums)
    out = {}
    for i, (_, controls, name) in enumerate(specs):
        s = lambda ab, i=i: F.col(f"_s{i}_{ab}")
        c = [F.col(f"_c{i}_{j}") for j in range(len(controls) + 1)]
        out[name] = c[0]
        if controls:
            alone = F.when(s("11") > EPS, s("01") / F.nullif(s("11"), F.lit(0.0))).otherwise(0.0)
        if len(controls) == 1:
            out[name] = c[0] - alone * c[1]
        elif len(controls) == 2:
            det = s("11") * s("22") - s("12") * s("12")
            solid = det > EPS * F.greatest(s("11") * s("22"), F.lit(EPS))
            safe = F.nullif(det, F.lit(0.0))
            first = F.when(solid, (s("22") * s("01") - s("12") * s("02")) / safe).otherwise(alone)
            second = F.when(solid, (s("11") * s("02") - s("12") * s("01")) / safe).otherwise(0.0)
            out[name] = c[0] - first * c[1] - second * c[2]
    kept = [x for x in df.columns if x not in out]
    return rows.select(*kept, *[v.alias(k) for k, v in out.items()])


def holdout_fits(df: DataFrame, models: dict[str, list[str]], target: str, stratum: str, unit: str, repetitions: int) -> DataFrame:
    """rep and the R squared of each model (null without variation) on the test rows of stratified holdouts, by least squares on the other rows.

    Products about the means of all rows are summed over all rows and over the test rows of
    every holdout; training rows are the difference, and fits and errors follow from the
    products, so no row is written or scored a holdout.  Features must be known.
    """
    names = [*dict.fromkeys(f for features in models.values() for f in features), target]
    known = F.col(target).isNotNull()
    rows = written(df.select(stratum, unit, *names), "holdout-rows")
    centre = rows.where(known).agg(F.count(F.lit(1)), *[F.avg(c) for c in names]).first()[1:]
    v = [known.cast("double"), *[F.when(known, F.col(c) - F.lit(float(m or 0.0))) for c, m in zip(names, centre)]]
    size = len(v)
    sums = {f"g_{i}_{j}": F.sum(v[i] * v[j]) for i in range(size) for j in range(i, size)}
    square = lambda r: np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)], float)
    whole = square(rows.agg(*[c.alias(name) for name, c in sums.items()]).first())
    out = []
    for r in splits.holdout_sums(rows, stratum, unit, sums, repetitions).collect():  # one row a holdout
        test = square(r)
        train, fits = whole - test, []
        total = test[-1, -1] - test[0, -1] ** 2 / test[0, 0] if test[0, 0] else 0.0
        for features in models.values():
            at = [1 + names.index(f) for f in features]
            if total <= EPS or train[0, 0] < 0.5:
                fits.append(None)
                continue
            mean = train[0] / train[0, 0]
            gram = train - train[0, 0] * np.outer(mean, mean)
            scale = np.sqrt(np.maximum(np.diag(gram)[at] / train[0, 0], 0))
            scale = np.where(scale > EPS, scale, 1.0)
            beta = np.linalg.lstsq(gram[np.ix_(at, at)] / np.outer(scale, scale), gram[at, -1] / scale, rcond=None)[0] / scale
            left = np.zeros(size)
            left[0], left[at], left[-1] = beta @ mean[at] - mean[-1], -beta, 1.0
            fits.append(float(1 - left @ test @ left / total))
        out.append((r.rep, *fits))
    return df.sparkSession.createDataFrame(out, ", ".join(["rep int", *[f"`{m}` double" for m in models]]))


def residual(df: DataFrame, y: str, controls: list[str], by: list[str], factor: str | None, out: str) -> DataFrame:
    """The residual of one column; see ``residuals``."""
    return residuals(df, [(y, controls, out)], by, factor)


def residual_wide(df: DataFrame, y: str, controls: list[str], by: list[str], out: str) -> DataFrame:
    """The same for any number of numeric controls and an intercept, by the pseudo-inverse of the summed products."""
    rows = df.dropna(subset=[y, *controls]).withColumn("_one", F.lit(1.0))
    names = ["_one", *controls]
    k = len(names)
    sums = rows.groupBy(*by).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i], *[F.sum(F.col(a) * F.col(y)).alias(f"c_{i}") for i, a in enumerate(names)]).collect()
    solved = []
    for r in sums:
        gram = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
        beta = np.linalg.pinv(gram, hermitian=True) @ np.array([r[f"c_{i}"] for i in range(k)], float)
        solved.append((*[r[b] for b in by], [float(b) for b in beta]))
    schema = ", ".join([f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by] + ["_beta array<double>"])
    models = F.broadcast(df.sparkSession.createDataFrame(solved, schema))
    fitted = rows.join(models, by) if by else rows.join(models, F.lit(True))
    fit = sum((F.col(n) * F.get("_beta", F.lit(i)) for i, n in enumerate(names)), F.lit(0.0))
    return fitted.withColumn(out, F.col(y) - fit).drop("_beta", "_one")


def logistic(df: DataFrame, features: list[str], target: str, role: str = "role", c: float = 1.0, steps: int = 12) -> DataFrame:
    """Adds ``probability`` by class-balanced logistic regression with an L2 penalty on all weights.

    Each step of iteratively reweighted least squares is one aggregate over the
    training rows; the driver solves a system of the size of the design.
    """
    train = (F.col(role) == "train") & F.col(target).isNotNull()
    rows = _filled(df, features, [], train).withColumn("_one", F.lit(1.0))
    names = ["_one", *features]
    k = len(names)
    n = {r[target]: r["count"] for r in rows.where(train).groupBy(target).count().collect()}
    total = sum(n.values())
    weight = F.when(F.col(target) == 1, total / (2 * max(1, n.get(1, 0)))).otherwise(total / (2 * max(1, n.get(0, 0))))
    fitted = rows.where(train).select(*names, F.col(target).cast("double").alias("_y"), weight.alias("_w")).cache()
    beta = np.zeros(k)
    for _ in range(steps):
        z = sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, names)), F.lit(0.0))
        p = fitted.withColumn("_p", 1 / (1 + F.exp(-z)))
        h, g = F.col("_w") * F.col("_p") * (1 - F.col("_p")), F.col("_w") * (F.col("_y") - F.col("_p"))
        r = p.agg(*[F.sum(h * F.col(a) * F.col(b)).alias(f"h_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i], *[F.sum(g * F.col(a)).alias(f"g_{i}") for i, a in enumerate(names)]).first()
        hess = np.array([[r[f"h_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) * c + np.eye(k)
        move = np.linalg.solve(hess, c * np.array([r[f"g_{i}"] for i in range(k)], float) - beta)
        beta = beta + move
        if np.abs(move).max() < 1e-10:
            break
    fitted.unpersist()
    z = sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, names)), F.lit(0.0))
    return rows.withColumn("probability", 1 / (1 + F.exp(-z))).drop("_one")


def logistic_grid(df: DataFrame, models: dict[str, list[str]], target: str, cells: list[str], roles: str = "roles", c: float = 1.0, steps: int = 12) -> DataFrame:
    """cell, model, label, probability of the test rows: every model in every cell of a grid of splits, fitted together.

    ``roles`` holds two bits a cell (training row, test row).  The rows are written once;
    each step of reweighted least squares is one aggregate for all cells and models,
    and the driver solves a system of the size of a design for each.  Missing features
    take the cell's training median.
    """
    names = list(dict.fromkeys(f for features in models.values() for f in features))
    rows = written(df.where(F.col(target).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in names], F.col(target).cast("double").alias("_y"), F.col(roles).alias("_roles")), "grid-rows")
    inside = lambda i, test=0: F.col("_roles").bitwiseAND(F.lit((1 + test) << (2 * i))) != 0
    grid = [(i, m) for i in range(len(cells)) for m in models]
    middle = [ranking.medians(rows.where(inside(i)), names, []).first().asDict() for i in range(len(cells))]
    filled = [{f: F.coalesce(F.col(f), F.lit(float(middle[i][f] or 0.0))) for f in names} for i in range(len(cells))]
    at = lambda i, x: F.when(inside(i), x)
    stats = rows.agg(
        *[g(at(i, filled[i][f])).alias(f"{k}_{i}_{f}") for i in range(len(cells)) for f in names for k, g in (("a", F.avg), ("s", F.stddev_pop))],
        *[g.alias(f"{k}_{i}") for i in range(len(cells)) for k, g in (("n", F.count_if(inside(i))), ("p", F.count_if(inside(i) & (F.col("_y") == 1))))],
    ).first()
    scale = lambda i, f: (stats[f"s_{i}_{f}"] or 0) if (stats[f"s_{i}_{f}"] or 0) > EPS else 1.0
    x = {(i, f): (filled[i][f] - float(stats[f"a_{i}_{f}"] or 0)) / float(scale(i, f)) for i in range(len(cells)) for f in names}
    design = {(i, m): [F.lit(1.0), *[x[i, f] for f in models[m]]] for i, m in grid}
    beta = {g: np.zeros(1 + len(models[g[1]])) for g in grid}
    fit = lambda g: 1 / (1 + F.exp(-sum((F.lit(float(b)) * v for b, v in zip(beta[g][1:], design[g][1:])), F.lit(float(beta[g][0])))))
    open_ = list(grid)
    for _ in range(steps):
        p = rows.withColumns({f"_p_{i}_{m}": fit((i, m)) for i, m in open_})
        sums = []
        for i, m in open_:
            n, pos = stats[f"n_{i}"], stats[f"p_{i}"]
            w = F.when(inside(i), F.when(F.col("_y") == 1, n / (2 * max(1, pos))).otherwise(n / (2 * max(1, n - pos)))).otherwise(0.0)
            q, v = F.col(f"_p_{i}_{m}"), design[i, m]
            sums += [F.sum(w * q * (1 - q) * v[a] * v[b]).alias(f"h_{i}_{m}_{a}_{b}") for a in range(len(v)) for b in range(a, len(v))]
            sums += [F.sum(w * (F.col("_y") - q) * v[a]).alias(f"g_{i}_{m}_{a}") for a in range(len(v))]
        r, still = p.agg(*sums).first(), []
        for i, m in open_:
            k = len(design[i, m])
            hess = np.array([[r[f"h_{i}_{m}_{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)], float) * c + np.eye(k)
            move = np.linalg.solve(hess, c * np.array([r[f"g_{i}_{m}_{a}"] or 0.0 for a in range(k)], float) - beta[i, m])
            beta[i, m] = beta[i, m] + move
            if np.abs(move).max() >= 1e-10:
                still.append((i, m))
        open_ = still
        if not open_:
            break
    scored = F.array(*[F.when(inside(i, 1), F.struct(F.lit(cells[i]).alias("cell"), F.lit(m).alias("model"), F.col("_y").cast("int").alias("label"), fit((i, m)).alias("probability"))) for i, m in grid])
    return rows.select(F.inline(F.filter(scored, lambda s: s.isNotNull())))


def forest(df: DataFrame, features: list[str], target: str, role: str = "role", trees: int = 300, leaf: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``probability`` by a class-balanced random forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train = (F.col(role) == "train") & F.col(target).isNotNull()
    medians = ranking.medians(df.where(train), features, []).select(*[F.coalesce(f, F.lit(0.0)).alias(f) for f in features]).first().asDict()
    rows = df.fillna(medians).withColumn("_label", F.col(target).cast("double"))
    share = rows.where(train).agg(F.avg("_label")).first()[0] or 0.5
    rows = rows.withColumn("_weight", F.when(F.col("_label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    model = RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="_weight", numTrees=trees, minInstancesPerNode=leaf, maxDepth=12, featureSubsetStrategy="sqrt", seed=seed, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model]).fit(rows.where(train))
    return fitted.transform(rows).withColumn("probability", vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_c", "_weight", "_label")
