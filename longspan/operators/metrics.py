"""Aggregates: agreement, ranking, errors, entropies, reliability, agreement of partitions.

Everything here is a grouped aggregate or a window over groups, with partial
aggregation before each shuffle; ranks and exact quantiles of groups beyond
``ranking.GROUP_ROWS`` rows are made by ranges and by refinement.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.numeric import EPS
from longspan.sources.workspace import written

from . import ranking


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def pearson_of(x: Column, y: Column, least: int) -> Column:
    """Correlation of rows where both are known, null below ``least`` or without variation.

    The built-in raises on a constant column, so it is made of moments here.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b)) * n
    return F.when((n >= least) & (spread > EPS), F.covar_pop(a, b) * n / F.nullif(spread, F.lit(0.0)))


def pearson(df: DataFrame, x: str, y: str, by: list[str], least: int = 5) -> DataFrame:
    rows = df.where(finite(x) & finite(y))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson_of(F.col(x), F.col(y), least).alias("r"))


def spearman(df: DataFrame, x: str, y: str, by: list[str], least: int = 5) -> DataFrame:
    """Pearson of average ranks, taken over all values of a column before pairs are masked."""
    rows = written(df.select(*by, x, y), "pairs")
    ranked = ranking.average_ranks(rows, {"_rx": F.col(x), "_ry": F.col(y)}, by)
    return ranked.groupBy(*by).agg(F.count(F.when(F.col("_rx").isNotNull() & F.col("_ry").isNotNull(), 1)).alias("n"), pearson_of(F.col("_rx"), F.col("_ry"), least).alias("rho"))


def auroc(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve with ties counting half; null for one class."""
    return ranking.areas(df.where(F.col(y).isNotNull() & finite(score)), y, score, by)


def classification(df: DataFrame, y: str, score: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy and the unweighted mean of both classes' F1; a score at the threshold is positive."""
    hit = (F.col(score) >= threshold).cast("int")
    cell = lambda t, p: F.count_if((F.col(y) == t) & (hit == p)).cast("double")
    c = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    part = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0)))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1 = lambda a, b, c: F.coalesce(part(2 * a, 2 * a + b + c), F.lit(0.0))
    recall = F.array(part(tp, tp + fn), part(tn, tn + fp))
    known = F.filter(recall, lambda x: x.isNotNull())
    return c.select(
        *by, (tp + fp + fn + tn).cast("long").alias("n"), ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        (F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).alias("balanced_accuracy"), ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"),
    )


def r_squared(y: Column, fit: Column) -> Column:
    total = F.var_pop(y) * F.count(y)
    return F.when(total > EPS, 1 - F.sum((y - fit) * (y - fit)) / F.nullif(total, F.lit(0.0)))


def regression(df: DataFrame, y: str, fit: str, by: list[str]) -> DataFrame:
    rows = df.where(finite(y) & finite(fit))
    a, b = F.col(y), F.col(fit)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(a - b)).alias("mae"), r_squared(a, b).alias("r2"), pearson_of(a, b, 2).alias("r"))


def bin_of(c: Column, edges: Column) -> Column:
    """Number of inner edges below the value: bins are closed on the right."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e < c))


def regressions(df: DataFrame, y: str, fits: list[str], by: list[str]) -> DataFrame:
    """by, model, n, mae, r2, r of several predictions, from one pass."""
    a = F.col(y)
    of = lambda m: (lambda v, b: F.struct(F.lit(m).alias("model"), F.count(b).alias("n"), F.avg(F.abs(v - b)).alias("mae"), r_squared(v, b).alias("r2"), pearson_of(v, b, 2).alias("r")))(*[F.when(finite(y) & finite(m), x) for x in (a, F.col(m))])
    return df.groupBy(*by).agg(F.array(*map(of, fits)).alias("_r")).select(*by, F.inline("_r"))


def entropy_of(df: DataFrame, state: str, by: list[str], divisor: Column) -> DataFrame:
    """Entropy of the states' shares in natural logs over ``divisor``, which is constant within a group."""
    counts = df.groupBy(*by, state).agg(F.count(F.lit(1)).alias("_n"), F.first(divisor).alias("_d"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(*by))
    return counts.withColumn("_p", share).groupBy(*by).agg((F.abs(-F.sum(F.col("_p") * F.log("_p"))) / F.first("_d")).alias("entropy"), F.sum("_n").alias("n"))


def binned_entropy(df: DataFrame, value: str, by: list[str], edges_by: list[str], parts: int = 5) -> DataFrame:
    """Entropy over bins whose edges come from a wider group; 0 where there are at most two edges."""
    edges = ranking.edges(df, value, edges_by, parts).withColumnRenamed("edges", "_edges")
    rows = ranking.join_on(df.where(F.col(value).isNotNull()), edges, edges_by).withColumn("_k", F.size("_edges") - 1)
    rows = rows.withColumn("_state", F.when(F.col("_k") > 1, bin_of(F.col(value), F.col("_edges"))).otherwise(0))
    return entropy_of(rows, "_state", by, F.when(F.col("_k") > 1, F.log(F.col("_k"))).otherwise(F.lit(1.0)))


def conditional_entropy(df: DataFrame, state: str, context: str, by: list[str], n_states: int = 5) -> DataFrame:
    """Mean entropy of the states within each context, by the contexts' shares, over log(n_states)."""
    cells = df.groupBy(*by, context, state).agg(F.count(F.lit(1)).alias("_n"))
    inside = F.sum("_n").over(Window.partitionBy(*by, context))
    whole = F.sum("_n").over(Window.partitionBy(*by))
    part = -(F.col("_n") / whole) * F.log(F.col("_n") / inside)
    return cells.withColumn("_part", part).groupBy(*by).agg((F.abs(F.sum("_part")) / F.lit(math.log(n_states))).alias("conditional_entropy"))


def robust_scale(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """max(IQR, 1.4826 * MAD) and whether it is too small beside the median."""
    rows = written(df.select(*by, F.col(value).alias("_x")), "values")
    q = written(ranking.shares_of(rows, "_x", by, [0.25, 0.5, 0.75]).select(*by, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")), "quartiles")
    away = ranking.join_on(rows, q, by).select(*by, F.abs(F.col("_x") - F.col("median")).alias("_away"))
    out = ranking.join_on(q, ranking.shares_of(away, "_away", by, [0.5]).select(*by, F.col("q")[0].alias("mad")), by)
    scale = F.greatest(F.col("iqr"), F.lit(1.4826) * F.col("mad"))
    return out.withColumn("scale", scale).withColumn("degenerate", F.coalesce(scale <= 1e-6 * F.greatest(F.lit(1.0), F.abs("median")), F.lit(True)))


def cronbach_alpha(df: DataFrame, items: list[str], by: list[str]) -> DataFrame:
    """Reliability of the items' sum over complete rows."""
    k = len(items)
    total = sum((F.col(i) for i in items[1:]), F.col(items[0]))
    parts = sum((F.var_samp(i) for i in items[1:]), F.var_samp(items[0]))
    return df.dropna(subset=items).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.lit(k / (k - 1)) * (1 - parts / F.nullif(F.var_samp(total), F.lit(0.0)))).alias("alpha"))


def adjusted_rand(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Agreement of two labellings from their contingency table."""
    pairs = lambda n: n * (n - 1) / F.lit(2.0)
    cells = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    sums = lambda keys: cells.groupBy(*by, *keys).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("s"))
    if by:
        joined = sums([a, b]).withColumnRenamed("s", "both").join(sums([a]).withColumnRenamed("s", "left"), by).join(sums([b]).withColumnRenamed("s", "right"), by).join(sums([]).withColumnRenamed("s", "all"), by)
    else:
        one = lambda keys, name: cells.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
        joined = one([a, b], "both")
        for keys, name in (([a], "left"), ([b], "right"), ([], "all")):  # four one-row tables side by side
            joined = joined.join(F.broadcast(one(keys, name)), F.lit(True))
    expected = F.col("left") * F.col("right") / F.nullif(F.col("all"), F.lit(0.0))
    top = (F.col("left") + F.col("right")) / 2
    return joined.select(*by, F.when(F.abs(top - expected) > EPS, (F.col("both") - expected) / F.nullif(top - expected, F.lit(0.0))).otherwise(1.0).alias("ari"))


def composite(df: DataFrame, values: list[str], by: list[str], target: str, least: int) -> DataFrame:
    """Means across targets where a group has ``least`` distinct targets."""
    out = df.groupBy(*by).agg(F.count_distinct(target).alias("n_targets"), *[F.avg(v).alias(v) for v in values])
    return out.where(F.col("n_targets") >= least)
