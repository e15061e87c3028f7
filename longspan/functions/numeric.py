"""Column functions with the panel's rules for missing values and degenerate groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as a value in Spark and spoils averages: it becomes null once, at the door."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in floats else F.col(c) for c in df.columns])


def to_number(c: Column) -> Column:
    """Numeric value of a text, null where there is none."""
    return c.try_cast("double")


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if low is not None:
        out = F.when(c.isNotNull(), F.greatest(out, F.lit(float(low))))
    if high is not None:
        out = F.when(c.isNotNull(), F.least(out, F.lit(float(high))))
    return out


def log1p_clipped(c: Column) -> Column:
    return F.log1p(clip(c, 0.0))


def mean_of(columns: list[Column], least: int) -> Column:
    """Mean over the columns that are not null, where at least ``least`` are."""
    kept = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(kept) >= least, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def zscore(c: Column, by: WindowSpec, constant: float | None = 0.0, sample: bool = False) -> Column:
    """(x - mean) / sd within a group; ``constant`` stands where the group does not vary."""
    sd = (F.stddev_samp(c) if sample else F.stddev_pop(c)).over(by)
    fixed = F.lit(constant).cast("double")
    return F.when(c.isNotNull(), F.when(sd > EPS, (c - F.avg(c).over(by)) / sd).otherwise(fixed))


def with_aggregates(df: DataFrame, by: list[str], aggregates: list[Column]) -> DataFrame:
    """``df`` with aggregates of its groups joined back; a null key is a group of its own.

    For few large groups: these are reduced before the shuffle and their table is
    broadcast, where a window, or a join by the keys, would gather each group in one
    task.  ``df`` is read twice.
    """
    if not by:
        return df.join(F.broadcast(df.agg(*aggregates)), F.lit(True))
    keys = [f"_by{i}" for i in range(len(by))]
    sums = df.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)]).agg(*aggregates)
    same = F.lit(True)
    for b, k in zip(by, keys):
        same = same & F.col(b).eqNullSafe(F.col(k))
    return df.join(F.broadcast(sums), same).drop(*keys)


def standardised(df: DataFrame, columns: dict[str, Column], by: list[str]) -> DataFrame:
    """Adds z-scores within groups that are few and large, 0 where a group does not vary."""
    moments = [f(c).alias(f"_{k}_{out}") for out, c in columns.items() for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    rows = with_aggregates(df, by, moments)
    z = lambda out, c: F.when(F.col(f"_sd_{out}") > EPS, (c - F.col(f"_mean_{out}")) / F.nullif(F.col(f"_sd_{out}"), F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.withColumns({out: F.when(c.isNotNull(), z(out, c)) for out, c in columns.items()})
    return rows.drop(*[f"_{k}_{out}" for out in columns for k in ("mean", "sd")])


def average_rank(c: Column, by: list[str]) -> Column:
    """Rank with ties sharing their mean; null stays null and does not count."""
    order = Window.partitionBy(*by, c.isNull()).orderBy(c)
    ties = Window.partitionBy(*by, c)
    return F.when(c.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def skill(error: Column, base: Column, floor: float | None = None) -> Column:
    """1 - error / base: missing for a tiny base, or the base clipped at ``floor``."""
    if floor is None:
        return F.when(base > 1e-6, 1 - error / base)
    return 1 - error / clip(base, floor)


def erfc(x: Column) -> Column:
    """The complementary error function by built-in functions, relative error below 2e-11.

    Up to 2.5 the power series of erf, above it the continued fraction from its 80th
    term back; erfc(-x) is 2 - erfc(x).
    """
    a = F.abs(x.cast("double"))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("term"), a.alias("total")),
        lambda s, n: F.struct((-s["term"] * a * a / n).alias("term"), (s["total"] - s["term"] * a * a / n / (2 * n + 1)).alias("total")),
    )["total"]
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), a, lambda t, k: a + k / F.lit(2.0) / t)
    low, high = 1 - F.lit(2 / math.sqrt(math.pi)) * terms, F.exp(-a * a) / (F.lit(math.sqrt(math.pi)) * fraction)
    tail = F.when(a <= 2.5, low).otherwise(F.when(a < 27, high).otherwise(0.0))
    return F.when(x.isNotNull(), F.when(x < 0, 2 - tail).otherwise(tail))


def probit(p: Column) -> Column:
    """The normal quantile, null outside (0, 1): a rational start, then four of Newton's steps with Halley's correction."""
    p = p.cast("double")
    small = F.least(p, 1 - p)
    q = F.sqrt(-2.0 * F.ln(small))
    z = q - (2.30753 + 0.27061 * q) / (1.0 + 0.99229 * q + 0.04481 * q * q)

    def step(x: Column, _: Column) -> Column:  # of the upper tail, where small shares keep their digits
        off = (erfc(x / F.lit(math.sqrt(2.0))) / 2 - small) * F.lit(math.sqrt(2 * math.pi)) * F.exp(x * x / 2)
        return x + off / (1 + x * off / 2)

    upper = F.aggregate(F.sequence(F.lit(1), F.lit(4)), z, step)
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -upper).otherwise(upper))


def fisher_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by Fisher's transform; null below four pairs."""
    z = F.abs(F.atanh(clip(r, -0.999999, 0.999999))) * F.sqrt(n - 3)
    return F.when(r.isNotNull() & (n > 3), erfc(z / F.lit(math.sqrt(2.0))))


def parse_feature(name: Column) -> Column:
    """family, feature, variant and segment of ``family:feature[_norm|_dis]:segment``."""
    part = lambda i: F.try_element_at(F.split(name, ":", 3), F.lit(i))
    raw = part(2)
    variant = F.when(raw.endswith("_norm"), "norm").when(raw.endswith("_dis"), "dis").otherwise("raw")
    return F.struct(part(1).alias("family"), F.regexp_replace(raw, "(_norm|_dis)$", "").alias("feature"), F.when(raw.isNotNull(), variant).alias("variant"), part(3).alias("segment"))


def feature_columns(names: list[str], prefix: str, suffix: str = "") -> list[str]:
    """Columns of one family and segment, without normalised and discretised variants."""
    return [n for n in names if n.startswith(prefix) and n.endswith(suffix) and "_norm:" not in n and "_dis:" not in n]
