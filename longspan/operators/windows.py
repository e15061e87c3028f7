"""Ordered operators within trajectories.

A trajectory is the rows of one key in date order.  All frames are row-based;
where a rule is about calendar days it says so.  Columns of one trajectory share
one shuffle and one sort, however many of these operators are used together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.numeric import EPS


@dataclass(frozen=True)
class Trajectory:
    keys: tuple[str, ...] = ("cohort", "unit")
    order: tuple[str, ...] = ("date",)
    extra: tuple[str, ...] = field(default=())

    @property
    def all(self):
        return Window.partitionBy(*self.keys, *self.extra)

    @property
    def ordered(self):
        return self.all.orderBy(*self.order)

    def rows(self, first: int, last: int):
        return self.ordered.rowsBetween(first, last)

    @property
    def whole(self):
        """All rows, in order: shares the sort of the ordered operators, where ``all`` is a step of its own."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def past(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    def previous(self, c: Column, n: int = 1) -> Column:
        """The value ``n`` rows before, whatever the gap in days."""
        return F.lag(c, n).over(self.ordered)

    def trailing_mean(self, c: Column, k: int, least: int = 7) -> Column:
        """Mean of the ``k`` rows before this one with ``least`` values at least; never this row."""
        w = self.rows(-k, -1)
        return F.when(F.count(c).over(w) >= least, F.avg(c).over(w))

    def trailing_sd(self, c: Column, k: int, least: int = 7) -> Column:
        w = self.rows(-k, -1)
        return F.when(F.count(c).over(w) >= least, F.stddev_samp(c).over(w))

    def leading_mean(self, c: Column, k: int = 7, least: int = 4, following: int = 6) -> Column:
        """Mean of the next ``k`` rows with ``least`` values, where ``following`` rows exist at all."""
        w = self.rows(1, k)
        return F.when(F.lead(F.lit(1), following).over(self.ordered).isNotNull() & (F.count(c).over(w) >= least), F.avg(c).over(w))

    def last_known(self, c: Column) -> Column:
        return F.last(c, ignorenulls=True).over(self.past)

    def days_since_known(self, c: Column) -> Column:
        day = F.col(self.order[0])
        return F.datediff(day, F.last(F.when(c.isNotNull(), day), ignorenulls=True).over(self.past))

    def position(self) -> Column:
        return F.row_number().over(self.ordered) - 1

    def size(self) -> Column:
        return F.count(F.lit(1)).over(self.all)

    def half(self) -> Column:
        return F.when(self.position() < self.size() / F.lit(2.0), "early").otherwise("late")

    def study_day(self, first: int = 0) -> Column:
        day = F.col(self.order[0])
        return F.datediff(day, F.min(day).over(self.all)) + first

    def prior_rate(self, flag: Column, fallback: Column) -> Column:
        """Share of true flags in all earlier rows."""
        return F.coalesce(F.avg(flag.cast("int").cast("double")).over(self.past), fallback)

    def occurrence(self) -> Column:
        """Number of a row among those with equal keys and order."""
        return F.row_number().over(Window.partitionBy(*self.keys, *self.order).orderBy(*self.order, *self.extra))

    def islands(self, df: DataFrame, unit_days: int = 1) -> DataFrame:
        """Adds ``island``: the number of a run of rows exactly ``unit_days`` apart."""
        day = F.col(self.order[0])
        starts = F.when(F.datediff(day, F.lag(day).over(self.ordered)) == unit_days, 0).otherwise(1)
        return df.withColumn("island", F.sum(starts).over(self.ordered))

    def longest_run(self, df: DataFrame, unit_days: int = 1) -> DataFrame:
        """Length and first day of each trajectory's longest run, the earliest of equals."""
        runs = self.islands(df, unit_days).groupBy(*self.keys, "island").agg(F.count(F.lit(1)).alias("run_length"), F.min(self.order[0]).alias("run_start"))
        best = F.max_by(F.struct("run_length", "run_start"), F.struct("run_length", -F.unix_date("run_start")))
        return runs.groupBy(*self.keys).agg(best.alias("best"), F.count(F.lit(1)).alias("n_runs")).select(*self.keys, "best.run_length", "best.run_start", "n_runs")

    def transitions(self, df: DataFrame, state: str, unit_days: int = 1) -> DataFrame:
        """(from_state, to_state) of neighbouring rows ``unit_days`` apart."""
        day = F.col(self.order[0])
        near = F.datediff(day, F.lag(day).over(self.ordered)) == unit_days
        return df.withColumn("from_state", F.when(near, F.lag(state).over(self.ordered))).where("from_state IS NOT NULL").withColumnRenamed(state, "to_state")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], date: str = "date") -> DataFrame:
    """``left`` with the last known ``values`` of another stream (keys, date, values) on earlier days, and the days since.

    Adds ``prior_x`` and ``days_since_x`` for each value.  Both streams are put in one
    order, in which rows of a day stand before the other stream's rows of that day, so
    nothing of the same day is seen; no row of one stream is joined to rows of the other.
    """
    kept = [c for c in left.columns if c not in keys and c != date]
    a = left.select(*keys, date, F.struct(*kept).alias("_left"), F.lit(0).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_v_{v}") for v in values])
    b = right.select(*keys, date, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.lit(1).alias("_side"), *[F.col(v).alias(f"_v_{v}") for v in values])
    w = Window.partitionBy(*keys).orderBy(date, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = {v: F.last(F.when(F.col(f"_v_{v}").isNotNull(), F.struct(F.col(f"_v_{v}").alias("v"), F.col(date).alias("d"))), ignorenulls=True).over(w) for v in values}
    rows = a.unionByName(b).withColumns({f"_k_{v}": c for v, c in known.items()}).where("_side = 0")
    return rows.select(*keys, date, "_left.*", *[x for v in values for x in (F.col(f"_k_{v}")["v"].alias(f"prior_{v}"), F.datediff(date, F.col(f"_k_{v}")["d"]).alias(f"days_since_{v}"))])


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """weekday (Monday 0) and is_weekend."""
    return df.withColumn("weekday", F.weekday(date)).withColumn("is_weekend", F.weekday(date).isin(5, 6))


def tomorrow(df: DataFrame, value: str, keys: list[str], days: int = 1) -> DataFrame:
    """Adds ``target_date`` and ``target_value``: the value exactly ``days`` later; rows without one go."""
    later = df.select(*keys, F.date_sub("date", days).alias("date"), F.col("date").alias("target_date"), F.col(value).alias("target_value"))
    return df.join(later, [*keys, "date"])


def benjamini_hochberg(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Adds ``q``: step-up adjusted p; null p stays null."""
    known = F.col(p).isNull()
    n = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by, known).orderBy(p))
    raw = df.withColumn("_raw", F.when(~known, F.col(p) * n / rank))
    upward = Window.partitionBy(*by, known).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.when(~known, F.least(F.min("_raw").over(upward), F.lit(1.0)))).drop("_raw")


def bonferroni(p: Column, by: list[str]) -> Column:
    return F.least(p * F.count(p).over(Window.partitionBy(*by)), F.lit(1.0))


def first_crossing(df: DataFrame, x: str, y: str, level: float, by: list[str]) -> DataFrame:
    """x before and at the first y that reaches ``level`` on an ordered grid."""
    order = Window.partitionBy(*by).orderBy(x)
    seen = df.withColumn("below", F.lag(x).over(order)).where(F.col(y) >= level)
    return seen.groupBy(*by).agg(F.min_by("below", x).alias("below"), F.min(x).alias("reached"))


__all__ = ["EPS", "Trajectory", "benjamini_hochberg", "bonferroni", "calendar", "first_crossing", "tomorrow"]
