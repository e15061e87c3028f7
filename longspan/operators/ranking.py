"""Ranks, areas, adjusted p and exact quantiles of groups of any size.

Two levels instead of one window over a group: rows (or counts of distinct values)
are range-partitioned by group and value; a task orders its range, the totals of the
ranges are a small table whose running sums say what lies before each range.  Groups
up to GROUP_ROWS rows, which one task sorts easily, keep the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.numeric import average_rank
from longspan.sources.workspace import written

#: The most rows of a window's key.
GROUP_ROWS = 1_000_000
#: Rows of a table that may be broadcast.
SMALL_ROWS = 200_000


def join_on(df: DataFrame, other: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joined on equal keys, where nulls are equal; a small ``other`` (counted) is broadcast."""
    if other.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        other = F.broadcast(other)
    other = other.withColumnsRenamed({b: f"_of_{b}" for b in by})
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    return df.join(other, same, how).drop(*[f"_of_{b}" for b in by])


def largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    if not by:
        return df.limit(GROUP_ROWS + 1).count()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def ranged(df: DataFrame, by: list[str], order: list[Column | str], name: str = "ranged") -> DataFrame:
    """``df`` written in the order of ``by`` and ``order``, with ``_part`` (range) and ``_place`` (grows along the order).

    The rows of a group in one range are neighbours: their places have no gap.
    """
    keys = [*[F.col(b).asc_nulls_first() for b in by], *order]
    # without keys of its own name AQE may join ranges, which keeps their order
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    return written(rows, name).withColumn("_part", F.shiftright("_place", 33))


def before(ranges: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """by, _part and for each name the sum over all earlier ranges of the group; one row a range and group."""
    totals = written(ranges.groupBy(*by, "_part").agg(*[F.sum(c).alias(k) for k, c in sums.items()]), "range-totals")
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_part", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums])


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum over the rows of its group before it in ``order``."""
    ranges = ranged(df, by, order)
    starts = before(ranges, by, sums).withColumnsRenamed({k: f"_start_{k}" for k in sums})
    w = Window.partitionBy(*by, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.withColumns({k: F.coalesce(F.sum(c).over(w), F.lit(0)) for k, c in sums.items()})
    rows = join_on(rows, starts, [*by, "_part"])
    return rows.withColumns({k: F.col(k) + F.col(f"_start_{k}") for k in sums}).drop("_part", "_place", *[f"_start_{k}" for k in sums])


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``i`` (from 0, in ``order``) and ``n`` (size) within groups; no window over rows, whatever the groups' size."""
    ranges = ranged(df, by, order, "numbered")
    sizes = written(ranges.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")), "range-sizes")
    w = Window.partitionBy(*by)
    starts = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = sizes.select(*by, "_part", (starts - F.col("_first")).alias("_shift"), F.sum("_rows").over(w).alias("n"))
    return join_on(ranges, table, [*by, "_part"]).withColumn("i", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def cells(df: DataFrame, value: str, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """by, ``value`` and sums of each distinct value: reduced before its shuffle, so a frequent value is one row."""
    return df.groupBy(*by, value).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def average_ranks(df: DataFrame, columns: dict[str, Column], by: list[str], limit: int = GROUP_ROWS) -> DataFrame:
    """Adds average ranks under the names in ``columns``; null stays null and does not count."""
    if largest(df, by) <= limit:
        return df.withColumns({name: average_rank(c, by) for name, c in columns.items()})
    for name, c in columns.items():
        values = cells(df.select(*by, c.alias("_v")).where("_v IS NOT NULL"), "_v", by, {"_n": F.lit(1)})
        ranks = running(values, by, ["_v"], {"_before": F.col("_n")})
        ranks = written(ranks.select(*by, "_v", (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(name)), "ranks")
        df = join_on(df.withColumn("_v", c), ranks, [*by, "_v"], "left").drop("_v")
    return df


def areas(df: DataFrame, y: str, score: str, by: list[str], limit: int = GROUP_ROWS, weight: str | None = None) -> DataFrame:
    """n_positive, n_negative and the area under the ROC curve from counts of distinct scores; null for one class.

    ``weight`` is the number of times that a row counts.
    """
    times = F.col(weight) if weight else F.lit(1)
    counts = written(cells(df, score, by, {"_p": F.col(y).cast("long") * times, "_n": (1 - F.col(y).cast("long")) * times}), "score-counts")
    if largest(counts, by) <= limit:
        w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    else:
        counts = running(counts, by, [score], {"_below": F.col("_n")})
    pos, neg = F.sum("_p"), F.sum("_n")
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / F.lit(2.0)))
    return counts.groupBy(*by).agg(pos.alias("n_positive"), neg.alias("n_negative"), F.when((pos > 0) & (neg > 0), wins / F.nullif(pos * neg, F.lit(0)).cast("double")).alias("auroc"))


def adjusted_p(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Adds ``q``, the step-up adjusted p, for groups of any size; null p stays null.

    Equal p have equal q, so distinct values are enough: upwards from the largest, the
    least of p * n / rank, where a value's rank is that of its last row.
    """
    values = cells(df.select(*by, F.col(p).alias("_p")).where("_p IS NOT NULL"), "_p", by, {"_n": F.lit(1)})
    ranks = running(values, by, ["_p"], {"_before": F.col("_n")})
    ranks = join_on(ranks, written(values.groupBy(*by).agg(F.sum("_n").alias("_all")), "sizes"), by)
    raw = ranged(ranks.withColumn("_raw", F.col("_p") * F.col("_all") / (F.col("_before") + F.col("_n"))), by, ["_p"], "raw-p")
    least = written(raw.groupBy(*by, "_part").agg(F.min("_raw").alias("_least")), "range-least")
    later = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_part").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    raw = join_on(raw.withColumn("_own", F.min("_raw").over(inside)), least.select(*by, "_part", F.min("_least").over(later).alias("_later")), [*by, "_part"])
    q = written(raw.select(*by, "_p", F.least("_own", "_later", F.lit(1.0)).alias("q")), "adjusted")
    return join_on(df.withColumn("_p", F.col(p)), q, [*by, "_p"], "left").drop("_p")


# quantiles by refinement

#: Bits of the ordered value that one pass resolves.
DIGIT_BITS = 16


def ordered_bits(c: Column) -> Column:
    """A long that is ordered as the double; -0.0 and 0.0 are equal."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float], interpolate: bool = True, weight: str | None = None) -> DataFrame:
    """by, share, quantile: exact quantiles by selection, in four passes over the values, whatever the groups' size.

    A pass counts, for every group and every prefix that still holds a wanted rank, the
    next 16 bits of the ordered value; the counts say which prefix holds the rank.  No
    buffer holds more than 65,536 counts of a prefix.  ``interpolate`` takes the
    straight line between neighbours, else the value at the upper rank is taken.  Nulls
    and NaN are left out.  ``weight`` is the number of times that a row counts.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w") if weight else F.lit(1).alias("_w"))
    rows = written(cells(rows, "_v", by, {"_w": F.col("_w")}).withColumn("_b", ordered_bits(F.col("_v"))), "ordered")
    sizes = rows.groupBy(*by).agg(F.sum("_w").alias("_n")).where("_n > 0")
    at = F.col("_share") * (F.col("_n") - 1)
    wanted = sizes.withColumn("_share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = wanted.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).select(*by, F.col("_k").alias("_rank"), F.col("_k").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    wanted = written(wanted.distinct(), "wanted")
    for step in range(64 // DIGIT_BITS):
        shift = 64 - DIGIT_BITS * (step + 1)
        own = rows.withColumn("_prefix", F.shiftright("_b", shift + DIGIT_BITS) if step else F.lit(0).cast("long"))
        own = join_on(own, written(wanted.select(*by, "_prefix").distinct(), "prefixes"), [*by, "_prefix"])
        counts = own.groupBy(*by, "_prefix", F.shiftright("_b", shift).alias("_next")).agg(F.sum("_w").alias("_c"), F.first("_v").alias("_value"))
        upto = F.sum("_c").over(Window.partitionBy(*by, "_prefix").orderBy("_next"))
        counts = written(counts.withColumn("_upto", upto), "digits")
        found = join_on(wanted, counts, [*by, "_prefix"]).where((F.col("_left") >= F.col("_upto") - F.col("_c")) & (F.col("_left") < F.col("_upto")))
        wanted = written(found.select(*by, "_rank", (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left"), F.col("_next").alias("_prefix"), "_value"), "wanted")
        wanted, last = wanted.drop("_value"), wanted
    values = last.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_m"))  # two ranks a share at most
    out = join_on(sizes, values, by).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    at = F.col("share") * (F.col("_n") - 1)
    low, high = F.col("_m")[F.floor(at)], F.col("_m")[F.ceil(at)]
    return out.select(*by, "share", (low + (high - low) * (at - F.floor(at)) if interpolate else high).alias("quantile"))


def shares_of(df: DataFrame, value: str, by: list[str], shares: list[float], interpolate: bool = True, limit: int = GROUP_ROWS, weight: str | None = None) -> DataFrame:
    """by, q: the exact quantiles at ``shares``, in their order; a buffer of distinct values where these are few, else refinement.

    Rows are counted by distinct value first (``weight``: a column with counts), so a
    group of any size with few values is few rows.
    """
    counts = cells(df.where(F.col(value).isNotNull()), value, by, {"_times": F.col(weight) if weight else F.lit(1)})
    counts = written(counts, "value-counts")
    if largest(counts, by) <= limit and interpolate:
        return counts.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(s)) for s in shares]), F.col("_times")).alias("q")).where("q IS NOT NULL")
    found = quantiles(counts, value, by, shares, interpolate, "_times").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("share", "quantile"))).alias("m"))
    return found.select(*by, F.array(*[F.col("m")[F.lit(float(s))] for s in shares]).alias("q"))


def edges(df: DataFrame, value: str, by: list[str], parts: int = 5, limit: int = GROUP_ROWS, weight: str | None = None) -> DataFrame:
    """by, edges: distinct edges of equal shares, ascending; one row, of no edges, where there is no value at all."""
    q = shares_of(df, value, by, [i / parts for i in range(parts + 1)], True, limit, weight)
    return q.select(*by, F.array_sort(F.array_distinct("q")).alias("edges"))


def medians(df: DataFrame, columns: list[str], by: list[str], limit: int = GROUP_ROWS) -> DataFrame:
    """by and the exact median of each column (null where it has no value)."""
    if largest(df, by) <= limit:
        return df.groupBy(*by).agg(*[F.median(c).alias(c) for c in columns])
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "_column", "_value")
    found = quantiles(long, "_value", [*by, "_column"], [0.5])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_column") == c, F.col("quantile"))).alias(c) for c in columns])
