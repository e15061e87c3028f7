"""From forecasts to person-level constructs: errors, skills, z-scores, composites, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.functions.numeric import log1p_clipped, skill, standardised, with_aggregates
from longspan.operators import linear, metrics, ranking, splits
from longspan.operators.windows import Trajectory
from longspan.sources.workspace import written

SERIES = Trajectory(keys=("cohort", "unit", "target"))
HALF = ["regime", "cohort", "unit", "target", "half"]


def forecasts(weeks: DataFrame, targets: list[str], window: int = 7, least: int = 7) -> DataFrame:
    """Test rows of all regimes and targets with two naive forecasts.

    ``reg_history`` is the mean of the preceding rows, ``reg_calendar`` the cohort's
    mean over the regime's training rows.  ``weeks`` has a column for each target and is
    shuffled and sorted once, before it is one row a target; a target's windows go over
    its known rows.  The first ``least`` of these have no history, so places and size
    among the others follow from those among all.  Rows are written once with the blocks
    that they are in as bits; training means are conditional averages, and one join with
    a small table of bits deals test rows to their regimes and gives them their calendar mean.
    """
    parts = int(weeks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: tasks must not be joined by the size of rows that grow later
    rows, series = weeks.repartition(parts, "cohort", "unit").sortWithinPartitions("cohort", "unit", "date"), []
    for c in targets:
        known = Trajectory(extra=(F.col(c).isNull(),))
        rows = rows.withColumn(c, log1p_clipped(F.col(c).cast("double")))
        history = F.avg(c).over(known.rows(-window, -1))
        rows = rows.withColumns({f"_history_{c}": history, f"_at_{c}": known.position() - least, f"_n_{c}": F.count(F.lit(1)).over(known.whole) - least})
        series.append(F.struct(F.lit(c).alias("target"), F.col(c).alias("observed_log"), F.col(f"_history_{c}").alias("reg_history"), F.col(f"_at_{c}").alias("_at"), F.col(f"_n_{c}").alias("_n")))
    rows = rows.select("cohort", "unit", "date", F.inline(F.array(*series))).where(F.col("observed_log").isNotNull() & (F.col("_at") >= 0) & F.lit(least <= window))
    rows = rows.withColumn("_blocks", splits.block_bits(F.col("_at"), F.col("_n")))
    rows = written(rows.drop("_at", "_n"), "history")
    named = [(1 << b, regime, half, role) for b, (regime, half, role, _, _) in enumerate(splits.blocks(F.lit(0)))]
    trained = [
        F.struct(F.lit(regime).alias("regime"), F.lit(half).alias("half"), F.avg(F.when(F.col("_blocks").bitwiseAND(F.lit(bit)) != 0, F.col("observed_log"))).alias("reg_calendar"))
        for bit, regime, half, role in named
        if role == "train"
    ]
    base = rows.groupBy("target", "cohort").agg(F.array(*trained).alias("b")).select("target", "cohort", F.inline("b"))
    tests = [x for x in named if x[3] == "test"]
    inside = [F.shiftright("id", k).bitwiseAND(F.lit(1)) for k in range(len(tests))]
    sets = rows.sparkSession.range(1, 1 << len(tests), 1, 1).select(
        sum((x * bit for x, (bit, *_) in zip(inside, tests)), F.lit(0)).cast("int").alias("_tests"),
        F.explode(F.array(*[F.when(x == 1, F.struct(F.lit(regime).alias("regime"), F.lit(half).alias("half"), F.lit(role).alias("role"))) for x, (_, regime, half, role) in zip(inside, tests)])).alias("b"),
    )
    dealt = written(sets.where("b IS NOT NULL").select("_tests", "b.*").join(F.broadcast(written(base, "calendar")), ["regime", "half"]), "dealt")
    test = rows.withColumn("_tests", F.col("_blocks").bitwiseAND(F.lit(sum(x[0] for x in tests)))).drop("_blocks")
    return test.join(F.broadcast(dealt), ["_tests", "target", "cohort"]).drop("_tests")


#: Bins of the entropy of a trajectory's values.
BINS = 5


def half_metrics(predictions: DataFrame, least: int = 10) -> DataFrame:
    """Errors, spread, entropy, skills and their z-scores for each trajectory, target and half.

    The scale of a target comes from all rows, before short halves are left out; it and
    the bins' edges come from counts of distinct values.  Errors, spread and the counts
    above each inner edge are one aggregate, and the table of a row for each half is written once.
    """
    of = ["regime", "target"]
    p = predictions.select(*HALF, "observed_log", "reg_history", "reg_calendar")
    values = written(ranking.cells(p, "observed_log", of, {"times": F.lit(1)}), "observed-values")
    mean = values.groupBy(*of).agg((F.sum(F.col("times") * F.col("observed_log")) / F.sum("times")).alias("_mean"))
    away = F.col("observed_log") - F.col("_mean")
    scale = values.join(F.broadcast(mean), of).groupBy(*of).agg(F.sqrt(F.sum(F.col("times") * away * away) / F.sum("times")).alias("target_scale"))
    edges = ranking.edges(values, "observed_log", of, BINS, weight="times")
    n_edges = F.size("edges")  # two at most are one bin
    inner = {f"_e{i}": F.when(n_edges > i + 1, F.get("edges", F.lit(i))) for i in range(1, BINS)}
    scales = scale.join(edges, of).select(*of, "target_scale", F.when(n_edges > 2, F.log(n_edges - 1)).otherwise(1.0).alias("_bits"), *[e.alias(k) for k, e in inner.items()])
    scales = written(scales, "target-scales")
    e_h, e_c = (F.abs(F.col("observed_log") - F.col(c)) for c in ("reg_history", "reg_calendar"))
    m = p.join(F.broadcast(scales.select(*of, *inner)), of).groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg(e_h).alias("mae_history"), F.avg(e_c).alias("mae_calendar"), F.stddev_pop("observed_log").alias("observed_sd"),
        *[F.count_if(F.col("observed_log") > F.col(e)).alias(f"_above{e}") for e in inner],
    )
    m = m.where(F.col("n_obs") >= least).join(F.broadcast(scales.select(*of, "target_scale", "_bits")), of)
    above = [F.col("n_obs"), *[F.col(f"_above{e}") for e in inner], F.lit(0)]  # bins are closed on the right
    share = [(above[i] - above[i + 1]) / F.col("n_obs") for i in range(BINS)]
    parts = [F.when(x > 0, x * F.log(x)).otherwise(0.0) for x in share]
    m = m.withColumn("observed_entropy", F.abs(sum(parts[1:], parts[0])) / F.col("_bits")).drop("_bits", *[f"_above{e}" for e in inner])
    m = m.withColumn("forecastability_raw", -F.col("mae_history") / F.nullif(F.col("target_scale"), F.lit(0.0))).withColumn("history_skill", skill(F.col("mae_history"), F.col("mae_calendar")))
    m = written(m, "half-metrics")
    return standardised(m, {f"{c}_z": F.col(c) for c in ("forecastability_raw", "history_skill", "observed_sd", "observed_entropy")}, ["regime", "target", "half"])


def residual_z(m: DataFrame, value: str, controls: list[str], out: str, least: int = 10) -> DataFrame:
    """What a value keeps beyond cohort and controls within (regime, target, half), as z-scores."""
    by = ["regime", "target", "half"]
    r = written(linear.residual(m, value, controls, by, "cohort", "_residual"), "residuals")  # null where a value or a control is
    r = with_aggregates(r, by, [F.count("_residual").alias("_known")])
    r = r.withColumn("_residual", F.when(F.col("_known") >= least, F.col("_residual")))
    return standardised(r, {out: F.col("_residual")}, by).drop("_residual", "_known")


def composites(m: DataFrame, scopes: dict[str, tuple[list[str], int]]) -> DataFrame:
    """Means over a scope's targets for each trajectory and half with enough of them; one aggregate for all scopes."""
    by, values = ["regime", "cohort", "unit", "half"], {"forecastability": "forecastability_raw_z", "history_skill": "history_skill_z", "variability": "observed_sd_z", "entropy": "observed_entropy_z"}
    names = list(dict.fromkeys(t for targets, _ in scopes.values() for t in targets))
    bit = F.lit(None).cast("long")
    for i, t in enumerate(names):
        bit = F.when(F.col("target") == t, F.lit(1 << i).cast("long")).otherwise(bit)
    parts = []
    for scope, (targets, least) in scopes.items():
        inside = F.col("target").isin(*targets)
        seen = F.bit_count(F.bit_or(F.when(inside, bit))).cast("long")  # distinct targets
        parts.append(F.struct(F.lit(scope).alias("scope"), seen.alias("n_targets"), *[F.avg(F.when(inside, F.col(c))).alias(v) for v, c in values.items()], F.lit(least).alias("_least")))
    out = m.groupBy(*by).agg(F.array(*parts).alias("p")).select(*by, F.inline("p")).where("n_targets >= _least")
    return out.select("regime", "scope", "cohort", "unit", "half", "n_targets", *values)


def halves(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Early and late values side by side for keys that have both."""
    picked = lambda v, h: F.first(F.when(F.col("half") == h, F.col(v)), ignorenulls=True).alias(f"{v}_{h}")
    out = df.groupBy(*keys).agg(F.count_distinct("half").alias("_h"), *[picked(v, h) for v in values for h in ("early", "late")])
    return out.where("_h = 2").drop("_h")


def stability_pairs(c: DataFrame, measure: str) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """A row for each regime, scope and trajectory with both halves; the early and late column of each kind."""
    rows = written(halves(c, ["regime", "scope", "cohort", "unit"], [measure, "variability", "entropy"]), "halves")
    columns, specs = {"raw": (f"{measure}_early", f"{measure}_late")}, []
    for kind, controls in (("cohort", []), ("sd", ["variability"]), ("sd_entropy", ["variability", "entropy"])):
        columns[kind] = (f"_{kind}_early", f"_{kind}_late")
        specs += [(f"{measure}_{h}", [f"{x}_{h}" for x in controls], f"_{kind}_{h}") for h in ("early", "late")]
    return linear.residuals(rows, specs, ["regime", "scope"], "cohort"), columns


def stability(c: DataFrame, measure: str) -> DataFrame:
    """Split-half correlation of a composite: as it is, centred in cohorts, and beyond spread or entropy.

    All residuals are columns of one table, so the panel is read and shuffled once.
    """
    by = ["regime", "scope"]
    rows, columns = stability_pairs(c, measure)
    known = lambda x, y: F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    parts = [F.struct(F.lit(k).alias("kind"), known(x, y).alias("n"), metrics.pearson_of(F.col(x), F.col(y), 5).alias("r")) for k, (x, y) in columns.items()]
    return rows.groupBy(*by).agg(F.array(*parts).alias("p")).select(*by, F.inline("p"))


def profiles(m: DataFrame, value: str, targets: list[str], least: int) -> DataFrame:
    """early and late vectors over the targets, for trajectories with ``least`` of them known in both."""
    at = lambda h: F.array(*[F.first(F.when((F.col("half") == h) & (F.col("target") == t), F.col(value)), ignorenulls=True) for t in targets]).alias(h)
    p = m.groupBy("regime", "cohort", "unit").agg(at("early"), at("late"))
    shared = F.size(F.filter(F.zip_with("early", "late", lambda a, b: a.isNotNull() & b.isNotNull()), lambda x: x))
    return p.where(shared >= least)
