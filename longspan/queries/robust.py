"""The forecast-to-construct pipeline, stability, inference and decision gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from longspan.functions.hashing import PRIME, draw_hash, partners_sql, scrambled_sql
from longspan.functions.numeric import fisher_p
from longspan.operators import cluster, draws, linear, metrics, ranking, resample, splits
from longspan.operators.sequence import lz_entropy
from longspan.operators.windows import Trajectory, tomorrow
from longspan.plans import panels, robustness
from longspan.sources.workspace import written

from .base import COMPOSITES, FORECASTS, LABELS, LONG, METRICS, PEOPLE, WEEKS, query, r6, rounded

T = Trajectory()
#: The slot that draw ``draw`` puts at place ``i``, and a stratum's key of the bijection.
SLOT = scrambled_sql("i", scrambled_sql("draw", str(draws.SEED)))
STRATUM = "(('0x' || substr(md5(cohort::VARCHAR), 1, 12))::BIGINT % {p}) AS seed".format(p=PRIME)
#: Draws of intervals and nulls: those of a table of many, and those of a headline number.
DRAWS, HEADLINE_DRAWS = 1_000, 10_000
#: The most distinct values that a median's buffer holds.
MEDIAN_VALUES = 100_000
SCOPES = {"core": (["line_count", "qty_sum", "mean_discount", "mean_tax"], 3), "rich": (panels.TARGETS, 5)}
KEY = ["regime", "cohort", "unit", "target", "half"]


def _forecasts(spark, d):
    """Forecasts of all weekly series."""
    return robustness.forecasts(panels.supplier_weeks(spark, d), panels.TARGETS)


def _metrics(spark, d):
    return robustness.half_metrics(_forecasts(spark, d))


def _composites(spark, d):
    return robustness.composites(_metrics(spark, d), SCOPES)


@query(f"WITH {FORECASTS} SELECT regime, half, target, cohort, count(*) AS n, round(avg(observed_log), 6) AS mean_log, round(avg(reg_history), 6) AS mean_history, round(avg(reg_calendar), 6) AS mean_calendar FROM pred GROUP BY ALL")
def plan_forecast_samples(spark, d):
    return _forecasts(spark, d).groupBy("regime", "half", "target", "cohort").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("observed_log"), "mean_log"), r6(F.avg("reg_history"), "mean_history"), r6(F.avg("reg_calendar"), "mean_calendar"))


NUMBERS = ["mae_history", "mae_calendar", "observed_sd", "observed_entropy", "target_scale", "forecastability_raw", "history_skill", "forecastability_raw_z", "history_skill_z", "observed_sd_z", "observed_entropy_z"]


@query(f"WITH {METRICS} SELECT regime, cohort, unit, target, half, n_obs, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)} FROM m")
def plan_target_half_metrics(spark, d):
    return _metrics(spark, d).select(*KEY, "n_obs", *[r6(c, c) for c in NUMBERS])


@query(f"WITH {COMPOSITES} SELECT regime, scope, cohort, unit, half, n_targets, round(forecastability, 6) AS forecastability, round(history_skill, 6) AS history_skill, round(variability, 6) AS variability, round(entropy, 6) AS entropy FROM comp")
def agg28_composites(spark, d):
    return rounded(_composites(spark, d))


@query(f"""WITH {COMPOSITES} SELECT regime, scope, cohort, unit, round(avg(forecastability), 6) AS person_score FROM comp GROUP BY ALL HAVING count(DISTINCT half) = 2""")
def agg29_person_scores(spark, d):
    c = _composites(spark, d)
    return c.groupBy("regime", "scope", "cohort", "unit").agg(F.count_distinct("half").alias("h"), r6(F.avg("forecastability"), "person_score")).where("h = 2").drop("h")


@query(f"WITH {METRICS} SELECT regime, half, count(*) AS n_target_halves, median(n_obs) AS median_obs, round(avg(n_obs), 6) AS mean_obs, round(median(observed_sd), 6) AS median_sd, round(avg(observed_entropy), 6) AS mean_entropy FROM m GROUP BY ALL")
def agg30_coverage_diagnostics(spark, d):
    """Medians come from counts of distinct values, or by refinement where these are many, never from one buffer of all rows."""
    m, by = written(_metrics(spark, d).select("regime", "half", "n_obs", "observed_sd", "observed_entropy"), "coverage"), ["regime", "half"]
    middle = {c: ranking.shares_of(m, c, by, [0.5], limit=MEDIAN_VALUES).select(*by, F.col("q")[0].alias(name)) for c, name in (("n_obs", "median_obs"), ("observed_sd", "median_sd"))}
    out = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n_target_halves"), r6(F.avg("n_obs"), "mean_obs"), r6(F.avg("observed_entropy"), "mean_entropy"))
    for rows in middle.values():
        out = ranking.join_on(out, rows, by, "left")
    return out.withColumn("median_sd", r6("median_sd"))


@query(f"""WITH {FORECASTS}, e AS (SELECT *, abs(observed_log - reg_calendar) AS err FROM pred), n AS (SELECT *, err / greatest(avg(err) OVER (PARTITION BY regime, target), 1e-8) AS norm FROM e)
SELECT regime, cohort, count(*) AS n_rows, round(avg(norm), 6) AS mean_normalized FROM n GROUP BY ALL""")
def agg31_normalised_calendar_error(spark, d):
    """Errors over their target's mean error; sums of a cohort and target are taken first, so the means are over a small table."""
    e = F.abs(F.col("observed_log") - F.col("reg_calendar"))
    sums = _forecasts(spark, d).groupBy("regime", "target", "cohort").agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("err"), F.count(e).alias("known"))
    w = Window.partitionBy("regime", "target")
    norm = F.col("err") / F.greatest(F.sum("err").over(w) / F.nullif(F.sum("known").over(w), F.lit(0)), F.lit(1e-8))
    return sums.withColumn("norm", norm).groupBy("regime", "cohort").agg(F.sum("n").alias("n_rows"), r6(F.sum("norm") / F.nullif(F.sum("known"), F.lit(0)), "mean_normalized"))


GAIN = """g AS (SELECT regime, target, count(*) AS n_rows, avg(abs(observed_log - reg_calendar)) AS mae_calendar, avg(abs(observed_log - reg_history)) AS mae_history FROM pred GROUP BY ALL)"""


def _gains(spark, d):
    o = F.col("observed_log")
    g = _forecasts(spark, d).groupBy("regime", "target").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(o - F.col("reg_calendar"))).alias("mae_calendar"), F.avg(F.abs(o - F.col("reg_history"))).alias("mae_history"))
    return g.withColumn("gain", 1 - F.col("mae_history") / F.col("mae_calendar"))


@query(f"WITH {FORECASTS}, {GAIN} SELECT regime, target, n_rows, round(mae_calendar, 6) AS mae_calendar, round(mae_history, 6) AS mae_history, round(1 - mae_history / mae_calendar, 6) AS gain FROM g")
def agg32_model_errors(spark, d):
    return rounded(_gains(spark, d))


@query(f"WITH {FORECASTS}, {GAIN} SELECT regime, round(avg(1 - mae_history / mae_calendar), 6) AS mean_gain, count_if(mae_history < mae_calendar) AS n_positive, avg(1 - mae_history / mae_calendar) > 0 AND count_if(mae_history < mae_calendar) >= 4 AS passes FROM g GROUP BY ALL")
def agg33_gat07_gain_gate(spark, d):
    g = _gains(spark, d)
    return g.groupBy("regime").agg(r6(F.avg("gain"), "mean_gain"), F.count_if(F.col("gain") > 0).alias("n_positive"), ((F.avg("gain") > 0) & (F.count_if(F.col("gain") > 0) >= 4)).alias("passes"))


# least-squares residuals with one and with two controls, centred within cohorts
def _resid(value: str, controls: list[str], src: str, by: str, out: str) -> str:
    w, g = f"(PARTITION BY {by}, cohort)", f"(PARTITION BY {by})"
    c = ", ".join(f"{x} - avg({x}) OVER {w} AS c{i}" for i, x in enumerate([value, *controls]))
    if not controls:
        return f"{out} AS (SELECT *, c0 AS resid FROM (SELECT *, {c} FROM {src}))"
    if len(controls) == 1:
        return f"{out} AS (SELECT *, c0 - sum(c0 * c1) OVER {g} / nullif(sum(c1 * c1) OVER {g}, 0) * c1 AS resid FROM (SELECT *, {c} FROM {src}))"
    return f"""{out} AS (SELECT *, c0 - (vv * uy - uv * vy) / nullif(uu * vv - uv * uv, 0) * c1 - (uu * vy - uv * uy) / nullif(uu * vv - uv * uv, 0) * c2 AS resid FROM (
      SELECT *, sum(c1 * c1) OVER {g} AS uu, sum(c2 * c2) OVER {g} AS vv, sum(c1 * c2) OVER {g} AS uv, sum(c1 * c0) OVER {g} AS uy, sum(c2 * c0) OVER {g} AS vy FROM (SELECT *, {c} FROM {src})))"""


USED = "used AS (SELECT * FROM m WHERE history_skill_z IS NOT NULL AND observed_sd_z IS NOT NULL AND observed_entropy_z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY regime, target, half) >= 10)"


@query(f"""WITH {METRICS}, {USED}, {_resid('history_skill_z', ['observed_sd_z', 'observed_entropy_z'], 'used', 'regime, target, half', 'rr')}
SELECT regime, cohort, unit, target, half, round((resid - avg(resid) OVER w) / stddev_pop(resid) OVER w, 5) + 0e0 AS residual_z FROM rr WINDOW w AS (PARTITION BY regime, target, half)""")
def mdl09_inf22_residual_z(spark, d):
    m = robustness.residual_z(_metrics(spark, d), "history_skill_z", ["observed_sd_z", "observed_entropy_z"], "residual_z")
    return m.where("residual_z IS NOT NULL").select(*KEY, (F.round("residual_z", 5) + 0.0).alias("residual_z"))  # no negative zero


HALVES = """wide AS (SELECT regime, scope, cohort, unit, max(forecastability) FILTER (half = 'early') AS fe, max(forecastability) FILTER (half = 'late') AS fl, max(variability) FILTER (half = 'early') AS ve, max(variability) FILTER (half = 'late') AS vl,
  max(entropy) FILTER (half = 'early') AS ee, max(entropy) FILTER (half = 'late') AS el FROM comp GROUP BY ALL HAVING count(DISTINCT half) = 2)"""
R = "round(CASE WHEN count(*) >= 5 THEN covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0) END, 5)"


def _stab(kind: str, ce: list[str], cl: list[str]) -> str:
    e, f = _resid("fe", ce, "wide", "regime, scope", "a"), _resid("fl", cl, "wide", "regime, scope", "b")
    r = R.format(a="a.resid", b="b.resid")
    return f"SELECT regime, scope, '{kind}' AS kind, count(*) AS n, {r} AS r FROM (WITH {e} SELECT * FROM a) a JOIN (WITH {f} SELECT * FROM b) b USING (regime, scope, cohort, unit) GROUP BY regime, scope"


@query(f"""WITH {COMPOSITES}, {HALVES} SELECT regime, scope, 'raw' AS kind, count(*) AS n, {R.format(a='fe', b='fl')} AS r FROM wide GROUP BY regime, scope
UNION ALL {_stab('cohort', [], [])} UNION ALL {_stab('sd', ['ve'], ['vl'])} UNION ALL {_stab('sd_entropy', ['ve', 'ee'], ['vl', 'el'])}""")
def inf07_split_half_stability(spark, d):
    s = robustness.stability(_composites(spark, d), "forecastability")
    return s.select("regime", "scope", "kind", "n", F.round("r", 5).alias("r"))


@query(f"""WITH {COMPOSITES}, {HALVES}, w7 AS (SELECT * FROM wide WHERE unit % 7 <> 0) SELECT regime, scope, count(*) AS n, {R.format(a='fe', b='fl')} AS r FROM w7 GROUP BY regime, scope""")
def inf08_without_repeat_units(spark, d):
    c = _composites(spark, d)
    repeats = c.select("cohort", "unit").distinct().where("unit % 7 = 0")
    kept = robustness.halves(c.join(repeats, ["cohort", "unit"], "left_anti"), ["regime", "scope", "cohort", "unit"], ["forecastability"])
    return metrics.pearson(kept, "forecastability_early", "forecastability_late", ["regime", "scope"]).select("regime", "scope", "n", F.round("r", 5).alias("r"))


PROFILES = """pairs AS (SELECT e.regime, e.cohort, e.unit, e.target, e.forecastability_raw_z AS x, l.forecastability_raw_z AS y FROM m e JOIN m l USING (regime, cohort, unit, target) WHERE e.half = 'early' AND l.half = 'late' AND e.forecastability_raw_z IS NOT NULL AND l.forecastability_raw_z IS NOT NULL),
cosines AS (SELECT regime, cohort, unit, count(*) AS k, sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0) AS cosine FROM pairs GROUP BY ALL HAVING count(*) >= 4)"""


def _profiles(spark, d):
    return robustness.profiles(_metrics(spark, d), "forecastability_raw_z", panels.TARGETS, 4)


@query(f"WITH {METRICS}, {PROFILES} SELECT regime, cohort, unit, round(cosine, 6) AS cosine FROM cosines")
def inf06_jn14_profile_cosine(spark, d):
    return _profiles(spark, d).select("regime", "cohort", "unit", r6(cluster.masked_cosine(F.col("early"), F.col("late")), "cosine"))


DEALT = f"""WITH RECURSIVE u AS (SELECT cohort, unit, cosine FROM cosines WHERE regime = 'fixed'), f AS (SELECT p.* FROM m p SEMI JOIN u USING (cohort, unit) WHERE regime = 'fixed' AND forecastability_raw_z IS NOT NULL),
o AS (SELECT cohort, unit, row_number() OVER (PARTITION BY cohort ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n, {STRATUM} FROM u), {partners_sql('o', HEADLINE_DRAWS, 'cohort')},
d AS (SELECT p.draw, p.cohort, a.unit, b.unit AS other FROM partner p JOIN o a ON a.cohort = p.cohort AND a.i = p.i JOIN o b ON b.cohort = p.cohort AND b.i = p.j),
c AS (SELECT e.cohort, e.unit, l.unit AS other, sum(e.forecastability_raw_z * l.forecastability_raw_z) / sqrt(sum(e.forecastability_raw_z ** 2) * sum(l.forecastability_raw_z ** 2)) AS c FROM f e JOIN f l ON l.cohort = e.cohort AND l.target = e.target WHERE e.half = 'early' AND l.half = 'late' GROUP BY ALL HAVING count(*) >= 4),
n AS (SELECT draw, avg(c) AS c FROM d JOIN c USING (cohort, unit, other) GROUP BY ALL), s AS (SELECT avg(cosine) AS same, count(*) AS n FROM u)
SELECT any_value(s.n) AS n, round(any_value(same), 6) AS same, round(avg(c), 6) AS null_mean, round(any_value(same) - avg(c), 6) AS delta, count(c) AS n_draws, round((count_if(round(c, 9) >= round(same, 9)) + 1) / (count(c) + 1e0), 6) AS p FROM n, s"""


def _dealt(m, n_draws=HEADLINE_DRAWS):
    """Mean cosine of fixed-regime profiles, its null by dealing late profiles within cohorts, the difference and p."""
    profiles = robustness.profiles(m, "forecastability_raw_z", panels.TARGETS, 4)
    p = written(profiles.where("regime = 'fixed'").select("cohort", "unit", "early", "late"), "profiles")
    same = p.agg(F.avg(cluster.masked_cosine(F.col("early"), F.col("late"))).alias("same"), F.count(F.lit(1)).alias("n"))
    null = resample.permuted_profiles(p, n_draws)
    hits = F.count_if(F.round("mean_cosine", 9) >= F.round("same", 9))  # dealing may give a cohort its own order back
    out = null.join(F.broadcast(same), F.lit(True)).groupBy("same", "n").agg(F.avg("mean_cosine").alias("null_mean"), F.count("mean_cosine").alias("n_draws"), ((hits + 1) / (F.count("mean_cosine") + F.lit(1.0))).alias("p"))
    return rounded(out.withColumn("delta", F.col("same") - F.col("null_mean")))


@query(f"WITH {METRICS}, {PROFILES} SELECT * FROM ({DEALT})")
def inf05_profile_permutation(spark, d):
    return _dealt(_metrics(spark, d))


RANK = "CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0 END"
OVERLAP = {"forecastability": "forecastability_raw", "history_skill": "history_skill"}, {"variability": "observed_sd", "entropy": "observed_entropy"}


def _overlap_sql(table: str, by: str, analysis: str, scope: str, suffix: str) -> str:
    """Pearson and Spearman of each predictor with each measure of spread; ranks are of nine digits."""
    short = {**OVERLAP[0], **OVERLAP[1]}
    name = (lambda k: k) if suffix == "person" else (lambda k: short[k] + suffix)
    ranks = ", ".join(f"{name(k)} AS {k}_v, {RANK.format(x=f'round({name(k)}, 9)', by=by)} AS {k}_r" for k in short)
    pairs = " UNION ALL ".join(f"SELECT regime, {scope} AS scope, '{analysis}' AS analysis, '{p}' AS predictor, '{v}' AS measure, count({p}_v + {v}_v) AS n, {R.format(a=f'{p}_v', b=f'{v}_v')} AS pearson_r, {R.format(a=f'{p}_r', b=f'{v}_r')} AS spearman_r FROM ranked GROUP BY ALL" for p in OVERLAP[0] for v in OVERLAP[1])
    return f"SELECT * FROM (WITH ranked AS (SELECT *, {ranks} FROM {table}) {pairs})"


def _overlap(rows, by, analysis, scope, columns):
    ranked = ranking.average_ranks(rows.select(*by, *[F.col(c).alias(k) for k, c in columns.items()]), {f"{k}_r": F.round(k, 9) for k in columns}, by)
    col = F.col
    parts = [
        F.struct(F.lit(p).alias("predictor"), F.lit(v).alias("measure"), F.count(col(p) + col(v)).alias("n"), F.round(metrics.pearson_of(col(p), col(v), 5), 5).alias("pearson_r"), F.round(metrics.pearson_of(col(f"{p}_r"), col(f"{v}_r"), 5), 5).alias("spearman_r"))
        for p in OVERLAP[0]
        for v in OVERLAP[1]
    ]
    return ranked.groupBy(*by).agg(F.array(*parts).alias("p")).select("regime", scope.alias("scope"), F.lit(analysis).alias("analysis"), F.inline("p"))


BOTH_HALVES = "averages AS (SELECT regime, scope, cohort, unit, avg(forecastability) AS forecastability, avg(history_skill) AS history_skill, avg(variability) AS variability, avg(entropy) AS entropy FROM comp GROUP BY ALL HAVING count(DISTINCT half) = 2 AND count(forecastability) = 2 AND count(history_skill) = 2 AND count(variability) = 2 AND count(entropy) = 2)"
FOUR = ["forecastability", "history_skill", "variability", "entropy"]


def _averages(c):
    """A trajectory's means of both halves, where all four composites are known in both."""
    known = F.lit(True)
    for x in FOUR:
        known = known & (F.col(f"n_{x}") == 2)
    a = c.groupBy("regime", "scope", "cohort", "unit").agg(F.count_distinct("half").alias("h"), *[F.avg(x).alias(x) for x in FOUR], *[F.count(x).alias(f"n_{x}") for x in FOUR])
    return a.where((F.col("h") == 2) & known).drop("h", *[f"n_{x}" for x in FOUR])


@query(f"""WITH {COMPOSITES}, {BOTH_HALVES} {_overlap_sql('m', 'regime', 'raw_across_targets', "'target_half_rows'", '')}
UNION ALL {_overlap_sql('m', 'regime', 'within_target_half_standardized', "'target_half_rows'", '_z')} UNION ALL {_overlap_sql('averages', 'regime, scope', 'person_average_composite', 'scope', 'person')}""")
def inf13_variability_overlap(spark, d):
    """How far forecastability and skill go with spread and entropy: raw, as z-scores, and as person averages."""
    m = _metrics(spark, d)
    short = {**OVERLAP[0], **OVERLAP[1]}
    out = _overlap(m, ["regime"], "raw_across_targets", F.lit("target_half_rows"), short)
    out = out.unionByName(_overlap(m, ["regime"], "within_target_half_standardized", F.lit("target_half_rows"), {k: f"{c}_z" for k, c in short.items()}))
    people = _averages(robustness.composites(m, SCOPES))
    return out.unionByName(_overlap(people, ["regime", "scope"], "person_average_composite", F.col("scope"), {k: k for k in FOUR}))


BOOT = f"""b AS (SELECT cohort, unit, balance AS x, s_acct AS y, row_number() OVER (PARTITION BY cohort ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n
   FROM (SELECT cohort, unit, balance, spent AS s_acct FROM people WHERE spent IS NOT NULL AND balance IS NOT NULL)),
   slots AS (SELECT cohort, draw, {SLOT} % n AS i FROM b, range(0, {DRAWS}) t(draw)),
   draws AS (SELECT s.cohort, draw, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS r FROM slots s JOIN b ON b.cohort = s.cohort AND b.i = s.i GROUP BY ALL HAVING count(*) >= 10)"""


def _people_draws(spark, d):
    p = panels.people(spark, d).select("cohort", "unit", F.col("balance").alias("x"), F.col("spent").alias("y"))
    return resample.interval(draws.bootstrap_correlations(p, "x", "y", DRAWS, ["cohort"], ["unit"]), "r", ["cohort"])


@query(f"WITH {PEOPLE}, {BOOT} SELECT cohort, count(r) AS n_draws, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM draws GROUP BY ALL")
def inf01_bootstrap_correlation(spark, d):
    return rounded(_people_draws(spark, d))


def _cluster_sql(n_draws):
    return f"""t AS (SELECT cohort, unit, row_number() OVER (ORDER BY cohort, unit) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT cohort, unit FROM labelled)),
w AS (SELECT draw, j AS i, count(*) AS w FROM (SELECT draw, {SLOT} % n AS j FROM t, range(0, {n_draws}) r(draw)) GROUP BY ALL), k AS (SELECT i, label, kind, dense_rank() OVER (PARTITION BY kind ORDER BY score) AS score FROM (SELECT cohort, unit, label, 'a' AS kind, qty_sum AS score FROM labelled UNION ALL SELECT cohort, unit, label, 'b', mean_tax FROM labelled) JOIN t USING (cohort, unit)),
c AS (SELECT draw, kind, score, sum(w * label)::DOUBLE AS p, sum(w * (1 - label))::DOUBLE AS n FROM k JOIN w USING (i) GROUP BY ALL),
v AS (SELECT draw, kind, p, n, p * (sum(n) OVER (PARTITION BY draw, kind ORDER BY score) - n / 2e0) AS wins FROM c), a AS (SELECT draw, kind, sum(wins) / nullif(sum(p) * sum(n), 0) AS auroc FROM v GROUP BY ALL),
pairs AS (SELECT draw::INT AS draw, max(auroc) FILTER (kind = 'a') AS auroc_a, max(auroc) FILTER (kind = 'b') AS auroc_b FROM a GROUP BY ALL)"""


def _cluster_draws(spark, d, n_draws):
    """The labelled weeks, and the areas of two scores over the same drawn trajectories."""
    w = written(panels.labelled_weeks(spark, d).select("cohort", "unit", "label", "qty_sum", "mean_tax"), "labelled")
    each = draws.cluster_areas(w, ["cohort", "unit"], "label", {"a": "qty_sum", "b": "mean_tax"}, n_draws)
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("auroc"))).alias(f"auroc_{k}")
    return w, each.groupBy("draw").agg(at("a"), at("b")).withColumn("difference", F.col("auroc_a") - F.col("auroc_b"))


@query(f"WITH {LABELS}, {_cluster_sql(200)} SELECT draw, round(auroc_a, 6) AS auroc_a, round(auroc_b, 6) AS auroc_b, round(auroc_a - auroc_b, 6) AS difference FROM pairs")
def inf02_jn22_cluster_bootstrap(spark, d):
    """Areas of two scores and their paired difference over all labelled weeks; trajectories are drawn."""
    return rounded(_cluster_draws(spark, d, 200)[1])


AUC = "(SELECT (sum(p * (upto - n / 2e0)) / (sum(p) * sum(n))) FROM (SELECT p, n, sum(n) OVER (ORDER BY score) AS upto FROM (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM k WHERE kind = '{kind}' GROUP BY score)))"


@query(f"""WITH {LABELS}, {_cluster_sql(HEADLINE_DRAWS)}, q AS (SELECT count(*) AS n_draws, quantile_cont(auroc_a - auroc_b, 0.025) AS low, quantile_cont(auroc_a - auroc_b, 0.975) AS high, avg((auroc_a > auroc_b)::INT) AS share_positive FROM pairs)
SELECT (SELECT count(*) FROM labelled) AS n_rows, (SELECT count(*) FROM t) AS n_clusters, n_draws, round({AUC.format(kind='a')}, 6) AS auroc_a, round({AUC.format(kind='b')}, 6) AS auroc_b, round({AUC.format(kind='a')} - {AUC.format(kind='b')}, 6) AS difference,
round(low, 6) AS low, round(high, 6) AS high, round(share_positive, 6) AS share_positive, CASE WHEN low > 0 THEN 'detectable_positive_increment' WHEN high < 0 THEN 'detectable_negative_difference' ELSE 'no_detectable_increment' END AS decision FROM q""")
def inf02_gat01_paired_increment(spark, d):
    """The difference of two areas with its interval over 10,000 draws of trajectories, and what it decides."""
    w, each = _cluster_draws(spark, d, HEADLINE_DRAWS)
    whole = lambda score: ranking.areas(w, "label", score, []).select("auroc")
    sizes = w.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cohort", "unit").alias("n_clusters"))
    q = each.agg(F.count("difference").alias("n_draws"), F.percentile("difference", F.lit(0.025)).alias("low"), F.percentile("difference", F.lit(0.975)).alias("high"), F.avg((F.col("difference") > 0).cast("double")).alias("share_positive"))
    for row in (sizes, whole("qty_sum").withColumnRenamed("auroc", "auroc_a"), whole("mean_tax").withColumnRenamed("auroc", "auroc_b")):
        q = q.join(F.broadcast(row), F.lit(True))
    decision = F.when(F.col("low") > 0, "detectable_positive_increment").when(F.col("high") < 0, "detectable_negative_difference").otherwise("no_detectable_increment")
    return rounded(q.withColumn("difference", F.col("auroc_a") - F.col("auroc_b")).withColumn("decision", decision))


OUTCOMES, CONSTRUCTS = ["balance", "spent"], ["n_orders", "n_closed"]
TESTS = [(o, c) for o in OUTCOMES for c in CONSTRUCTS]
ABS_R = "abs(covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})))"
PERM = f"""known AS (SELECT cohort, unit, balance, spent, n_orders, n_closed, row_number() OVER (PARTITION BY cohort ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n, {STRATUM} FROM people WHERE spent IS NOT NULL AND balance IS NOT NULL),
{partners_sql('known', DRAWS, 'cohort')}, dealt AS (SELECT p.draw, a.n_orders, a.n_closed, b.balance, b.spent FROM partner p JOIN known a ON a.cohort = p.cohort AND a.i = p.i JOIN known b ON b.cohort = p.cohort AND b.i = p.j),
null_r AS (SELECT draw, greatest({', '.join(ABS_R.format(a=o, b=c) for o, c in TESTS)}) AS r FROM dealt GROUP BY ALL),
obs AS ({' UNION ALL '.join(f"SELECT '{o}' AS outcome, '{c}' AS construct, {ABS_R.format(a=o, b=c)} AS observed FROM known" for o, c in TESTS)})"""


def _largest_null(rows, n_draws, outcomes, constructs):
    """draw, r: the largest absolute correlation of all tests when the outcomes are dealt anew within cohorts."""
    r = resample.permuted_correlations(rows, constructs, outcomes, n_draws, "cohort", ["unit"])
    return r.select("draw", F.round(F.greatest(*[F.abs(c) for c in r.columns if c != "draw"]), 9).alias("r"))


def _max_statistic(spark, d, n_draws):
    p = written(panels.people(spark, d).select("cohort", "unit", *OUTCOMES, *CONSTRUCTS).dropna(subset=OUTCOMES), "people")
    r = lambda o, c: F.round(F.abs(metrics.pearson_of(F.col(o), F.col(c), 5)), 9)
    null = _largest_null(p, n_draws, OUTCOMES, CONSTRUCTS)
    seen = p.agg(F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(c).alias("construct"), r(o, c).alias("observed")) for o, c in TESTS]).alias("t")).select(F.inline("t"))
    b = null.join(F.broadcast(seen), F.lit(True)).groupBy("outcome", "construct", "observed")
    return rounded(b.agg(F.count(F.lit(1)).alias("n_draws"), F.max("r").alias("largest_null"), ((F.count_if(F.col("r") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + F.lit(1.0))).alias("p")))


@query(f"WITH RECURSIVE {PEOPLE}, {PERM} SELECT outcome, construct, count(*) AS n_draws, round(any_value(observed), 6) AS observed, round(max(r), 6) AS largest_null, round((count_if(round(r, 9) >= round(observed, 9)) + 1) / (count(*) + 1e0), 6) AS p FROM null_r, obs GROUP BY outcome, construct")
def inf04_max_statistic_permutation(spark, d):
    """Outcomes dealt anew within cohorts; every test's p is by the largest absolute correlation of all tests."""
    return _max_statistic(spark, d, DRAWS)


@query()
def inf04_max_statistic_full_draws(spark, d):
    """The same with 10,000 draws, as a headline p needs; its SQL is that of 1,000 draws."""
    return _max_statistic(spark, d, HEADLINE_DRAWS)


@query(f"""WITH {LABELS}, k AS (SELECT *, rank() OVER (PARTITION BY cohort, unit ORDER BY mean_tax) + (count(*) OVER (PARTITION BY cohort, unit, mean_tax) - 1) / 2e0 AS rk FROM labelled),
a AS (SELECT cohort, unit, CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(rk * label) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * (count(*) - sum(label))) END AS auroc FROM k GROUP BY cohort, unit),
u AS (SELECT unit, auroc, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n FROM a WHERE auroc IS NOT NULL), s AS (SELECT draw, {SLOT} % n AS i FROM u, range(0, {HEADLINE_DRAWS}) t(draw)), m AS (SELECT draw, avg(auroc) AS mean_auroc FROM s JOIN u USING (i) GROUP BY ALL)
SELECT count(*) AS n_draws, round(quantile_cont(mean_auroc, 0.025), 6) AS low, round(quantile_cont(mean_auroc, 0.975), 6) AS high, quantile_cont(mean_auroc, 0.025) > 5e-1 AND (SELECT avg(auroc) FROM u) >= 55e-2 AS passes FROM m""")
def inf03_gat02_within_unit_auroc(spark, d):
    u = metrics.auroc(panels.labelled_weeks(spark, d), "label", "mean_tax", ["cohort", "unit"]).where("auroc IS NOT NULL").select("unit", "auroc")
    u = written(u, "unit-areas")
    m = draws.bootstrap_sums(u, {"total": F.col("auroc")}, HEADLINE_DRAWS, [], ["unit"]).select((F.col("total") / F.col("n")).alias("m"))
    ci = resample.interval(m, "m", [])
    return ci.join(F.broadcast(u.agg(F.avg("auroc").alias("macro"))), F.lit(True)).select("n_draws", r6("low", "low"), r6("high", "high"), ((F.col("low") > 0.5) & (F.col("macro") >= 0.55)).alias("passes"))


@query()
def inf14_inf15_fisher(spark, d):
    """p and detectable size of each cohort's correlation."""
    r = metrics.pearson(panels.people(spark, d), "balance", "spent", ["cohort"])
    return r.withColumn("p", fisher_p(F.col("r"), F.col("n"))).withColumn("detectable_r", resample.detectable_r(F.col("n")))


#: 21 true areas, from chance up by a hundredth.
AREAS = [round(0.5 + i / 100, 2) for i in range(21)]


@query(f"""WITH {LABELS}, n AS (SELECT unit, sum(label) AS np, count(*) - sum(label) AS nn FROM labelled GROUP BY ALL HAVING sum(label) > 0 AND sum(label) < count(*)), k AS (SELECT unit, np, nn, sim, unnest(range(1, (np + nn + 1)::BIGINT)) AS k FROM n, range(0, 20) t(sim)),
h AS (SELECT *, md5(sim || '|' || unit || '|' || k) AS h FROM k), z AS (SELECT unit, np, nn, sim, (k <= np)::INT AS pos, sqrt(-2 * ln((('0x' || substr(h, 1, 12))::BIGINT + 5e-1) / 281474976710656e0)) * cos(2 * pi() * ((('0x' || substr(h, 13, 12))::BIGINT + 5e-1) / 281474976710656e0)) AS z FROM h),
s AS (SELECT area, sim, unit, np, nn, pos, sum(1 - pos) OVER (PARTITION BY area, sim, unit ORDER BY z + pos * shift) AS below FROM z, (VALUES {', '.join(f'({a!r}e0, {resample.shift_of(a)!r}::DOUBLE)' for a in AREAS)}) g(area, shift)),
u AS (SELECT area, sim, unit, sum(pos * below) / (any_value(np) * any_value(nn))::DOUBLE AS auc FROM s GROUP BY ALL), m AS (SELECT area, sim, round(avg(auc), 9) AS auc FROM u GROUP BY ALL), c AS (SELECT quantile_cont(auc, 0.975) AS critical FROM m WHERE area = 5e-1),
p AS (SELECT area AS true_auc, count(*) AS n, round(avg((auc > critical)::INT), 6) AS power FROM m, c GROUP BY ALL) SELECT *, coalesce(true_auc = (SELECT min(true_auc) FROM p WHERE power >= 8e-1), false) AS first_detected FROM p""")
def inf16_power_curve(spark, d):
    """Share of 20 simulated macro areas above the chance level's 97.5 % quantile, and the first true area of 80 % power."""
    n = panels.labelled_weeks(spark, d).groupBy("unit").agg(F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_negative"))
    return _power(resample.simulate_power(n, AREAS, 20))


@query()
def inf16_power_curve_full_draws(spark, d):
    """The same curve with 20,000 simulations of every area, by exact sampling of the areas themselves."""
    n = panels.labelled_weeks(spark, d).groupBy("unit").agg(F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_negative"))
    return _power(resample.sampled_power(n, AREAS, 20_000))


def _power(sims):
    sims = written(sims.withColumn("mean_auc", F.round("mean_auc", 9)), "power")
    level = sims.where("true_auc = 0.5").agg(F.percentile("mean_auc", F.lit(0.975)).alias("critical"))
    power = sims.join(F.broadcast(level), F.lit(True)).groupBy("true_auc").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("mean_auc") > F.col("critical")).cast("double")), "power"))
    first = power.agg(F.min(F.when(F.col("power") >= 0.8, F.col("true_auc"))).alias("first"))
    return power.join(F.broadcast(first), F.lit(True)).select("true_auc", "n", "power", F.coalesce(F.col("true_auc") == F.col("first"), F.lit(False)).alias("first_detected"))


@query(f"""WITH {PEOPLE}, p AS (SELECT cohort, balance, spent, n_closed FROM people WHERE spent IS NOT NULL AND balance IS NOT NULL AND n_closed IS NOT NULL), z AS (SELECT cohort, balance AS fe, spent AS fl, n_closed AS ve FROM p),
x AS (SELECT *, fe - avg(fe) OVER (PARTITION BY cohort) AS a, fl - avg(fl) OVER (PARTITION BY cohort) AS b, ve - avg(ve) OVER (PARTITION BY cohort) AS c FROM z),
y AS (SELECT a - sum(a * c) OVER () / sum(c * c) OVER () * c AS ra, b - sum(b * c) OVER () / sum(c * c) OVER () * c AS rb FROM x) SELECT count(*) AS n, round(covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)), 6) AS partial_r FROM y""")
def inf09_inf10_mdl07_partial_correlation(spark, d):
    p = panels.people(spark, d).dropna(subset=["balance", "spent", "n_closed"])
    p = linear.residual(linear.residual(p, "balance", ["n_closed"], [], "cohort", "ra"), "spent", ["n_closed"], [], "cohort", "rb")
    return metrics.pearson(p, "ra", "rb", []).select("n", r6("r", "partial_r"))


@query()
def inf11_inf12_repeated_holdout(spark, d):
    """Out-of-sample R2 with and without one more covariate, over stratified holdouts."""
    p = panels.people(spark, d).dropna(subset=["spent"]).select("cohort", "unit", "spent", "balance", "n_orders", "n_closed")
    h = splits.stratified_holdouts(p, "cohort", "unit", 5)
    models = {"base": (["n_closed"], 0.0), "augmented": (["n_closed", "n_orders"], 0.0), "wide": (["n_closed", "n_orders", "balance"], 0.0)}
    fit = metrics.regressions(linear.ridge_models(h, models, "spent", ["rep"]).where("role = 'test'"), "spent", list(models), ["rep"])
    out = fit.groupBy("rep").agg(*[F.max(F.when(F.col("model") == m, F.col("r2"))).alias(m) for m in models])
    return out.withColumn("delta_r2", F.col("augmented") - F.col("base"))


@query(f"""WITH {WEEKS}, z AS (SELECT (SELECT round_even(quantile_cont(qty_sum, 0.5), 3) FROM weeks) AS c), s AS (SELECT cohort, unit, date, (qty_sum > c)::INT AS state, (isodow(date) - 1)::INT AS wd, date - lag(date) OVER (PARTITION BY cohort, unit ORDER BY date) AS gap, lag((qty_sum > c)::INT) OVER (PARTITION BY cohort, unit ORDER BY date) AS prev FROM weeks, z),
t AS (SELECT cohort, unit, prev, state, count(*)::DOUBLE AS c FROM s WHERE gap = 7 GROUP BY ALL), e AS (SELECT cohort, unit, abs(sum(-(c / tot) * ln(c / inside))) / ln(5e0) AS first_order FROM (SELECT *, sum(c) OVER (PARTITION BY cohort, unit) AS tot, sum(c) OVER (PARTITION BY cohort, unit, prev) AS inside FROM t) GROUP BY ALL),
n AS (SELECT cohort, unit, count(*) AS n_days, count_if(gap = 7) AS n_transitions FROM s GROUP BY ALL) SELECT cohort, unit, n_days, n_transitions, round(first_order, 6) AS first_order_entropy FROM n JOIN e USING (cohort, unit)""")
def inf21_inf17_sequence_metrics(spark, d):
    w = panels.supplier_weeks(spark, d)
    mid = ranking.shares_of(w, "qty_sum", [], [0.5]).select(F.bround(F.col("q")[0], 3).alias("c"))
    s = w.join(F.broadcast(mid), F.lit(True)).withColumn("state", (F.col("qty_sum") > F.col("c")).cast("int"))
    moves = T.transitions(s, "state", 7)
    e = metrics.conditional_entropy(moves, "to_state", "from_state", ["cohort", "unit"]).select("cohort", "unit", r6("conditional_entropy", "first_order_entropy"))
    n = s.groupBy("cohort", "unit").agg(F.count(F.lit(1)).alias("n_days")).join(moves.groupBy("cohort", "unit").agg(F.count(F.lit(1)).alias("n_transitions")), ["cohort", "unit"])
    return n.join(e, ["cohort", "unit"])


@query()
def seq01_lz_entropy(spark, d):
    """Match-length entropy of each unit's weekly states."""
    w = panels.supplier_weeks(spark, d)
    e = ranking.edges(w, "qty_sum", []).withColumnRenamed("edges", "ed")
    s = w.join(F.broadcast(e), F.lit(True)).withColumn("state", metrics.bin_of(F.col("qty_sum"), F.col("ed")))
    seq = s.groupBy("cohort", "unit").agg(F.array_sort(F.collect_list(F.struct("date", "state"))).alias("q"))
    return seq.select("cohort", "unit", lz_entropy(F.transform("q", lambda x: x["state"])).alias("lz_entropy"))


TRAITS = ["returned_qty", "open_share", "mean_tax"]
CONTROLS = {"cohort": [], "variability": ["variability", "entropy"]}
GRID = [(s, t, c) for s in CONTROLS for t in TRAITS for c in FOUR[:2]]


def _person_sql(by: str, src: str = "persons") -> str:
    """Every trait and construct less cohort means, and beyond spread and entropy by closed form within ``by``."""
    factor, names = f"(PARTITION BY {by}, cohort)", [*TRAITS, *FOUR]
    centred = ", ".join(f"{c} - avg({c}) OVER {factor} AS c_{c}" for c in names)
    g = f"(PARTITION BY {by})"
    products = ", ".join(f"sum(c_{c} * c_variability) OVER {g} AS u_{c}, sum(c_{c} * c_entropy) OVER {g} AS v_{c}" for c in names)
    beyond = lambda c: f"c_{c} - (v_entropy * u_{c} - u_entropy * v_{c}) / nullif(u_variability * v_entropy - u_entropy ** 2, 0) * c_variability - (u_variability * v_{c} - u_entropy * u_{c}) / nullif(u_variability * v_entropy - u_entropy ** 2, 0) * c_entropy AS variability_{c}"
    kept = [*TRAITS, *FOUR[:2]]
    return f"SELECT cohort, unit, {', '.join(f'c_{c} AS cohort_{c}' for c in kept)}, {', '.join(map(beyond, kept))} FROM (SELECT *, {products} FROM (SELECT *, {centred} FROM {src}))"


PERSONS = f"""{BOTH_HALVES}, traits AS (SELECT cohort, unit, {', '.join(f'avg({t}) AS {t}' for t in TRAITS)} FROM weeks GROUP BY ALL),
persons AS (SELECT 1 AS one, cohort, unit, {', '.join([*TRAITS, *FOUR])} FROM averages JOIN traits USING (cohort, unit) WHERE regime = 'fixed' AND scope = 'core' AND {' AND '.join(f'{t} IS NOT NULL' for t in TRAITS)})"""


def _grid_sql(table: str, group: str, least: int) -> str:
    r = "covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0)"
    return " UNION ALL ".join(f"SELECT '{s}' AS control_set, '{t}' AS trait, '{c}' AS construct, {group} AS part, count(*) AS n, {r.format(a=f'{s}_{t}', b=f'{s}_{c}')} AS r FROM {table} GROUP BY ALL HAVING count(*) >= {least}" for s, t, c in GRID)


def _persons(spark, d, m):
    """Traits, constructs and controls of each trajectory with both halves, written once."""
    means = panels.supplier_weeks(spark, d).groupBy("cohort", "unit").agg(*[F.avg(t).alias(t) for t in TRAITS]).dropna()
    averages = _averages(robustness.composites(m, {"core": SCOPES["core"]})).where("regime = 'fixed'")
    return written(averages.join(means, ["cohort", "unit"]).select("cohort", "unit", *TRAITS, *FOUR), "persons")


def _person_residuals(persons, by, factor):
    specs = [(x, controls, f"{s}_{x}") for s, controls in CONTROLS.items() for x in [*TRAITS, *FOUR[:2]]]
    return linear.residuals(persons, specs, by, factor).select("cohort", "unit", *[name for _, _, name in specs])


def _grid(rows, by, part, least):
    of = lambda s, t, c: F.struct(F.lit(s).alias("control_set"), F.lit(t).alias("trait"), F.lit(c).alias("construct"), metrics.pearson_of(F.col(f"{s}_{t}"), F.col(f"{s}_{c}"), 5).alias("r"))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[of(*x) for x in GRID]).alias("g")).where(F.col("n") >= least)
    return g.select(part.alias("part"), "n", F.inline("g"))


@query(f"""WITH {COMPOSITES}, {PERSONS}, pooled AS ({_person_sql('one')}), own AS ({_person_sql('cohort')}) SELECT control_set, trait, construct, part, n, round(r, 5) AS r FROM ({_grid_sql('pooled', "'pooled'", 5)} UNION ALL {_grid_sql('own', 'cohort::VARCHAR', 6)})""")
def inf09_inf10_partial_grid(spark, d):
    """Partial correlations of traits and constructs under two control sets, pooled (within cohorts) and of each cohort."""
    p = _persons(spark, d, _metrics(spark, d))
    pooled = _grid(_person_residuals(p, [], "cohort"), [], F.lit("pooled"), 5)
    own = _grid(_person_residuals(p, ["cohort"], None), ["cohort"], F.col("cohort").cast("string"), 6)
    return pooled.unionByName(own).withColumn("r", F.round("r", 5))


def _boot_sql(src: str, x: str, y: str) -> str:
    """regime, r, low of a correlation over the rows of ``src``, draws of rows."""
    r = "covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0)"
    return f"""SELECT * FROM (WITH b AS (SELECT regime, {x} AS x, {y} AS y, row_number() OVER (PARTITION BY regime ORDER BY cohort, unit) - 1 AS i, count(*) OVER (PARTITION BY regime) AS n FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    slots AS (SELECT regime, draw, {SLOT} % n AS i FROM b, range(0, {DRAWS}) t(draw)), draws AS (SELECT regime, draw, CASE WHEN count(*) >= 10 THEN {r} END AS r FROM slots JOIN b USING (regime, i) GROUP BY ALL),
    low AS (SELECT regime, quantile_cont(r, 0.025) AS low FROM draws GROUP BY ALL) SELECT regime, {r} AS r, any_value(low) AS low FROM b LEFT JOIN low USING (regime) GROUP BY ALL)"""


def _boot(rows, x, y):
    ci = resample.interval(draws.bootstrap_correlations(rows.select("regime", "cohort", "unit", x, y), x, y, DRAWS, ["regime"], ["cohort", "unit"]), "r", ["regime"])
    return metrics.pearson(rows, x, y, ["regime"]).join(ci.select("regime", "low"), "regime", "left")


H3 = f"""h3r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n, {STRATUM} FROM ({_person_sql('one')})),
h3n AS (SELECT * FROM (WITH RECURSIVE {partners_sql('h3r', DRAWS, 'cohort')}, h3x AS (SELECT p.draw, {', '.join(f'a.variability_{c}' for c in FOUR[:2])}, {', '.join(f'b.variability_{t}' for t in TRAITS)} FROM partner p JOIN h3r a ON a.cohort = p.cohort AND a.i = p.i JOIN h3r b ON b.cohort = p.cohort AND b.i = p.j)
SELECT draw, round(greatest({', '.join(ABS_R.format(a=f'variability_{t}', b=f'variability_{c}') for t in TRAITS for c in FOUR[:2])}), 9) AS r FROM h3x GROUP BY ALL)),
h3o AS (SELECT construct, trait, round(abs(r), 9) AS r FROM ({_grid_sql('h3r', "'pooled'", 5)}) WHERE control_set = 'variability'),
h3 AS (SELECT count_if(r >= 1e-1 AND p < 5e-2) AS h3_tests FROM (SELECT o.construct, o.trait, o.r, (count_if(n.r >= o.r) + 1) / (count(*) + 1e0) AS p FROM h3o o, h3n n GROUP BY ALL))"""


@query(f"""WITH {COMPOSITES}, {HALVES}, {PROFILES}, {PERSONS}, h1 AS ({_boot_sql("(SELECT * FROM wide WHERE scope = 'core' AND regime = 'fixed')", 'fe', 'fl')}), h2 AS ({DEALT}), {H3},
g AS (SELECT coalesce(r >= 3e-1 AND low > 0, false) AS h1_passes, coalesce(delta >= 1e-1 AND p < 5e-2, false) AS h2_passes, h3_tests FROM h1, h2, h3)
SELECT *, CASE WHEN h1_passes AND h2_passes THEN 'stable phenotype' WHEN h1_passes THEN 'stable degree only' ELSE 'not supported' END AS decision FROM g""")
def gat05_phenotype_gate(spark, d):
    """H1: degree is stable (r and its interval); H2: profiles are one's own (difference and p); H3: number of traits that go with it."""
    m = _metrics(spark, d)
    pairs = robustness.halves(robustness.composites(m, {"core": SCOPES["core"]}).where("regime = 'fixed'"), ["regime", "cohort", "unit"], ["forecastability"])
    h1 = _boot(pairs, "forecastability_early", "forecastability_late").select(F.coalesce((F.col("r") >= 0.3) & (F.col("low") > 0), F.lit(False)).alias("h1_passes"))
    h2 = _dealt(m).select(F.coalesce((F.col("delta") >= 0.1) & (F.col("p") < 0.05), F.lit(False)).alias("h2_passes"))
    rows = written(_person_residuals(_persons(spark, d, m), [], "cohort"), "person-residuals")
    traits = [f"variability_{t}" for t in TRAITS]
    null = _largest_null(rows, DRAWS, traits, [f"variability_{c}" for c in FOUR[:2]]).withColumnRenamed("r", "largest")
    seen = _grid(rows, [], F.lit("pooled"), 5).where("control_set = 'variability'").select("trait", "construct", F.round(F.abs("r"), 9).alias("r"))
    tests = null.join(F.broadcast(seen), F.lit(True)).groupBy("trait", "construct", "r").agg(((F.count_if(F.col("largest") >= F.col("r")) + 1) / (F.count(F.lit(1)) + F.lit(1.0))).alias("p"))
    h3 = tests.agg(F.count_if((F.col("r") >= 0.1) & (F.col("p") < 0.05)).alias("h3_tests"))
    g = h1.join(F.broadcast(h2), F.lit(True)).join(F.broadcast(h3), F.lit(True))
    return g.withColumn("decision", F.when(F.col("h1_passes") & F.col("h2_passes"), "stable phenotype").when(F.col("h1_passes"), "stable degree only").otherwise("not supported"))


SKILL_HALVES = "skills_wide AS (SELECT regime, scope, cohort, unit, max(history_skill) FILTER (half = 'early') AS fe, max(history_skill) FILTER (half = 'late') AS fl, max(variability) FILTER (half = 'early') AS ve, max(variability) FILTER (half = 'late') AS vl, max(entropy) FILTER (half = 'early') AS ee, max(entropy) FILTER (half = 'late') AS el FROM comp WHERE scope = 'core' GROUP BY ALL HAVING count(DISTINCT half) = 2)"


@query(f"""WITH {COMPOSITES}, {SKILL_HALVES}, {_resid('fe', ['ve', 'ee'], 'skills_wide', 'regime', 're')}, {_resid('fl', ['vl', 'el'], 'skills_wide', 'regime', 'rl')}, both_resid AS (SELECT re.regime, re.cohort, re.unit, re.resid AS x, rl.resid AS y FROM re JOIN rl USING (regime, cohort, unit)),
raw AS ({_boot_sql('skills_wide', 'fe', 'fl')}), beyond AS ({_boot_sql('both_resid', 'x', 'y')})
SELECT coalesce(bool_and(raw.r >= 3e-1 AND raw.low > 0), false) AS degree_passes, coalesce(bool_and(beyond.r >= 3e-1 AND beyond.low > 0), false) AS residual_degree_passes, count(*) AS n_regimes FROM raw JOIN beyond USING (regime)""")
def gat06_residual_gates(spark, d):
    """Skill must be stable with its interval in all regimes, as it is and beyond cohort, spread and entropy."""
    c = robustness.composites(_metrics(spark, d), {"core": SCOPES["core"]})
    rows, columns = robustness.stability_pairs(c, "history_skill")
    rows = written(rows, "skill-residuals")
    passes = lambda kind, name: _boot(rows, *columns[kind]).select("regime", ((F.col("r") >= 0.3) & (F.col("low") > 0)).alias(name))
    every = lambda name: F.coalesce(F.bool_and(name), F.lit(False)).alias(name)
    return passes("raw", "degree_passes").join(passes("sd_entropy", "residual_degree_passes"), "regime").agg(every("degree_passes"), every("residual_degree_passes"), F.count(F.lit(1)).alias("n_regimes"))


@query(f"WITH {PEOPLE}, {BOOT}, i AS (SELECT cohort, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM draws GROUP BY ALL) SELECT cohort, CASE WHEN low > 0 THEN 'gain' WHEN high < 0 THEN 'loss' ELSE 'undecided' END AS verdict FROM i")
def gat01_interval_gate(spark, d):
    return _people_draws(spark, d).select("cohort", F.when(F.col("low") > 0, "gain").when(F.col("high") < 0, "loss").otherwise("undecided").alias("verdict"))


@query()
def gat06_profile_gates(spark, d):
    """Profiles must be one's own in every regime, for forecastability and skill beyond spread and entropy: difference of 0.1 and p below 0.05."""
    m = _metrics(spark, d)
    controls, rows = ["observed_sd_z", "observed_entropy_z"], None
    for measure in ("forecastability_raw", "history_skill"):
        part = robustness.profiles(robustness.residual_z(m, f"{measure}_z", controls, "residual_z"), "residual_z", panels.TARGETS, 4).withColumn("measure", F.lit(measure))
        rows = part if rows is None else rows.unionByName(part)
    rows = written(rows, "residual-profiles")
    by = ["regime", "measure"]
    same = rows.groupBy(*by).agg(F.avg(cluster.masked_cosine(F.col("early"), F.col("late"))).alias("same"), F.count(F.lit(1)).alias("n"))
    null = ranking.join_on(resample.permuted_profiles(rows, DRAWS, by=tuple(by)), written(same, "same"), by)
    hits = F.count_if(F.round("mean_cosine", 9) >= F.round("same", 9))
    out = null.groupBy(*by, "same", "n").agg(F.avg("mean_cosine").alias("null_mean"), F.count("mean_cosine").alias("n_draws"), ((hits + 1) / (F.count("mean_cosine") + F.lit(1.0))).alias("p"))
    out = written(out.withColumn("delta", F.col("same") - F.col("null_mean")), "profile-tests")
    gate = out.groupBy("measure").agg(F.bool_and((F.col("delta") >= 0.1) & (F.col("p") < 0.05)).alias("profile_gate"))
    return rounded(out.join(F.broadcast(gate), "measure"))  # a row for each measure


LIFT = f"""WITH {LONG}, v AS (SELECT cohort, unit, date, target, ln(1 + greatest(value, 0)) AS today, avg(ln(1 + greatest(value, 0))) OVER w AS recent, count(value) OVER w AS k FROM series WHERE value IS NOT NULL WINDOW w AS (PARTITION BY cohort, unit, target ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
j AS (SELECT a.cohort, a.unit, a.date, a.target, a.today, a.recent, b.today AS y FROM v a JOIN v b ON b.cohort = a.cohort AND b.unit = a.unit AND b.target = a.target AND b.date = a.date + 7 WHERE a.k >= 7),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort, unit, target ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit, target) AS n FROM j), s AS (SELECT *, pos >= least(greatest(1, floor(n * 65e-2)::BIGINT), n - 1) AS test FROM r WHERE n >= 5),
m AS (SELECT target, avg(recent) AS ma, CASE WHEN stddev_pop(recent) > 1e-12 THEN stddev_pop(recent) ELSE 1 END AS sa, avg(today) AS mb, CASE WHEN stddev_pop(today) > 1e-12 THEN stddev_pop(today) ELSE 1 END AS sb, avg(y) AS my FROM s WHERE NOT test GROUP BY ALL),
k AS (SELECT target, test, y, my, (recent - ma) / sa AS a, (today - mb) / sb AS b FROM s JOIN m USING (target)),
c AS (SELECT target, sum(a * a) + 1 AS aa, sum(b * b) + 1 AS bb, sum(a * b) AS ab, sum(a * (y - my)) AS ay, sum(b * (y - my)) AS b_y FROM k WHERE NOT test GROUP BY ALL),
e AS (SELECT target, y, my + ay / aa * a AS h, my + (bb * ay - ab * b_y) / (aa * bb - ab * ab) * a + (aa * b_y - ab * ay) / (aa * bb - ab * ab) * b AS f FROM k JOIN c USING (target) WHERE test),
q AS (SELECT target, count(*) AS n, 1 - sum((y - h) ** 2) / (var_pop(y) * count(*)) AS r2_history, 1 - sum((y - f) ** 2) / (var_pop(y) * count(*)) AS r2_with_today FROM e GROUP BY ALL)"""


@query(f"{LIFT} SELECT 'tomorrow' AS horizon, target, n, round(r2_history, 5) AS r2_history, round(r2_with_today, 5) AS r2_with_today, round(r2_with_today - r2_history, 5) AS lift, bool_or(round(r2_with_today - r2_history, 5) >= 2e-2) OVER () AS passes FROM q")
def gat04_forecast_lift_gate(spark, d):
    """What today's value adds to history in forecasts of the next week; the gate asks for a lift of 0.02 on any target."""
    long = panels.long(panels.supplier_weeks(spark, d), panels.TARGETS).where("value IS NOT NULL").withColumn("today", F.log1p(F.greatest("value", F.lit(0.0))))
    long = long.withColumn("recent", robustness.SERIES.trailing_mean(F.col("today"), 7, 7))
    rows = written(long.select("cohort", "unit", "target", "date", "today", "recent"), "series")
    rows = tomorrow(rows, "today", ["cohort", "unit", "target"], 7).where("recent IS NOT NULL").withColumnRenamed("target_value", "y").drop("target_date")
    rows = splits.floor_split(rows, robustness.SERIES, 0.65, 5)
    fit = linear.ridge_models(rows, {"history": (["recent"], 1.0), "with_today": (["recent", "today"], 1.0)}, "y", ["target"]).where("role = 'test'")
    r = metrics.regressions(fit, "y", ["history", "with_today"], ["target"]).groupBy("target").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("model") == m, F.col("r2"))).alias(f"r2_{m}") for m in ("history", "with_today")])
    lift = F.round(F.col("r2_with_today") - F.col("r2_history"), 5)
    r = written(r.select("target", "n", F.round("r2_history", 5).alias("r2_history"), F.round("r2_with_today", 5).alias("r2_with_today"), lift.alias("lift")), "lifts")
    gate = r.agg(F.bool_or(F.col("lift") >= 0.02).alias("passes"))
    return r.join(F.broadcast(gate), F.lit(True)).withColumn("horizon", F.lit("tomorrow"))


#: Components of the common score, its predictors, and the covariate that both holdout models have.
COMPONENTS, PREDICTORS, COVARIATE, HOLDOUTS = ["spent", "n_orders"], ["balance", "n_closed"], "n_closed", 200
_z = lambda c: f"(({c}) - avg({c}) OVER g) / nullif(stddev_samp({c}) OVER g, 0)"
GATE9 = f"""t AS (SELECT cohort, unit, balance, n_closed, spent, n_orders, ({_z('spent')} + {_z('n_orders')}) / 2 AS common FROM people WHERE spent IS NOT NULL AND n_orders IS NOT NULL AND n_closed IS NOT NULL AND balance IS NOT NULL WINDOW g AS (PARTITION BY cohort)),
c AS (SELECT cohort, unit, n_closed AS raw, common AS y0, balance AS x0, common - avg(common) OVER g AS y, balance - avg(balance) OVER g AS x, n_closed - avg(n_closed) OVER g AS x2, row_number() OVER (PARTITION BY cohort ORDER BY unit) - 1 AS i, count(*) OVER g AS n, {STRATUM}, row_number() OVER (ORDER BY cohort, unit) - 1 AS ai, count(*) OVER () AS an FROM t WINDOW g AS (PARTITION BY cohort)),
a AS (SELECT 2e0 * (1 - (var_samp(z1) + var_samp(z2)) / var_samp(z1 + z2)) AS alpha, covar_pop(z1, z2) / sqrt(var_pop(z1) * var_pop(z2)) AS component_r FROM (SELECT {_z('spent')} AS z1, {_z('n_orders')} AS z2 FROM t WINDOW g AS (PARTITION BY cohort))),
s AS (SELECT draw, {SLOT} % an AS ai FROM (SELECT ai AS i, ai, an FROM c), range(0, {DRAWS}) u(draw)), bo AS (SELECT draw, covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS r FROM s JOIN c USING (ai) GROUP BY ALL),
pn AS (SELECT * FROM (WITH RECURSIVE {partners_sql('c', DRAWS, 'cohort')} SELECT p.draw, round(greatest({', '.join(ABS_R.format(a=f'a.{x}', b='b.y') for x in ('x', 'x2'))}), 9) AS r FROM partner p JOIN c a ON a.cohort = p.cohort AND a.i = p.i JOIN c b ON b.cohort = p.cohort AND b.i = p.j GROUP BY ALL)),
o AS (SELECT covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS r FROM c), co AS (SELECT count_if(r < 0) AS same FROM (SELECT cohort, covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS r FROM c GROUP BY ALL)),
hr AS (SELECT *, row_number() OVER (PARTITION BY rep, cohort ORDER BY ('0x' || substr(md5(rep || '|' || unit), 1, 12))::BIGINT, unit) <= greatest(1, floor(n * 2e-1 + 5e-1)) AS test FROM c, range(0, {HOLDOUTS}) v(rep)),
hm AS (SELECT rep, avg(raw) AS ma, avg(x0) AS mb, avg(y0) AS my FROM hr WHERE NOT test GROUP BY ALL), hk AS (SELECT rep, test, y0 AS y, my, raw - ma AS a, x0 - mb AS b FROM hr JOIN hm USING (rep)),
hc AS (SELECT rep, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * (y - my)) AS ay, sum(b * (y - my)) AS b_y FROM hk WHERE NOT test GROUP BY ALL),
he AS (SELECT rep, 1 - sum((y - my - ay / aa * a) ** 2) / (var_pop(y) * count(*)) AS base, 1 - sum((y - my - (bb * ay - ab * b_y) / (aa * bb - ab * ab) * a - (aa * b_y - ab * ay) / (aa * bb - ab * ab) * b) ** 2) / (var_pop(y) * count(*)) AS more FROM hk JOIN hc USING (rep) WHERE test GROUP BY ALL),
v AS (SELECT alpha, component_r, o.r AS partial_r, (SELECT quantile_cont(r, 0.975) FROM bo) AS high, (SELECT (count_if(pn.r >= round(abs(o.r), 9)) + 1) / (count(*) + 1e0) FROM pn, o) AS p, same, (SELECT median(more - base) FROM he) AS median_delta, (SELECT avg((round(more - base, 9) > 0)::INT) FROM he) AS positive_rate FROM a, o, co)"""


@query(f"""WITH RECURSIVE {PEOPLE}, {GATE9}, d AS (SELECT *, alpha >= 7e-1 AND component_r >= 3e-1 AS h1, partial_r <= -1e-1 AND high < 0 AND p < 5e-2 AS h2, same >= 3 AND median_delta > 0 AND positive_rate >= 7e-1 AS h3 FROM v)
SELECT round(alpha, 6) AS alpha, round(component_r, 6) AS component_r, round(partial_r, 6) AS partial_r, round(high, 6) AS high, round(p, 6) AS p, same AS n_same_direction, round(median_delta, 6) AS median_delta, round(positive_rate, 6) AS positive_rate, h1, h2, h3,
CASE WHEN h1 AND h2 AND h3 THEN 'association supported' WHEN h1 AND h2 THEN 'pooled association only' ELSE 'not supported' END AS decision FROM d""")
def gat09_common_score_gate(spark, d):
    """H1: the components are one score; H2: it goes with the predictor beyond cohorts (interval and largest-statistic p); H3: in most cohorts and out of sample."""
    p = panels.people(spark, d).select("cohort", "unit", *PREDICTORS, *COMPONENTS).dropna()
    moments = p.groupBy("cohort").agg(*[f(c).alias(f"{k}_{c}") for c in COMPONENTS for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    p = ranking.join_on(p, moments, ["cohort"])
    p = p.withColumns({f"z_{c}": (F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)) for c in COMPONENTS}).drop(*[f"{k}_{c}" for c in COMPONENTS for k in "ms"])
    p = p.withColumn("common", sum((F.col(f"z_{c}") for c in COMPONENTS[1:]), F.col(f"z_{COMPONENTS[0]}")) / len(COMPONENTS))
    specs = [(c, [], f"r_{c}") for c in ("common", *PREDICTORS)]
    t = written(linear.residuals(p, specs, [], "cohort"), "common-scores")
    alpha = metrics.cronbach_alpha(t, [f"z_{c}" for c in COMPONENTS], []).select("alpha")
    component = metrics.pearson(t, "z_spent", "z_n_orders", []).select(F.col("r").alias("component_r"))
    main = f"r_{PREDICTORS[0]}"
    partial = metrics.pearson(t, main, "r_common", []).select(F.col("r").alias("partial_r"))
    high = draws.bootstrap_correlations(t, main, "r_common", DRAWS, [], ["cohort", "unit"]).agg(F.percentile("r", F.lit(0.975)).alias("high"))
    null = _largest_null(t, DRAWS, ["r_common"], [f"r_{x}" for x in PREDICTORS])
    tests = null.join(F.broadcast(partial), F.lit(True)).agg(((F.count_if(F.col("r") >= F.round(F.abs("partial_r"), 9)) + 1) / (F.count(F.lit(1)) + F.lit(1.0))).alias("p"))
    same = metrics.pearson(t, main, "r_common", ["cohort"], 2).agg(F.count_if(F.col("r") < 0).alias("n_same_direction"))
    fits = linear.holdout_fits(t, {"base": [COVARIATE], "more": [COVARIATE, PREDICTORS[0]]}, "common", "cohort", "unit", HOLDOUTS)
    delta = fits.select((F.col("more") - F.col("base")).alias("delta"))
    delta = delta.agg(F.median("delta").alias("median_delta"), F.avg((F.round("delta", 9) > 0).cast("double")).alias("positive_rate"))
    out = alpha
    for row in (component, partial, high, tests, same, delta):
        out = out.join(F.broadcast(row), F.lit(True))
    out = out.withColumn("h1", (F.col("alpha") >= 0.7) & (F.col("component_r") >= 0.3)).withColumn("h2", (F.col("partial_r") <= -0.1) & (F.col("high") < 0) & (F.col("p") < 0.05))
    out = out.withColumn("h3", (F.col("n_same_direction") >= 3) & (F.col("median_delta") > 0) & (F.col("positive_rate") >= 0.7))
    decision = F.when(F.col("h1") & F.col("h2") & F.col("h3"), "association supported").when(F.col("h1") & F.col("h2"), "pooled association only").otherwise("not supported")
    return rounded(out.withColumn("decision", decision))


@query("""WITH l AS (SELECT event_type AS target, 'tomorrow' AS horizon, avg(value) / 1e2 - 48e-2 AS lift FROM events GROUP BY ALL) SELECT horizon, bool_or(lift >= 2e-2) AS passes, count_if(lift >= 2e-2) AS n_targets FROM l GROUP BY ALL""")
def agg38_any_target_above_level(spark, d):
    """The rule of an any-target gate over means of events."""
    lift = panels.table(spark, d, "events").groupBy("event_type").agg((F.avg("value") / 100 - 0.48).alias("lift"))
    return lift.groupBy(F.lit("tomorrow").alias("horizon")).agg(F.bool_or(F.col("lift") >= 0.02).alias("passes"), F.count_if(F.col("lift") >= 0.02).alias("n_targets"))


@query(f"""WITH s AS (SELECT *, (date - min(date) OVER (PARTITION BY unit))::INT + 1 AS study_day FROM (SELECT (user_id % 4)::INT AS cohort, user_id AS unit, ts::DATE AS date, event_type AS target FROM events GROUP BY ALL)),
b AS (SELECT cohort, unit, target, br, count_if(study_day <= CASE br WHEN 'preferred' THEN 20 ELSE 10 END) AS a, count_if(study_day > CASE br WHEN 'preferred' THEN 20 ELSE 10 END) AS e FROM s, (VALUES ('preferred'), ('reduced')) t(br) GROUP BY ALL),
n AS (SELECT br AS branch, target, cohort, count_if(a >= 5 AND e >= 3) AS n FROM b GROUP BY ALL), f AS (SELECT branch, target, min(n) >= 5 AND sum(n) >= 40 AS ok FROM n GROUP BY ALL)
SELECT branch, count_if(ok) AS n_families, count_if(ok) >= 3 AS feasible FROM f GROUP BY ALL""")
def gat10_feasibility(spark, d):
    t = Trajectory(keys=("unit",))
    s = panels.user_days(spark, d).withColumn("study_day", t.study_day(1)).withColumn("branch", F.explode(F.array(F.lit("preferred"), F.lit("reduced"))))
    last = F.when(F.col("branch") == "preferred", 20).otherwise(10)
    b = s.groupBy("branch", "cohort", "unit", "target").agg(F.count_if(F.col("study_day") <= last).alias("a"), F.count_if(F.col("study_day") > last).alias("e"))
    n = b.groupBy("branch", "target", "cohort").agg(F.count_if((F.col("a") >= 5) & (F.col("e") >= 3)).alias("n"))
    f = n.groupBy("branch", "target").agg(((F.min("n") >= 5) & (F.sum("n") >= 40)).alias("ok"))
    return f.groupBy("branch").agg(F.count_if("ok").alias("n_families"), (F.count_if("ok") >= 3).alias("feasible"))


@query(f"""WITH {PEOPLE}, g AS (SELECT cohort, covar_pop(balance, n_orders) / nullif(sqrt(var_pop(balance) * var_pop(n_orders)), 0) AS r, count(*) AS n FROM people WHERE balance IS NOT NULL AND n_orders IS NOT NULL GROUP BY ALL)
SELECT bool_and(abs(r) >= 1e-1) AS every_cohort, count_if(r < 0) AS n_negative, median(r) <= 0 AND count_if(r <= 0) >= 3 AND max(r) < 1e-1 AS split_gate FROM g""")
def agg15_cohort_sign_rules(spark, d):
    """Three rules over the signs and sizes of one correlation a cohort."""
    r = metrics.pearson(panels.people(spark, d), "balance", "n_orders", ["cohort"])
    return r.agg(F.bool_and(F.abs("r") >= 0.1).alias("every_cohort"), F.count_if(F.col("r") < 0).alias("n_negative"), ((F.median("r") <= 0) & (F.count_if(F.col("r") <= 0) >= 3) & (F.max("r") < 0.1)).alias("split_gate"))


@query("SELECT draw::INT AS draw, i::INT AS i, ('0x' || substr(md5(draw || '|' || i), 1, 12))::BIGINT AS u FROM range(0, 20) a(draw), range(0, 50) b(i)")
def fn_draw_hash(spark, d):
    g = spark.range(20).select(F.col("id").cast("int").alias("draw")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(49))))
    return g.withColumn("u", draw_hash(F.col("draw"), F.col("i")))
