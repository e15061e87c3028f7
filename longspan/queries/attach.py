"""Joins that attach histories, moments, sequences and predictions, and what is adjusted by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspan.functions.numeric import skill
from longspan.operators import linear, metrics, splits
from longspan.operators.windows import Trajectory
from longspan.plans import panels, robustness
from longspan.sources import validate

from .base import DAYS, FORECASTS, LABELS, METRICS, PEOPLE, WEEKS, query, r6, rounded
from .robust import KEY, _forecasts, _metrics

T = Trajectory()


@query(f"""WITH {LABELS}, h AS (SELECT cohort, unit, date, lag(qty_sum) OVER (PARTITION BY cohort, unit ORDER BY date) AS yesterday FROM weeks) SELECT cohort, unit, date, label, yesterday FROM labelled LEFT JOIN h USING (cohort, unit, date)""")
def jn04_history_to_samples(spark, d):
    history = panels.supplier_weeks(spark, d).select("cohort", "unit", "date", T.previous(F.col("qty_sum")).alias("yesterday"))
    return panels.labelled_weeks(spark, d).select("cohort", "unit", "date", "label").join(history, ["cohort", "unit", "date"], "left")


@query(f"""WITH {DAYS}, e AS (SELECT cohort, unit, date, n_events AS phq4 FROM days WHERE target = 'click'), l AS (SELECT cohort, unit, date, n_events AS dep FROM days WHERE target = 'error')
SELECT coalesce(e.cohort, l.cohort) AS cohort, coalesce(e.unit, l.unit) AS unit, coalesce(e.date, l.date) AS date, phq4, dep, CASE WHEN dep > 1 THEN 1 WHEN dep IS NOT NULL THEN 0 END AS dep_high FROM e FULL JOIN l ON e.cohort = l.cohort AND e.unit = l.unit AND e.date = l.date""")
def jn07_prj14_momentary_and_weekly(spark, d):
    u = panels.user_days(spark, d)
    side = lambda t, n: u.where(F.col("target") == t).select("cohort", "unit", "date", F.col("n_events").alias(n))
    both = side("click", "phq4").join(side("error", "dep"), ["cohort", "unit", "date"], "full")
    return both.withColumn("dep_high", F.when(F.col("dep") > 1, 1).when(F.col("dep").isNotNull(), 0))


@query(f"""WITH {METRICS}, t AS (SELECT regime, cohort, unit, target, half, round(stddev_pop(observed_log), 6) AS train_sd, round(avg(observed_log), 6) AS train_mean FROM blocks WHERE role = 'train' GROUP BY ALL)
SELECT regime, cohort, unit, target, half, train_sd, train_mean, round(observed_sd, 6) AS observed_sd FROM m LEFT JOIN t USING (regime, cohort, unit, target, half)""")
def jn16_inf22_training_moments(spark, d):
    """Moments of each half's training rows, joined one to one with the half's metrics."""
    long = panels.long(panels.supplier_weeks(spark, d), panels.TARGETS)
    rows = long.where("value IS NOT NULL").withColumn("observed_log", F.log1p(F.greatest("value", F.lit(0.0))))
    rows = rows.withColumn("h", robustness.SERIES.trailing_mean(F.col("observed_log"), 7)).where("h IS NOT NULL")
    train = splits.with_regimes(rows, robustness.SERIES).where("role = 'train'").groupBy(*KEY).agg(r6(F.stddev_pop("observed_log"), "train_sd"), r6(F.avg("observed_log"), "train_mean"))
    return validate.join_one_to_one(_metrics(spark, d).select(*KEY, r6("observed_sd", "observed_sd")), train, KEY, "left")


@query(f"""WITH {METRICS}, s AS (SELECT cohort, unit, count(*) AS n_weeks, max(date) AS last_date FROM weeks GROUP BY ALL) SELECT regime, cohort, unit, target, half, n_obs, n_weeks, last_date FROM m LEFT JOIN s USING (cohort, unit)""")
def jn17_sequences_many_to_one(spark, d):
    s = panels.supplier_weeks(spark, d).groupBy("cohort", "unit").agg(F.count(F.lit(1)).alias("n_weeks"), F.max("date").alias("last_date"))
    return _metrics(spark, d).select(*KEY, "n_obs").join(s, ["cohort", "unit"], "left")


@query(f"""WITH {DAYS}, v AS (SELECT unit, stddev_pop(n_events) FILTER (target = 'click') AS sd_click, stddev_pop(n_events) FILTER (target = 'view') AS sd_view FROM days GROUP BY ALL), {PEOPLE.strip()}
SELECT people.unit, cohort, round(sd_click, 6) AS sd_click, round(sd_view, 6) AS sd_view FROM people LEFT JOIN v ON v.unit = people.unit""")
def jn18_direct_variability(spark, d):
    v = panels.user_days(spark, d).groupBy("unit").pivot("target", ["click", "view"]).agg(F.stddev_pop("n_events"))
    return panels.people(spark, d).select("unit", "cohort").join(v, "unit", "left").select("unit", "cohort", r6("click", "sd_click"), r6("view", "sd_view"))


@query(f"""WITH {LABELS}, p AS (SELECT cohort, unit, date, mean_tax * 5 AS p_positive FROM weeks) SELECT p.cohort, p.unit, p.date, label, p_positive FROM p LEFT JOIN labelled l ON l.cohort = p.cohort AND l.unit = p.unit AND l.date = p.date""")
def jn19_predictions_to_labels(spark, d):
    """Keys are the trajectory and the day; the label comes from one side only."""
    p = panels.supplier_weeks(spark, d).select("cohort", "unit", "date", (F.col("mean_tax") * 5).alias("p_positive"))
    return p.join(panels.labelled_weeks(spark, d).select("cohort", "unit", "date", "label"), ["cohort", "unit", "date"], "left")


@query()
def inf23_many_controls(spark, d):
    """What forecastability keeps beyond five controls, by the pseudo-inverse of summed products."""
    m = _metrics(spark, d).withColumn("c0", (F.col("cohort") == 0).cast("double")).withColumn("c1", (F.col("cohort") == 1).cast("double"))
    out = linear.residual_wide(m.where("regime = 'fixed'"), "forecastability_raw_z", ["observed_sd_z", "observed_entropy_z", "history_skill_z", "c0", "c1"], ["target", "half"], "residual")
    return rounded(out.select(*KEY, "residual"))


@query(f"WITH {FORECASTS}, g AS (SELECT regime, target, half, avg(abs(observed_log - reg_history)) AS h, avg(abs(observed_log - reg_calendar)) AS c FROM pred GROUP BY ALL) SELECT regime, target, half, round(1 - h / greatest(c, 1e-8), 6) AS skill FROM g")
def inf24_prj15_clipped_skill(spark, d):
    o = F.col("observed_log")
    g = _forecasts(spark, d).groupBy("regime", "target", "half").agg(F.avg(F.abs(o - F.col("reg_history"))).alias("h"), F.avg(F.abs(o - F.col("reg_calendar"))).alias("c"))
    return g.select("regime", "target", "half", r6(skill(F.col("h"), F.col("c"), 1e-8), "skill"))


@query(f"""WITH {WEEKS}, p AS (SELECT cohort, unit, count(*) FILTER (qty_sum >= 100) + 1 AS a, count(*) + 2 AS b, median(qty_sum) AS m FROM weeks GROUP BY ALL), c AS (SELECT cohort, median(qty_sum) AS cm FROM weeks GROUP BY ALL)
SELECT cohort, unit, round(a / b::DOUBLE, 6) AS rate, CASE WHEN b >= 12 THEN m ELSE cm END AS typical, a / b::DOUBLE >= 5e-1 AS keep FROM p JOIN c USING (cohort)""")
def extra_smoothed_policy(spark, d):
    """Beta-smoothed rate per unit, a median that falls back to the cohort's, and a policy at one half."""
    w = panels.supplier_weeks(spark, d)
    p = w.groupBy("cohort", "unit").agg((F.count_if(F.col("qty_sum") >= 100) + 1).alias("a"), (F.count(F.lit(1)) + 2).alias("b"), F.median("qty_sum").alias("m"))
    c = w.groupBy("cohort").agg(F.median("qty_sum").alias("cm"))
    rate = F.col("a") / F.col("b")
    return p.join(F.broadcast(c), "cohort").select("cohort", "unit", r6(rate, "rate"), F.when(F.col("b") >= 12, F.col("m")).otherwise(F.col("cm")).alias("typical"), (rate >= 0.5).alias("keep"))


@query()
def mdl15_end_to_end(spark, d):
    """Fit on each unit's earlier labels, score the later ones, summarise over all rows and over units."""
    w = panels.labelled_weeks(spark, d).withColumn("recent", T.trailing_mean(F.col("label").cast("double"), 7, 3))
    fit = linear.logistic(splits.within_unit(w, T, 0.35), ["recent", "mean_tax"], "label").where("role = 'test'").withColumn("all", F.lit(1))
    units = metrics.auroc(fit, "label", "probability", ["cohort", "unit"]).where("auroc IS NOT NULL").agg(F.count(F.lit(1)).alias("n_units"), F.avg("auroc").alias("macro_auroc"), F.stddev_samp("auroc").alias("sd"), F.percentile("auroc", F.lit(0.25)).alias("q25"))
    whole = metrics.auroc(fit, "label", "probability", ["all"]).select("n_positive", "n_negative", "auroc")
    return whole.join(F.broadcast(units), F.lit(True))
