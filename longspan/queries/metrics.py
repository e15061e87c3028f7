"""Aggregates, joins, set operations and reshapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from longspan.functions import numeric
from longspan.operators import metrics, ranking
from longspan.operators.windows import Trajectory
from longspan.plans import panels
from longspan.sources.workspace import written

from .base import DAYS, LABELS, LONG, PEOPLE, WEEKS, query, r6, rounded

T = Trajectory()


@query(f"""WITH {LABELS} SELECT cohort, count(*) AS n_rows, count(DISTINCT unit) AS n_units, sum(label)::BIGINT AS n_positive, round(avg((returned_qty IS NOT NULL)::INT), 6) AS mean_coverage FROM labelled GROUP BY ALL""")
def agg01_cohort_counts(spark, d):
    w = panels.labelled_weeks(spark, d)
    return w.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("unit").alias("n_units"), F.sum("label").alias("n_positive"), r6(F.avg(F.col("returned_qty").isNotNull().cast("int")), "mean_coverage"))


@query(f"WITH {LABELS} SELECT cohort, label, count(*) AS n FROM labelled GROUP BY ALL")
def agg02_label_counts(spark, d):
    return panels.labelled_weeks(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LABELS}, a AS (SELECT w.cohort, w.unit, count(DISTINCT w.date) AS n_days, count(DISTINCT CASE WHEN l.label IS NOT NULL THEN w.date END) AS n_labelled,
 round(avg((w.returned_qty IS NOT NULL)::INT), 6) AS mean_coverage FROM weeks w LEFT JOIN labelled l USING (cohort, unit, date) GROUP BY ALL) SELECT * FROM a""")
def agg03_unit_coverage(spark, d):
    labels = panels.labelled_weeks(spark, d).select("cohort", "unit", "date", "label")
    w = panels.supplier_weeks(spark, d).join(labels, ["cohort", "unit", "date"], "left")
    return w.groupBy("cohort", "unit").agg(F.count_distinct("date").alias("n_days"), F.count_distinct(F.when(F.col("label").isNotNull(), F.col("date"))).alias("n_labelled"), r6(F.avg(F.col("returned_qty").isNotNull().cast("int")), "mean_coverage"))


@query(f"""WITH {DAYS} SELECT cohort, unit, count(*) AS n_rows, count(DISTINCT target) AS n_targets, count(DISTINCT date) AS n_dates, (max(date) - min(date))::INT + 1 AS span_days,
 round(count(*) / greatest(count(DISTINCT target), 1)::DOUBLE, 6) AS rows_per_target, avg(n_events) AS mean_events, min(n_events) AS min_events, max(n_events) AS max_events FROM days GROUP BY ALL""")
def agg04_agg05_trajectory_coverage(spark, d):
    g = panels.user_days(spark, d).groupBy("cohort", "unit").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("target").alias("n_targets"), F.count_distinct("date").alias("n_dates"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("span_days"),
        F.avg("n_events").alias("mean_events"), F.min("n_events").alias("min_events"), F.max("n_events").alias("max_events"),
    )
    return g.withColumn("rows_per_target", r6(F.col("n_rows") / F.greatest(F.col("n_targets"), F.lit(1))))


@query(f"""WITH {WEEKS} SELECT cohort, round(stddev_pop(qty_sum), 6) AS sd_pop, round(stddev_samp(qty_sum), 6) AS sd_sample, median(qty_sum) AS median, quantile_cont(qty_sum, 0.25) AS q25, quantile_cont(qty_sum, 0.75) AS q75,
 list_sort(list(qty_sum))[ceil(9e-1 * (count(*) - 1))::INT + 1] AS q90_higher FROM weeks GROUP BY ALL""")
def agg06_to_09_spread_and_quantiles(spark, d):
    w = written(panels.supplier_weeks(spark, d).select("cohort", "qty_sum"), "quantities")
    spread = w.groupBy("cohort").agg(r6(F.stddev_pop("qty_sum"), "sd_pop"), r6(F.stddev_samp("qty_sum"), "sd_sample"))
    q = ranking.shares_of(w, "qty_sum", ["cohort"], [0.5, 0.25, 0.75]).select("cohort", *[F.col("q")[i].alias(c) for i, c in enumerate(("median", "q25", "q75"))])
    higher = ranking.shares_of(w, "qty_sum", ["cohort"], [0.9], interpolate=False).select("cohort", F.col("q")[0].alias("q90_higher"))
    return spread.join(q, "cohort").join(higher, "cohort")


SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@query(f"""WITH {WEEKS} SELECT cohort, target, unnest({SHARES})::DOUBLE AS share, round(unnest(quantile_cont(value, {SHARES})), 6) AS quantile FROM (UNPIVOT (SELECT cohort, qty_sum, mean_tax, open_share FROM weeks) ON qty_sum, mean_tax, open_share INTO NAME target VALUE value) GROUP BY cohort, target""")
def agg08_agg10_quantiles_by_refinement(spark, d):
    """Seven exact quantiles of every cohort and measure in four passes over the bits of the values, whatever a cohort's size."""
    w = panels.supplier_weeks(spark, d).unpivot(["cohort"], ["qty_sum", "mean_tax", "open_share"], "target", "value")
    return rounded(ranking.quantiles(w, "value", ["cohort", "target"], SHARES))


@query(f"""WITH {WEEKS}, e AS (SELECT list_sort(list_distinct(quantile_cont(qty_sum, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ed FROM weeks)
SELECT cohort, len(list_filter(ed[2:len(ed) - 1], lambda x: x < qty_sum))::INT AS bin, count(*) AS n, round(sum(ed[1] + ed[len(ed)]), 6) AS checks FROM weeks, e GROUP BY ALL""")
def agg10_agg11_quintile_bins(spark, d):
    w = panels.supplier_weeks(spark, d)
    e = ranking.edges(w, "qty_sum", []).withColumnRenamed("edges", "ed")
    b = w.join(F.broadcast(e), F.lit(True)).withColumn("bin", metrics.bin_of(F.col("qty_sum"), F.col("ed")))
    return b.groupBy("cohort", "bin").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.get("ed", F.lit(0)) + F.element_at("ed", -1)), "checks"))


ENTROPY = """e AS (SELECT target, list_sort(list_distinct(quantile_cont(n_events, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ed FROM days GROUP BY ALL),
s AS (SELECT d.*, len(ed) - 1 AS k, CASE WHEN len(ed) > 2 THEN len(list_filter(ed[2:len(ed) - 1], lambda x: x < n_events)) ELSE 0 END AS state, (isodow(date) - 1)::INT AS weekday FROM days d JOIN e USING (target))"""


@query(f"""WITH {DAYS}, {ENTROPY}, c AS (SELECT cohort, unit, target, k, state, count(*)::DOUBLE AS c FROM s GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY cohort, unit, target) AS p FROM c)
SELECT cohort, unit, target, round(abs(sum(p * ln(p))) / CASE WHEN any_value(k) > 1 THEN ln(any_value(k)) ELSE 1e0 END, 6) AS entropy, sum(c)::BIGINT AS n FROM p GROUP BY cohort, unit, target""")
def agg12_binned_entropy(spark, d):
    return rounded(metrics.binned_entropy(panels.user_days(spark, d), "n_events", ["cohort", "unit", "target"], ["target"]))


@query(f"""WITH {DAYS}, {ENTROPY}, c AS (SELECT cohort, unit, target, weekday, state, count(*)::DOUBLE AS c FROM s GROUP BY ALL),
p AS (SELECT *, -(c / sum(c) OVER (PARTITION BY cohort, unit, target)) * ln(c / sum(c) OVER (PARTITION BY cohort, unit, target, weekday)) AS part FROM c)
SELECT cohort, unit, target, round(abs(sum(part)) / ln(5e0), 6) AS conditional_entropy FROM p GROUP BY cohort, unit, target""")
def agg13_conditional_entropy(spark, d):
    u = panels.user_days(spark, d)
    e = ranking.edges(u, "n_events", ["target"]).withColumnRenamed("edges", "ed")
    s = u.join(F.broadcast(e), "target").withColumn("state", metrics.bin_of(F.col("n_events"), F.col("ed"))).withColumn("weekday", F.weekday("date"))
    return rounded(metrics.conditional_entropy(s, "state", "weekday", ["cohort", "unit", "target"]))


@query(f"""WITH {WEEKS}, a AS (SELECT cohort, unit, median(qty_sum) AS mid, quantile_cont(qty_sum, 0.75) - quantile_cont(qty_sum, 0.25) AS iqr FROM weeks GROUP BY ALL),
b AS (SELECT cohort, unit, mid AS median, any_value(iqr) AS iqr, median(abs(qty_sum - mid)) AS mad FROM weeks JOIN a USING (cohort, unit) GROUP BY ALL)
SELECT *, round(greatest(iqr, 14826e-4 * mad), 6) AS scale, greatest(iqr, 14826e-4 * mad) <= 1e-6 * greatest(1e0, abs(median)) AS degenerate FROM b""")
def agg14_robust_scale(spark, d):
    return rounded(metrics.robust_scale(panels.supplier_weeks(spark, d), "qty_sum", ["cohort", "unit"]))


@query(f"""WITH {WEEKS} SELECT cohort, unit, count(*) AS n, round(CASE WHEN count(*) >= 10 AND sqrt(var_pop(qty_sum) * var_pop(returned_qty)) * count(*) > 1e-12 THEN covar_pop(qty_sum, returned_qty) / nullif(sqrt(var_pop(qty_sum) * var_pop(returned_qty)), 0) END, 6) AS r
FROM weeks WHERE returned_qty IS NOT NULL GROUP BY ALL""")
def agg15_agg16_pearson(spark, d):
    return rounded(metrics.pearson(panels.supplier_weeks(spark, d), "qty_sum", "returned_qty", ["cohort", "unit"], 10))


@query(f"WITH {WEEKS} SELECT cohort, count(*) AS n_rows, count_if(returned_qty IS NOT NULL AND NOT isnan(ln(mean_tax + 1e-3) / mean_tax) AND mean_tax > 0) AS n_pairs FROM weeks GROUP BY ALL")
def flt06_finite_pairs(spark, d):
    """Pairs of which both are numbers; a NaN counts as none."""
    x = F.when(F.col("mean_tax") > 0, F.log(F.col("mean_tax") + 0.001) / F.nullif(F.col("mean_tax"), F.lit(0.0))).otherwise(F.lit(float("nan")))
    w = panels.supplier_weeks(spark, d).withColumn("x", x)
    return w.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(metrics.finite("returned_qty") & metrics.finite("x")).alias("n_pairs"))


@query(f"""WITH {WEEKS}, k AS (SELECT cohort, CASE WHEN returned_qty IS NOT NULL THEN rank() OVER (PARTITION BY cohort, returned_qty IS NULL ORDER BY returned_qty) + (count(*) OVER (PARTITION BY cohort, returned_qty) - 1) / 2e0 END AS a,
 rank() OVER (PARTITION BY cohort ORDER BY mean_tax) + (count(*) OVER (PARTITION BY cohort, mean_tax) - 1) / 2e0 AS b FROM weeks)
SELECT cohort, count(*) AS n, round(covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)), 6) AS rho FROM k WHERE a IS NOT NULL GROUP BY ALL""")
def agg17_spearman(spark, d):
    return rounded(metrics.spearman(panels.supplier_weeks(spark, d), "returned_qty", "mean_tax", ["cohort"]))


@query(f"""WITH {PEOPLE}, c AS (SELECT * FROM people WHERE n_orders IS NOT NULL AND spent IS NOT NULL AND n_closed IS NOT NULL)
SELECT cohort, count(*) AS n, round(15e-1 * (1 - (var_samp(n_orders) + var_samp(spent) + var_samp(n_closed)) / nullif(var_samp(n_orders + spent + n_closed), 0)), 6) AS alpha FROM c GROUP BY ALL""")
def agg18_cronbach_alpha(spark, d):
    return rounded(metrics.cronbach_alpha(panels.people(spark, d), ["n_orders", "spent", "n_closed"], ["cohort"]))


@query(f"""WITH {PEOPLE}, z AS (SELECT unit, (balance - avg(balance) OVER w) / stddev_samp(balance) OVER w AS a, (n_orders - avg(n_orders) OVER w) / stddev_samp(n_orders) OVER w AS b,
 (spent - avg(spent) OVER w) / stddev_samp(spent) OVER w AS c, (n_closed - avg(n_closed) OVER w) / stddev_samp(n_closed) OVER w AS e FROM people WINDOW w AS (PARTITION BY cohort))
SELECT unit, round(CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (e IS NOT NULL)::INT >= 3
 THEN (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(e, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (e IS NOT NULL)::INT) END, 6) AS common_score FROM z""")
def agg19_row_mean_composite(spark, d):
    by = Window.partitionBy("cohort")
    parts = [numeric.zscore(F.col(c), by, None, sample=True) for c in ("balance", "n_orders", "spent", "n_closed")]
    p = panels.people(spark, d).select("unit", *[c.alias(f"z{i}") for i, c in enumerate(parts)])
    return p.select("unit", r6(numeric.mean_of([F.col(f"z{i}") for i in range(4)], 3), "common_score"))


@query(f"""WITH {WEEKS}, f AS (SELECT *, avg(qty_sum) OVER (PARTITION BY cohort, unit ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS fit FROM weeks), g AS (SELECT * FROM f WHERE fit IS NOT NULL)
SELECT cohort, count(*) AS n, round(avg(abs(qty_sum - fit)), 6) AS mae, round(CASE WHEN var_pop(qty_sum) * count(*) > 1e-12 THEN 1 - sum((qty_sum - fit) ** 2) / (var_pop(qty_sum) * count(*)) END, 6) AS r2,
 round(covar_pop(qty_sum, fit) / sqrt(var_pop(qty_sum) * var_pop(fit)), 6) AS r FROM g GROUP BY ALL""")
def agg20_agg21_regression_metrics(spark, d):
    w = panels.supplier_weeks(spark, d).withColumn("fit", T.trailing_mean(F.col("qty_sum"), 7, 1))
    return rounded(metrics.regression(w, "qty_sum", "fit", ["cohort"]))


AUROC = """k AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {s}) + (count(*) OVER (PARTITION BY {by}, {s}) - 1) / 2e0 AS rk FROM {t}),
a AS (SELECT {by}, sum(label)::BIGINT AS n_positive, (count(*) - sum(label))::BIGINT AS n_negative,
 CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(rk * label) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * (count(*) - sum(label)))::DOUBLE END AS auroc FROM k GROUP BY {by})"""


@query(f"WITH {LABELS}, " + AUROC.format(by="cohort", s="qty_sum", t="labelled") + " SELECT cohort, n_positive, n_negative, round(auroc, 6) AS auroc FROM a")
def agg22_auroc(spark, d):
    return rounded(metrics.auroc(panels.labelled_weeks(spark, d), "label", "qty_sum", ["cohort"]))


@query("""WITH s AS (SELECT lang AS cohort, source AS cluster, n_chars::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id)), """ + AUROC.format(by="cohort", s="score", t="s") + " SELECT cohort, n_positive, n_negative, round(auroc, 6) AS auroc FROM a")
def agg22_auroc_of_documents(spark, d):
    return rounded(metrics.auroc(panels.scored_documents(spark, d), "label", "score", ["cohort"]))


@query(f"""WITH {LABELS}, s AS (SELECT cohort, label AS y, (open_share * 4e-1 + mean_tax * 5 >= 5e-1)::INT AS hit FROM labelled), c AS (SELECT cohort, count_if(y=1 AND hit=1)::DOUBLE AS tp, count_if(y=0 AND hit=1)::DOUBLE AS fp, count_if(y=1 AND hit=0)::DOUBLE AS fn, count_if(y=0 AND hit=0)::DOUBLE AS tn FROM s GROUP BY ALL)
SELECT cohort, (tp+fp+fn+tn)::BIGINT AS n, round((tp+tn)/(tp+fp+fn+tn), 6) AS accuracy, round((tp/(tp+fn) + tn/(tn+fp))/2, 6) AS balanced_accuracy, round((coalesce(2*tp/nullif(2*tp+fp+fn,0),0) + coalesce(2*tn/nullif(2*tn+fp+fn,0),0))/2, 6) AS macro_f1 FROM c""")
def agg23_classification_metrics(spark, d):
    w = panels.labelled_weeks(spark, d).withColumn("score", F.col("open_share") * 0.4 + F.col("mean_tax") * 5)
    return rounded(metrics.classification(w, "label", "score", ["cohort"]))


@query(f"WITH {LABELS}, " + AUROC.format(by="cohort, unit", s="mean_discount", t="labelled") + """, u AS (SELECT * FROM a WHERE auroc IS NOT NULL AND n_positive + n_negative >= 2)
SELECT cohort, count(*) AS n_units, round(avg(auroc), 6) AS macro_auroc, round(stddev_samp(auroc), 6) AS sd_auroc, round(quantile_cont(auroc, 0.25), 6) AS q25, round(sum(auroc * n_positive * n_negative) / sum(n_positive * n_negative), 6) AS pair_weighted FROM u GROUP BY ALL""")
def agg24_to_26_per_unit_auroc(spark, d):
    u = metrics.auroc(panels.labelled_weeks(spark, d), "label", "mean_discount", ["cohort", "unit"]).where("auroc IS NOT NULL AND n_positive + n_negative >= 2")
    w = F.col("n_positive") * F.col("n_negative")
    return u.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_units"), r6(F.avg("auroc"), "macro_auroc"), r6(F.stddev_samp("auroc"), "sd_auroc"), r6(F.percentile("auroc", F.lit(0.25)), "q25"), r6(F.sum(F.col("auroc") * w) / F.sum(w), "pair_weighted"))


@query(f"WITH {LABELS}, n AS (SELECT cohort, unit, count_if(label = 1) AS n_positive, count_if(label = 0) AS n_negative FROM labelled GROUP BY ALL) SELECT cohort, n_positive, n_negative, n_positive * n_negative AS n_pairs, count(*) AS n_units FROM n GROUP BY ALL")
def agg27_count_distribution(spark, d):
    n = panels.labelled_weeks(spark, d).groupBy("cohort", "unit").agg(F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_negative"))
    return n.groupBy("cohort", "n_positive", "n_negative", (F.col("n_positive") * F.col("n_negative")).alias("n_pairs")).agg(F.count(F.lit(1)).alias("n_units"))


@query(f"""WITH {DAYS}, s AS (SELECT *, date - min(date) OVER (PARTITION BY unit) + 1 AS study_day FROM days), b AS (SELECT cohort, unit, target, count_if(study_day BETWEEN 1 AND 15) AS adapt, count_if(study_day BETWEEN 16 AND 30) AS evaluate FROM s GROUP BY ALL)
SELECT target, cohort, count_if(adapt >= 3 AND evaluate >= 3) AS n_eligible, count(*) AS n_units FROM b GROUP BY ALL""")
def agg34_branch_eligibility(spark, d):
    t = Trajectory(keys=("unit",))
    u = panels.user_days(spark, d).withColumn("study_day", t.study_day(1))
    b = u.groupBy("cohort", "unit", "target").agg(F.count_if(F.col("study_day").between(1, 15)).alias("adapt"), F.count_if(F.col("study_day").between(16, 30)).alias("evaluate"))
    return b.groupBy("target", "cohort").agg(F.count_if((F.col("adapt") >= 3) & (F.col("evaluate") >= 3)).alias("n_eligible"), F.count(F.lit(1)).alias("n_units"))


@query("""WITH k AS (SELECT DISTINCT (event_id % 3)::INT AS cohort, user_id AS unit FROM events), u AS (SELECT unit, count(*) AS n FROM k GROUP BY ALL)
SELECT (SELECT count(*) FROM k) AS n_keys, count(*) AS n_units, count_if(n > 1) AS in_several, max(n) AS most_cohorts FROM u""")
def agg35_identity_audit(spark, d):
    k = panels.table(spark, d, "events").select((F.col("event_id") % 3).cast("int").alias("cohort"), F.col("user_id").alias("unit")).distinct()
    u = k.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return u.agg(F.sum("n").alias("n_keys"), F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("n") > 1).alias("in_several"), F.max("n").alias("most_cohorts"))


@query(f"""WITH {LABELS}, s AS (SELECT *, ('seed' || (unit % 3)) AS seed FROM labelled), v AS (SELECT cohort, seed, avg(mean_tax) FILTER (label = 1) - avg(mean_tax) FILTER (label = 0) AS delta FROM s GROUP BY ALL)
SELECT cohort, round(median(delta), 8) AS median_delta, round(min(delta), 8) AS min_delta, round(max(delta), 8) AS max_delta, count_if(delta <= 0) AS n_nonpositive, median(delta) <= 0 AND max(delta) < 1e-2 AS passes FROM v GROUP BY ALL""")
def agg36_contrast_summary(spark, d):
    w = panels.labelled_weeks(spark, d).withColumn("seed", F.concat(F.lit("seed"), F.col("unit") % 3))
    v = w.groupBy("cohort", "seed").agg((F.avg(F.when(F.col("label") == 1, F.col("mean_tax"))) - F.avg(F.when(F.col("label") == 0, F.col("mean_tax")))).alias("delta"))
    m = F.median("delta")
    return v.groupBy("cohort").agg(F.round(m, 8).alias("median_delta"), F.round(F.min("delta"), 8).alias("min_delta"), F.round(F.max("delta"), 8).alias("max_delta"), F.count_if(F.col("delta") <= 0).alias("n_nonpositive"), ((m <= 0) & (F.max("delta") < 0.01)).alias("passes"))


@query(f"""WITH {LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort, unit ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit) AS n FROM labelled)
SELECT CASE WHEN pos >= least(greatest(1, floor(n * 65e-2)::BIGINT), n - 1) THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(avg(label), 6) AS prevalence FROM r WHERE n >= 4 GROUP BY ALL""")
def agg37_prevalence_by_split(spark, d):
    from longspan.operators import splits

    return splits.floor_split(panels.labelled_weeks(spark, d), T).groupBy("role").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("label"), "prevalence"))


@query("""WITH p AS (SELECT (event_id % 2)::INT AS half, CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'evening' END AS issue_time, event_type, avg(value) AS lift FROM events GROUP BY ALL)
SELECT half, issue_time, count(*) AS n_targets, round(avg(lift), 6) AS mean_lift, round(max(lift), 6) AS max_lift, count_if(lift > 5e1) AS n_positive FROM p GROUP BY ALL""")
def agg38_lift_summary(spark, d):
    e = panels.table(spark, d, "events")
    p = e.groupBy((F.col("event_id") % 2).cast("int").alias("half"), F.when(F.hour("ts") < 12, "morning").otherwise("evening").alias("issue_time"), "event_type").agg(F.avg("value").alias("lift"))
    return p.groupBy("half", "issue_time").agg(F.count(F.lit(1)).alias("n_targets"), r6(F.avg("lift"), "mean_lift"), r6(F.max("lift"), "max_lift"), F.count_if(F.col("lift") > 50).alias("n_positive"))


@query(f"""WITH {PEOPLE}, t AS (SELECT platform AS a, coalesce(n_closed, -1)::INT % 3 AS b, count(*) AS n FROM people GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2e0) FROM t) AS both_n, (SELECT sum(x * (x - 1) / 2e0) FROM (SELECT a, sum(n) AS x FROM t GROUP BY a)) AS l, (SELECT sum(x * (x - 1) / 2e0) FROM (SELECT b, sum(n) AS x FROM t GROUP BY b)) AS r, (SELECT sum(n) * (sum(n) - 1) / 2e0 FROM t) AS t)
SELECT round((both_n - l * r / t) / ((l + r) / 2 - l * r / t), 6) AS ari FROM s""")
def agg39_adjusted_rand(spark, d):
    p = panels.people(spark, d).select(F.col("platform").alias("a"), (F.coalesce("n_closed", F.lit(-1.0)).cast("int") % 3).alias("b"))
    return rounded(metrics.adjusted_rand(p, "a", "b", []))


@query(f"""WITH {PEOPLE}, k AS (SELECT c::INT AS cluster FROM range(0, 7) t(c)), n AS (SELECT (coalesce(n_closed, 0))::INT % 5 AS cluster, count(*) AS n FROM people GROUP BY ALL)
SELECT cluster, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / sum(n) OVER (), 6) AS share FROM k LEFT JOIN n USING (cluster)""")
def agg40_cluster_prevalence(spark, d):
    n = panels.people(spark, d).groupBy((F.coalesce("n_closed", F.lit(0.0)).cast("int") % 5).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    k = spark.range(7).select(F.col("id").cast("int").alias("cluster")).join(n, "cluster", "left").fillna({"n": 0})
    whole = n.agg(F.sum("n").alias("all"))
    return k.join(F.broadcast(whole), F.lit(True)).select("cluster", "n", r6(F.col("n") / F.col("all"), "share"))


@query(f"""WITH {DAYS}, a AS (SELECT cohort, unit, date, n_events AS steps FROM days WHERE target = 'click'), b AS (SELECT cohort, unit, date, n_events AS sleep FROM days WHERE target = 'view'),
l AS (SELECT DISTINCT cohort, unit, date, TRUE AS label FROM days WHERE target = 'error'), p AS (SELECT DISTINCT unit, CASE WHEN unit % 2 = 0 THEN 'ios' ELSE 'android' END AS platform FROM days)
SELECT coalesce(a.cohort, b.cohort) AS cohort, coalesce(a.unit, b.unit) AS unit, coalesce(a.date, b.date) AS date, steps AS steps__n, sleep AS sleep__n, coalesce(l.label, FALSE) AS label_available, p.platform,
 ((steps IS NOT NULL)::INT + (sleep IS NOT NULL)::INT) / 2e0 AS feature_coverage
FROM a FULL JOIN b ON a.cohort = b.cohort AND a.unit = b.unit AND a.date = b.date LEFT JOIN l ON l.unit = coalesce(a.unit, b.unit) AND l.date = coalesce(a.date, b.date) LEFT JOIN p ON p.unit = coalesce(a.unit, b.unit)""")
def jn01_to_jn03_src08_person_days(spark, d):
    from longspan.sources.ingest import person_days

    u = panels.user_days(spark, d)
    family = lambda t: u.where(F.col("target") == t).select("cohort", "unit", "date", F.col("n_events").alias("n"))
    weekly = u.where("target = 'error'").select("cohort", "unit", "date", F.lit(True).alias("label_available"))
    platforms = u.select("cohort", "unit").distinct().withColumn("platform", F.when(F.col("unit") % 2 == 0, "ios").otherwise("android"))
    return person_days({"steps": family("click"), "sleep": family("view")}, weekly, platforms)


@query(f"""WITH {LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort, unit ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit) AS n FROM labelled), s AS (SELECT *, pos >= least(greatest(1, floor(n * 65e-2)::BIGINT), n - 1) AS test FROM r WHERE n >= 4),
t AS (SELECT cohort, unit, avg(label) AS rate FROM s WHERE NOT test AND unit % 4 <> 0 GROUP BY ALL), g AS (SELECT avg(label) AS rate FROM s WHERE NOT test)
SELECT s.cohort, s.unit, s.date, round(coalesce(t.rate, g.rate), 6) AS rate FROM s LEFT JOIN t USING (cohort, unit), g WHERE test""")
def jn08_train_rate_to_test(spark, d):
    from longspan.operators import splits

    s = splits.floor_split(panels.labelled_weeks(spark, d), T)
    train = s.where("role = 'train'")
    rate = train.where("unit % 4 <> 0").groupBy("cohort", "unit").agg(F.avg("label").alias("own"))
    whole = train.agg(F.avg("label").alias("all"))
    return s.where("role = 'test'").join(rate, ["cohort", "unit"], "left").join(F.broadcast(whole), F.lit(True)).select("cohort", "unit", "date", r6(F.coalesce("own", "all"), "rate"))


@query(f"WITH {WEEKS} SELECT cohort, unit, date, round(qty_sum / avg(qty_sum) OVER (PARTITION BY cohort), 6) AS relative FROM weeks")
def jn09_group_scale_joined_back(spark, d):
    w = panels.supplier_weeks(spark, d)
    return w.join(F.broadcast(w.groupBy("cohort").agg(F.avg("qty_sum").alias("scale"))), "cohort").select("cohort", "unit", "date", r6(F.col("qty_sum") / F.col("scale"), "relative"))


@query(f"""WITH {DAYS}, c AS (SELECT unit, count(*) AS n_rows, count(DISTINCT date) AS n_dates FROM days GROUP BY ALL) SELECT p.unit, p.cohort, p.platform, c.n_rows, c.n_dates, s.s_acctbal AS extra FROM (WITH {PEOPLE} SELECT * FROM people) p LEFT JOIN c ON p.unit = c.unit LEFT JOIN supplier s ON p.unit = s.s_suppkey""")
def jn10_person_covariates(spark, d):
    c = panels.user_days(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_dates"))
    s = panels.table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("extra"))
    return panels.people(spark, d).join(c, "unit", "left").join(s, "unit", "left").select("unit", "cohort", "platform", "n_rows", "n_dates", "extra")


@query("""WITH e AS (SELECT event_type, user_id, ts::DATE AS date, value, row_number() OVER (PARTITION BY event_type, user_id, ts::DATE ORDER BY event_id) AS occurrence FROM events)
SELECT a.user_id, a.date, a.occurrence::INT AS occurrence, a.value AS click, b.value AS view FROM e a JOIN e b ON a.user_id = b.user_id AND a.date = b.date AND a.occurrence = b.occurrence WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def jn11_alignment_by_occurrence(spark, d):
    e = panels.table(spark, d, "events").select("event_type", "user_id", F.to_date("ts").alias("date"), "value", "event_id")
    t = Trajectory(keys=("event_type", "user_id"), extra=("event_id",))
    e = e.withColumn("occurrence", t.occurrence())
    side = lambda k: e.where(F.col("event_type") == k).select("user_id", "date", "occurrence", F.col("value").alias(k))
    return side("click").join(side("view"), ["user_id", "date", "occurrence"])


@query(f"WITH {WEEKS}, g AS (SELECT cohort, unit FROM weeks GROUP BY ALL HAVING count(*) >= 250) SELECT cohort, unit, date FROM weeks SEMI JOIN g USING (cohort, unit) WHERE unit % 7 <> 0")
def jn12_jn13_eligible_and_excluded(spark, d):
    w = panels.supplier_weeks(spark, d).select("cohort", "unit", "date")
    eligible = w.groupBy("cohort", "unit").count().where("count >= 250").select("cohort", "unit")
    repeats = w.select("cohort", "unit").distinct().where("unit % 7 = 0")
    return w.join(eligible, ["cohort", "unit"], "left_semi").join(repeats, ["cohort", "unit"], "left_anti")


@query(f"""WITH {LONG}, p AS (SELECT a.target AS a, b.target AS b, a.value AS x, b.value AS y FROM series a JOIN series b ON a.cohort = b.cohort AND a.unit = b.unit AND a.date = b.date AND a.target < b.target)
SELECT a AS target_a, b AS target_b, count(*) AS n, round(CASE WHEN count(*) >= 10 AND sqrt(var_pop(x) * var_pop(y)) * count(*) > 1e-12 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END, 6) AS r FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def jn20_inf20_same_day_pairs(spark, d):
    """Every pair of columns in one pass over the wide table, not by a join of rows."""
    w = panels.supplier_weeks(spark, d)
    names = sorted(panels.TARGETS)
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            parts.append(F.struct(F.lit(a).alias("target_a"), F.lit(b).alias("target_b"), F.count_if(both).alias("n"), r6(metrics.pearson_of(F.col(a), F.col(b), 10), "r")))
    return w.agg(F.array(*parts).alias("p")).select(F.inline("p"))


@query(f"""WITH {LABELS} SELECT cohort, unit, sum(p * n_below)::DOUBLE AS wins FROM (SELECT cohort, unit, label AS p, count_if(label = 0) OVER (PARTITION BY cohort, unit ORDER BY qty_sum RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count_if(label = 0) OVER (PARTITION BY cohort, unit, qty_sum) AS n_below FROM labelled) GROUP BY ALL""")
def jn21_positive_over_negative_wins(spark, d):
    """Positives above negatives within units, by running counts instead of pairs."""
    by = Window.partitionBy("cohort", "unit")
    neg = F.count_if(F.col("label") == 0)
    below = neg.over(by.orderBy("qty_sum").rangeBetween(Window.unboundedPreceding, 0)) - neg.over(Window.partitionBy("cohort", "unit", "qty_sum"))
    return panels.labelled_weeks(spark, d).withColumn("below", below).groupBy("cohort", "unit").agg(F.sum(F.col("label") * F.col("below")).cast("double").alias("wins"))


@query(f"""WITH {DAYS} SELECT cohort, unit, date, max(n_events) FILTER (target = 'click') AS click, max(n_events) FILTER (target = 'view') AS "view", max(n_events) FILTER (target = 'error') AS error FROM days GROUP BY ALL""")
def rsh01_jn15_pivot(spark, d):
    return panels.user_days(spark, d).groupBy("cohort", "unit", "date").pivot("target", ["click", "view", "error"]).agg(F.first("n_events", ignorenulls=True))


@query(f"WITH {LONG} SELECT target, count(*) AS n_rows, count(value) AS n_values FROM (SELECT target, value FROM series UNION ALL SELECT 'returned_qty', NULL FROM weeks WHERE returned_qty IS NULL) GROUP BY ALL")
def rsh02_melt(spark, d):
    return panels.long(panels.supplier_weeks(spark, d), panels.TARGETS).groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"))


@query("SELECT user_id % 4 AS cohort, count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS \"view\", count_if(event_type = 'error') AS error FROM events GROUP BY ALL")
def rsh03_rsh04_cross_table(spark, d):
    e = panels.table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 4).alias("cohort")).pivot("event_type", ["click", "view", "error"]).count().fillna(0)


@query(f"WITH {WEEKS} SELECT cohort, unit, date, qty_sum FROM weeks ORDER BY qty_sum DESC, cohort, unit, date LIMIT 12")
def srt01_srt02_top_twelve(spark, d):
    return panels.supplier_weeks(spark, d).select("cohort", "unit", "date", "qty_sum").orderBy(F.desc("qty_sum"), "cohort", "unit", "date").limit(12)


@query(f"""WITH {DAYS}, n AS (SELECT target, cohort, count(DISTINCT unit) AS n FROM days WHERE n_events >= 2 GROUP BY ALL), s AS (SELECT CASE WHEN target IN ('click', 'view') THEN 'browse' ELSE 'act' END AS family, target, min(n) AS least, sum(n)::BIGINT AS total FROM n GROUP BY ALL)
SELECT family, target, least, total FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY least DESC, total DESC, target) AS k FROM s) WHERE k = 1""")
def srt03_best_target_of_family(spark, d):
    n = panels.user_days(spark, d).where("n_events >= 2").groupBy("target", "cohort").agg(F.count_distinct("unit").alias("n"))
    s = n.groupBy(F.when(F.col("target").isin("click", "view"), "browse").otherwise("act").alias("family"), "target").agg(F.min("n").alias("least"), F.sum("n").alias("total"))
    order = Window.partitionBy("family").orderBy(F.desc("least"), F.desc("total"), "target")
    return s.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


@query(f"""WITH {WEEKS}, a AS (SELECT cohort, avg(line_count) AS line_count, avg(qty_sum) / 25 AS qty_sum, avg(mean_tax) * 60 AS mean_tax FROM weeks GROUP BY ALL)
SELECT cohort, CASE greatest(line_count, qty_sum, mean_tax) WHEN line_count THEN 'line_count' WHEN qty_sum THEN 'qty_sum' ELSE 'mean_tax' END AS top_column FROM a""")
def srt04_arg_max_over_columns(spark, d):
    names = ["line_count", "qty_sum", "mean_tax"]
    a = panels.supplier_weeks(spark, d).groupBy("cohort").agg(F.avg("line_count").alias("line_count"), (F.avg("qty_sum") / 25).alias("qty_sum"), (F.avg("mean_tax") * 60).alias("mean_tax"))
    values = F.array(*names)
    return a.select("cohort", F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(values, F.array_max(values)) - 1).cast("int")).alias("top_column"))


@query("SELECT s_suppkey AS id, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def set01_union_of_columns(spark, d):
    a = panels.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = panels.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT 'intersect' AS kind, count(*) AS n FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL
SELECT 'difference', count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < -900) UNION ALL SELECT 'union', count(*) FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL
SELECT 'distinct', count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)""")
def set02_to_set04_set_operations(spark, d):
    s, c = panels.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), panels.table(spark, d, "customer")
    keys = lambda df: df.select(F.col("c_nationkey").alias("k"))
    count = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    parts = [count("intersect", s.intersect(keys(c))), count("difference", s.subtract(keys(c.where("c_acctbal < -900")))), count("union", s.union(keys(c)).distinct()), count("distinct", c.select("c_nationkey", "c_mktsegment").distinct())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY ALL")
def fn_json_fields(spark, d):
    return panels.table(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"]).groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS id, round(atanh(greatest(-0.999999, least(0.999999, s_acctbal / 1e5))), 9) AS z, upper(s_name[1:1]) || lower(s_name[2:]) AS title, sha256(s_name) AS sha FROM supplier")
def fn_scalars(spark, d):
    s = panels.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.round(F.atanh(numeric.clip(F.col("s_acctbal") / 1e5, -0.999999, 0.999999)), 9).alias("z"), F.initcap("s_name").alias("title"), F.sha2("s_name", 256).alias("sha"))
