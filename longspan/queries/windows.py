"""Window, calendar, projection and split queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from longspan.functions import numeric
from longspan.operators import ranking, splits
from longspan.operators.windows import Trajectory, calendar, first_crossing, tomorrow
from longspan.plans import panels
from longspan.sources.workspace import written

from .base import DAYS, LABELS, PEOPLE, WEEKS, query, r6, rounded

T = Trajectory()
ALL_DAYS = "PARTITION BY cohort, unit ORDER BY date"


@query(f"""WITH {WEEKS}, f AS (
  SELECT cohort, unit, date, qty_sum,
    CASE WHEN count(qty_sum) OVER t7 >= 7 THEN avg(qty_sum) OVER t7 END AS trailing7,
    CASE WHEN lead(1, 6) OVER ({ALL_DAYS}) IS NOT NULL AND count(qty_sum) OVER n7 >= 4 THEN avg(qty_sum) OVER n7 END AS next7,
    row_number() OVER ({ALL_DAYS}) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit) AS n
  FROM weeks WINDOW t7 AS ({ALL_DAYS} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), n7 AS ({ALL_DAYS} ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))
SELECT cohort, unit, date, qty_sum, round(trailing7, 6) AS trailing7, round(next7, 6) AS next7,
       CASE WHEN pos >= least(greatest(1, floor(n * 65e-2)::BIGINT), n - 1) THEN 'test' ELSE 'train' END AS role FROM f WHERE n >= 5""")
def flagship_weekly_panel(spark, d):
    """Trailing and next-week means of weekly quantities with a chronological split."""
    w = panels.supplier_weeks(spark, d).select("cohort", "unit", "date", "qty_sum")
    w = w.withColumn("trailing7", r6(T.trailing_mean(F.col("qty_sum"), 7))).withColumn("next7", r6(T.leading_mean(F.col("qty_sum"))))
    return splits.forecast(w, T, 0.35).select("cohort", "unit", "date", "qty_sum", "trailing7", "next7", "role")


@query(f"WITH {WEEKS} SELECT cohort, unit, date, lag(qty_sum) OVER ({ALL_DAYS}) AS yesterday FROM weeks")
def win01_previous_row(spark, d):
    return panels.supplier_weeks(spark, d).select("cohort", "unit", "date", T.previous(F.col("qty_sum")).alias("yesterday"))


@query(f"""WITH {WEEKS} SELECT cohort, unit, date,
 round(CASE WHEN count(returned_qty) OVER a >= 7 THEN avg(returned_qty) OVER a END, 6) AS mean7,
 round(CASE WHEN count(returned_qty) OVER b >= 7 THEN avg(returned_qty) OVER b END, 6) AS mean14,
 round(CASE WHEN count(returned_qty) OVER c >= 7 THEN avg(returned_qty) OVER c END, 6) AS mean42 FROM weeks
 WINDOW a AS ({ALL_DAYS} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), b AS ({ALL_DAYS} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), c AS ({ALL_DAYS} ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING)""")
def win02_trailing_means(spark, d):
    x = F.col("returned_qty")
    return panels.supplier_weeks(spark, d).select("cohort", "unit", "date", *[r6(T.trailing_mean(x, k), f"mean{k}") for k in (7, 14, 42)])


@query(f"""WITH {WEEKS} SELECT cohort, unit, date, round(CASE WHEN count(qty_sum) OVER c >= 7 THEN stddev_samp(qty_sum) OVER c END, 6) AS sd42 FROM weeks
 WINDOW c AS ({ALL_DAYS} ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING)""")
def win03_trailing_sd(spark, d):
    return panels.supplier_weeks(spark, d).select("cohort", "unit", "date", r6(T.trailing_sd(F.col("qty_sum"), 42), "sd42"))


@query(f"""WITH {WEEKS} SELECT cohort, unit, date, round(CASE WHEN lead(1, 6) OVER ({ALL_DAYS}) IS NOT NULL AND count(returned_qty) OVER n >= 4 THEN avg(returned_qty) OVER n END, 6) AS next7 FROM weeks
 WINDOW n AS ({ALL_DAYS} ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)""")
def win04_leading_mean(spark, d):
    return panels.supplier_weeks(spark, d).select("cohort", "unit", "date", r6(T.leading_mean(F.col("returned_qty")), "next7"))


@query(f"""WITH {WEEKS} SELECT cohort, unit, date, min(date) OVER (PARTITION BY cohort, unit) AS first_date,
 (date - min(date) OVER (PARTITION BY cohort, unit))::INT AS study_day0, (date - min(date) OVER (PARTITION BY cohort, unit))::INT + 1 AS study_day1 FROM weeks""")
def win05_prj08_study_days(spark, d):
    return panels.supplier_weeks(spark, d).select("cohort", "unit", "date", F.min("date").over(T.all).alias("first_date"), T.study_day().alias("study_day0"), T.study_day(1).alias("study_day1"))


@query(f"""WITH {WEEKS} SELECT cohort, unit, date, last_value(returned_qty IGNORE NULLS) OVER p AS last_known,
 (date - last_value(CASE WHEN returned_qty IS NOT NULL THEN date END IGNORE NULLS) OVER p)::INT AS days_since FROM weeks
 WINDOW p AS ({ALL_DAYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win06_last_known(spark, d):
    x = F.col("returned_qty")
    return panels.supplier_weeks(spark, d).select("cohort", "unit", "date", T.last_known(x).alias("last_known"), T.days_since_known(x).alias("days_since"))


@query(f"""WITH {WEEKS} SELECT cohort, unit, date, (row_number() OVER ({ALL_DAYS}) - 1)::INT AS position, count(*) OVER (PARTITION BY cohort, unit) AS n_rows,
 CASE WHEN row_number() OVER ({ALL_DAYS}) - 1 < count(*) OVER (PARTITION BY cohort, unit) / 2e0 THEN 'early' ELSE 'late' END AS half FROM weeks""")
def win07_win08_position_and_half(spark, d):
    return panels.supplier_weeks(spark, d).select("cohort", "unit", "date", T.position().alias("position"), T.size().alias("n_rows"), T.half().alias("half"))


REGIMES = f"""WITH {WEEKS}, ranked AS (SELECT cohort, unit, date, row_number() OVER ({ALL_DAYS}) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit) AS n FROM weeks),
cuts AS (SELECT *, floor(n * 65e-2) AS e, floor(n * 65e-2) + ceil((n - floor(n * 65e-2)) / 2e0) AS m, floor(n * 35e-2) AS a, floor(n * 5e-1) AS b, floor(n * 85e-2) AS c FROM ranked),
spec(regime, half, role) AS (VALUES ('fixed','early','train'),('fixed','early','test'),('fixed','late','train'),('fixed','late','test'),
 ('expanding','early','train'),('expanding','early','test'),('expanding','late','train'),('expanding','late','test'),
 ('disjoint','early','train'),('disjoint','early','test'),('disjoint','late','train'),('disjoint','late','test'))
SELECT regime, half, role, cohort, count(*) AS n_rows, sum(pos)::BIGINT AS positions FROM cuts, spec WHERE
 CASE WHEN regime <> 'disjoint' AND role = 'train' THEN pos < CASE WHEN regime = 'expanding' AND half = 'late' THEN m ELSE e END
      WHEN regime <> 'disjoint' THEN CASE WHEN half = 'early' THEN pos >= e AND pos < m ELSE pos >= m END
      WHEN half = 'early' THEN CASE WHEN role = 'train' THEN pos < a ELSE pos >= a AND pos < b END
      ELSE CASE WHEN role = 'train' THEN pos >= b AND pos < c ELSE pos >= c END END
GROUP BY ALL"""


@query(REGIMES)
def win09_regime_blocks(spark, d):
    w = splits.with_regimes(panels.supplier_weeks(spark, d).select("cohort", "unit", "date"), T)
    return w.groupBy("regime", "half", "role", "cohort").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("position").alias("positions"))


@query(f"""WITH {LABELS} SELECT cohort, unit, date, label, round(coalesce(avg(label::DOUBLE) OVER ({ALL_DAYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5e-1), 6) AS prior_rate FROM labelled""")
def win10_prior_rate(spark, d):
    return panels.labelled_weeks(spark, d).select("cohort", "unit", "date", "label", r6(T.prior_rate(F.col("label") == 1, F.lit(0.5)), "prior_rate"))


@query("""WITH l AS (SELECT (user_id % 4)::INT AS cohort, user_id AS unit, ts::DATE AS date, event_id FROM events)
SELECT cohort, unit, date, occurrence::INT AS occurrence, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cohort, unit, date ORDER BY event_id) AS occurrence FROM l) GROUP BY ALL""")
def win11_occurrence(spark, d):
    e = panels.table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("cohort"), F.col("user_id").alias("unit"), F.to_date("ts").alias("date"), "event_id")
    t = Trajectory(extra=("event_id",))
    return e.withColumn("occurrence", t.occurrence()).groupBy("cohort", "unit", "date", "occurrence").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {WEEKS} SELECT cohort, unit, date,
 round(CASE WHEN qty_sum IS NOT NULL THEN CASE WHEN stddev_pop(qty_sum) OVER w > 1e-12 THEN (qty_sum - avg(qty_sum) OVER w) / stddev_pop(qty_sum) OVER w ELSE 0e0 END END, 6) AS z,
 round(CASE WHEN returned_qty IS NOT NULL THEN CASE WHEN stddev_pop(returned_qty) OVER w > 1e-12 THEN (returned_qty - avg(returned_qty) OVER w) / stddev_pop(returned_qty) OVER w END END, 6) AS z_or_missing
 FROM weeks WINDOW w AS (PARTITION BY cohort, unit)""")
def win12_win13_group_z(spark, d):
    return panels.supplier_weeks(spark, d).select("cohort", "unit", "date", r6(numeric.zscore(F.col("qty_sum"), T.all), "z"), r6(numeric.zscore(F.col("returned_qty"), T.all, None), "z_or_missing"))


@query(f"""WITH {WEEKS}, i AS (SELECT *, sum(CASE WHEN (date - prev)::INT = 7 THEN 0 ELSE 1 END) OVER ({ALL_DAYS}) AS island FROM (SELECT cohort, unit, date, lag(date) OVER ({ALL_DAYS}) AS prev FROM weeks)),
r AS (SELECT cohort, unit, island, count(*) AS run_length, min(date) AS run_start FROM i GROUP BY ALL)
SELECT cohort, unit, run_length, run_start, n_runs FROM (SELECT *, count(*) OVER (PARTITION BY cohort, unit) AS n_runs, row_number() OVER (PARTITION BY cohort, unit ORDER BY run_length DESC, run_start) AS k FROM r) WHERE k = 1""")
def win14_longest_run(spark, d):
    return T.longest_run(panels.supplier_weeks(spark, d), 7)


@query(f"""WITH {LABELS}, t AS (SELECT cohort, label AS to_state, date, lag(date) OVER ({ALL_DAYS}) AS prev, lag(label) OVER ({ALL_DAYS}) AS from_state FROM labelled)
SELECT cohort, from_state, to_state, count(*) AS n FROM t WHERE (date - prev)::INT = 28 GROUP BY ALL""")
def win15_transitions(spark, d):
    return T.transitions(panels.labelled_weeks(spark, d), "label", 28).groupBy("cohort", "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {WEEKS} SELECT cohort, unit, date, CASE WHEN returned_qty IS NOT NULL THEN
 rank() OVER (PARTITION BY cohort, returned_qty IS NULL ORDER BY returned_qty) + (count(*) OVER (PARTITION BY cohort, returned_qty) - 1) / 2e0 END AS average_rank FROM weeks""")
def win16_average_rank(spark, d):
    w = written(panels.supplier_weeks(spark, d).select("cohort", "unit", "date", "returned_qty"), "returns")
    return ranking.average_ranks(w, {"average_rank": F.col("returned_qty")}, ["cohort"]).drop("returned_qty")


@query(f"""WITH {WEEKS} SELECT cohort, unit, date, row_number() OVER (PARTITION BY cohort ORDER BY qty_sum, unit, date) - 1 AS place, count(*) OVER (PARTITION BY cohort) AS n,
 rank() OVER (PARTITION BY cohort ORDER BY mean_tax) + (count(*) OVER (PARTITION BY cohort, mean_tax) - 1) / 2e0 AS average_rank FROM weeks""")
def win16_ranks_by_ranges(spark, d):
    """Places and average ranks within cohorts by two levels, ranges of values and places in a range; no window holds a cohort."""
    w = written(panels.supplier_weeks(spark, d).select("cohort", "unit", "date", "qty_sum", "mean_tax"), "weeks")
    ranked = ranking.average_ranks(w, {"average_rank": F.col("mean_tax")}, ["cohort"], limit=0)
    return ranking.numbered(ranked, ["cohort"], ["qty_sum", "unit", "date"]).select("cohort", "unit", "date", F.col("i").alias("place"), "n", "average_rank")


P_SQL = """p AS (SELECT s_nationkey AS family, s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE ((s_suppkey * 7919) % 1000 + 1) / 1001e0 END AS p FROM supplier)"""


def _p_values(spark, d):
    s = F.col("s_suppkey")
    return panels.table(spark, d, "supplier").select(F.col("s_nationkey").alias("family"), s.alias("id"), F.when(s % 9 != 0, ((s * 7919) % 1000 + 1) / F.lit(1001.0)).alias("p"))


@query(f"""WITH {P_SQL}, r AS (SELECT *, p * count(p) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p) AS raw FROM p)
SELECT family, id, round(p, 9) AS p, round(CASE WHEN p IS NOT NULL THEN least(min(raw) OVER (PARTITION BY family, p IS NULL ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e0) END, 9) AS q,
 round(CASE WHEN p IS NOT NULL THEN least(p * count(p) OVER (PARTITION BY family), 1e0) END, 9) AS bonferroni FROM r""")
def win17_win18_adjusted_p(spark, d):
    out = ranking.adjusted_p(_p_values(spark, d), "p", ["family"])
    n = out.groupBy("family").agg(F.count("p").alias("n"))
    out = ranking.join_on(out, n, ["family"]).withColumn("bonferroni", F.when(F.col("p").isNotNull(), F.least(F.col("p") * F.col("n"), F.lit(1.0))))
    return rounded(out.drop("n"), 9)


@query(f"""WITH {WEEKS}, g AS (SELECT cohort, date, sum(qty_sum) AS total FROM weeks GROUP BY ALL), c AS (SELECT cohort, date, sum(total) OVER (PARTITION BY cohort ORDER BY date) AS reached_sum, lag(date) OVER (PARTITION BY cohort ORDER BY date) AS below FROM g)
SELECT cohort, arg_min_null(below, date) AS below, min(date) AS reached FROM c WHERE reached_sum >= 1000 GROUP BY ALL""")
def win19_first_crossing(spark, d):
    g = panels.supplier_weeks(spark, d).groupBy("cohort", "date").agg(F.sum("qty_sum").alias("total"))
    g = g.withColumn("reached_sum", F.sum("total").over(Window.partitionBy("cohort").orderBy("date")))
    return first_crossing(g, "date", "reached_sum", 1000.0, ["cohort"])


@query(f"WITH {DAYS} SELECT cohort, unit, date, target, (isodow(date) - 1)::INT AS weekday, isodow(date) >= 6 AS is_weekend FROM days")
def prj07_calendar(spark, d):
    return calendar(panels.user_days(spark, d)).select("cohort", "unit", "date", "target", "weekday", "is_weekend")


@query("""WITH n AS (SELECT 'f_' || lower(r_name) || ':' || s || v || ':' || g AS name FROM region, (VALUES ('steps'), ('sleep')) a(s), (VALUES (''), ('_norm'), ('_dis')) b(v), (VALUES ('allday'), ('morning')) c(g))
SELECT name, split_part(name, ':', 1) AS family, regexp_replace(split_part(name, ':', 2), '(_norm|_dis)$', '') AS feature,
 CASE WHEN split_part(name, ':', 2) LIKE '%\\_norm' ESCAPE '\\' THEN 'norm' WHEN split_part(name, ':', 2) LIKE '%\\_dis' ESCAPE '\\' THEN 'dis' ELSE 'raw' END AS variant, split_part(name, ':', 3) AS segment FROM n""")
def prj01_parse_feature_names(spark, d):
    some = lambda *xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    n = panels.table(spark, d, "region").select("r_name", some("steps", "sleep").alias("s")).select("*", some("", "_norm", "_dis").alias("v")).select("*", some("allday", "morning").alias("g"))
    n = n.select(F.concat(F.lit("f_"), F.lower("r_name"), F.lit(":"), "s", "v", F.lit(":"), "g").alias("name"))
    return n.withColumn("p", numeric.parse_feature(F.col("name"))).select("name", "p.*")


@query(f"""WITH {WEEKS}, c AS (UNPIVOT (SELECT count(*) AS rows, count(qty_sum) AS qty_sum, count(returned_qty) AS returned_qty, count(mean_tax) AS mean_tax FROM weeks) ON qty_sum, returned_qty, mean_tax INTO NAME "column" VALUE non_null)
SELECT "column", non_null, round(1 - non_null / rows::DOUBLE, 6) AS missing_rate FROM c""")
def prj02_column_catalogue(spark, d):
    cols = ["qty_sum", "returned_qty", "mean_tax"]
    one = panels.supplier_weeks(spark, d).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in cols])
    return one.unpivot("rows", cols, "column", "non_null").select("column", "non_null", r6(1 - F.col("non_null") / F.col("rows"), "missing_rate"))


@query(f"WITH {WEEKS} SELECT cohort, unit, date, qty_sum, mean_discount FROM weeks")
def prj03_prj04_feature_selection(spark, d):
    """Columns by name, those without any value in training left out."""
    w = panels.supplier_weeks(spark, d).withColumn("qty_norm:x", F.lit(1.0)).withColumn("mean_nothing", F.lit(None).cast("double"))
    names = numeric.feature_columns(w.columns, "qty") + numeric.feature_columns(w.columns, "mean_d") + numeric.feature_columns(w.columns, "mean_n")
    known = w.where("cohort < 4").agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in names]).first().asDict()
    return w.select("cohort", "unit", "date", *[c for c in names if known[c]])


@query(f"""WITH {PEOPLE} SELECT unit, ((n_orders IS NOT NULL)::INT + (spent IS NOT NULL)::INT + (balance IS NOT NULL)::INT) / 3e0 AS feature_coverage,
 coalesce(n_closed, n_orders, -1e0) AS first_known, cohort || '::' || platform AS "group", round(ln(1 + greatest(balance, 0)), 6) AS log_balance,
 CASE WHEN balance IS NULL THEN NULL ELSE least(greatest(balance, 0e0), 5000e0) END AS clipped FROM people""")
def prj06_09_11_12_15_projections(spark, d):
    from longspan.sources.ingest import coverage

    p = panels.people(spark, d)
    return p.select("unit", coverage(["n_orders", "spent", "balance"]).alias("feature_coverage"), F.coalesce("n_closed", "n_orders", F.lit(-1.0)).alias("first_known"),
                    F.concat_ws("::", "cohort", "platform").alias("group"), r6(numeric.log1p_clipped(F.col("balance")), "log_balance"), numeric.clip(F.col("balance"), 0.0, 5000.0).alias("clipped"))


@query(f"""WITH {WEEKS}, f AS (SELECT *, row_number() OVER ({ALL_DAYS}) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit) AS n FROM weeks), t AS (SELECT median(qty_sum) FILTER (pos < floor(n * 65e-2)) AS threshold FROM f)
SELECT cohort, unit, date, (qty_sum > threshold)::INT AS target_high FROM f, t""")
def prj10_median_binarised(spark, d):
    w = splits.floor_split(panels.supplier_weeks(spark, d), T, 0.65, 1)
    level = ranking.shares_of(w.where("role = 'train'"), "qty_sum", [], [0.5]).select(F.col("q")[0].alias("threshold"))
    return w.join(F.broadcast(level), F.lit(True)).select("cohort", "unit", "date", (F.col("qty_sum") > F.col("threshold")).cast("int").alias("target_high"))


@query(f"""WITH {PEOPLE} SELECT unit, (coalesce(platform, 'missing') = 'BUILDING')::INT AS is_building, (coalesce(platform, 'missing') = 'MACHINERY')::INT AS is_machinery, (coalesce(platform, 'missing') = 'missing')::INT AS is_missing,
 CASE platform WHEN 'BUILDING' THEN 'heavy' WHEN 'MACHINERY' THEN 'heavy' WHEN 'AUTOMOBILE' THEN 'heavy' ELSE 'light' END AS family FROM people""")
def prj13_prj16_categories(spark, d):
    p = panels.people(spark, d)
    flag = lambda v: (F.coalesce("platform", F.lit("missing")) == v).cast("int")
    family = F.create_map(*[F.lit(x) for k in ("BUILDING", "MACHINERY", "AUTOMOBILE") for x in (k, "heavy")])
    return p.select("unit", flag("BUILDING").alias("is_building"), flag("MACHINERY").alias("is_machinery"), flag("missing").alias("is_missing"), F.coalesce(family[F.col("platform")], F.lit("light")).alias("family"))


@query(f"""WITH {PEOPLE}, s AS (SELECT median(spent) AS mid FROM people), f AS (SELECT unit, coalesce(spent, mid) AS x FROM people, s)
SELECT unit, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS spent_scaled FROM f""")
def prj17_imputed_scaled(spark, d):
    p = panels.people(spark, d)
    p = p.fillna({"spent": ranking.shares_of(p, "spent", [], [0.5]).first()["q"][0]})
    s = p.agg(F.avg("spent").alias("m"), F.stddev_pop("spent").alias("s"))
    return p.join(F.broadcast(s), F.lit(True)).select("unit", r6((F.col("spent") - F.col("m")) / F.col("s"), "spent_scaled"))


@query(f"""WITH {WEEKS} SELECT cohort, count(*) AS n_rows, count(DISTINCT unit) AS n_units FROM weeks WHERE qty_sum BETWEEN 20 AND 200 AND cohort IN (0, 2, 4) AND returned_qty IS NOT NULL AND coalesce(returned_qty, qty_sum) IS NOT NULL
GROUP BY cohort HAVING count(*) >= 30 AND count(DISTINCT unit) >= 3""")
def flt01_to_05_filters_and_gates(spark, d):
    w = panels.supplier_weeks(spark, d).where(F.col("qty_sum").between(20, 200) & F.col("cohort").isin(0, 2, 4)).dropna(subset=["returned_qty"]).where(F.coalesce("returned_qty", "qty_sum").isNotNull())
    return w.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("unit").alias("n_units")).where("n_rows >= 30 AND n_units >= 3")


@query(f"WITH {LABELS} SELECT cohort, unit, date, CASE WHEN cohort IN (3, 4) THEN 'test' ELSE 'train' END AS role FROM labelled WHERE cohort <> 2")
def spl01_by_cohort(spark, d):
    return splits.by_cohort(panels.labelled_weeks(spark, d), [0, 1], [3, 4]).select("cohort", "unit", "date", "role")


@query(f"""WITH {LABELS}, r AS (SELECT cohort, unit, date, count(*) OVER (PARTITION BY cohort, unit) AS n_rows, row_number() OVER ({ALL_DAYS}) - 1 AS pos FROM labelled),
t AS (SELECT *, greatest(1, round_even(n_rows * 35e-2, 0)::INT) AS n_test FROM r)
SELECT cohort, unit, date, n_test, CASE WHEN pos >= n_rows - n_test THEN 'test' ELSE 'train' END AS role FROM t WHERE n_rows >= 4 AND n_rows - n_test >= 2""")
def spl02_within_unit(spark, d):
    return splits.within_unit(panels.labelled_weeks(spark, d), T, 0.35).select("cohort", "unit", "date", "n_test", "role")


HASH = lambda *xs: "('0x' || substr(md5(" + " || '|' || ".join(xs) + "), 1, 12))::BIGINT"


@query(f"""WITH {LABELS}, g AS (SELECT cohort, unit, count(*) AS n, {HASH("7", "cohort", "unit")} AS u FROM labelled GROUP BY ALL HAVING count(*) >= 4),
k AS (SELECT cohort, unit, row_number() OVER (ORDER BY u, cohort, unit) AS k, count(*) OVER () AS total FROM g)
SELECT l.cohort, l.unit, l.date, CASE WHEN k <= ceil(25e-2 * total) THEN 'test' ELSE 'train' END AS role FROM labelled l JOIN k ON l.cohort = k.cohort AND l.unit = k.unit""")
def spl03_held_out_units(spark, d):
    return splits.held_out_units(panels.labelled_weeks(spark, d), ["cohort", "unit"], 0.25, 7).select("cohort", "unit", "date", "role")


@query(f"""WITH {WEEKS}, r AS (SELECT cohort, unit, date, count(*) OVER (PARTITION BY cohort, unit) AS n, row_number() OVER ({ALL_DAYS}) - 1 AS pos FROM weeks)
SELECT cohort, unit, date, CASE WHEN pos >= least(greatest(1, floor(n * (1 - 35e-2))::BIGINT), n - 1) THEN 'test' ELSE 'train' END AS forecast_role, CASE WHEN pos >= least(greatest(1, floor(n * 65e-2)::BIGINT), n - 1) THEN 'test' ELSE 'train' END AS floor_role FROM r WHERE n >= 5""")
def spl04_spl05_chronological(spark, d):
    w = panels.supplier_weeks(spark, d).select("cohort", "unit", "date")
    a = splits.forecast(w, T, 0.35).select("cohort", "unit", "date", F.col("role").alias("forecast_role"))
    return splits.floor_split(a, T, 0.65).select("cohort", "unit", "date", "forecast_role", F.col("role").alias("floor_role"))


@query(f"""WITH {PEOPLE}, r AS (SELECT cohort, unit, rep::INT AS rep FROM people, range(0, 3) t(rep)),
k AS (SELECT *, row_number() OVER (PARTITION BY rep, cohort ORDER BY {HASH("rep", "unit")}, unit) AS k, count(*) OVER (PARTITION BY rep, cohort) AS n FROM r)
SELECT rep, cohort, unit, CASE WHEN k <= greatest(1, floor(n * 2e-1 + 5e-1)) THEN 'test' ELSE 'train' END AS role FROM k""")
def spl06_stratified_holdouts(spark, d):
    return splits.stratified_holdouts(panels.people(spark, d).select("cohort", "unit"), "cohort", "unit", 3).select("rep", "cohort", "unit", "role")


@query(f"""WITH {WEEKS} SELECT h::INT AS held_out, CASE WHEN cohort = h THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM weeks, range(0, 5) t(h) GROUP BY ALL""")
def spl07_leave_one_cohort_out(spark, d):
    return splits.leave_one_out(panels.supplier_weeks(spark, d), list(range(5))).groupBy("held_out", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DAYS} SELECT a.cohort, a.unit, a.target, a.date, b.date AS target_date, b.n_events AS target_value FROM days a JOIN days b ON a.unit = b.unit AND a.target = b.target AND b.date = a.date + 1""")
def jn05_jn06_tomorrow_target(spark, d):
    p = panels.user_days(spark, d)
    return tomorrow(p.select("cohort", "unit", "target", "date", "n_events"), "n_events", ["unit", "target"]).select("cohort", "unit", "target", "date", "target_date", "target_value")
