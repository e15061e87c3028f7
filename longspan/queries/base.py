"""Registry of queries, and the SQL of the panels that they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded so that the order of additions does not show."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6)
    return out.alias(name) if name else out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


WEEKS = """
weeks AS (
  SELECT n_regionkey AS cohort, l_suppkey AS unit, date_trunc('week', l_shipdate)::DATE AS date,
         count(*)::DOUBLE AS line_count,
         sum(round(l_quantity)::BIGINT)::DOUBLE AS qty_sum,
         sum(CASE WHEN l_returnflag = 'R' THEN round(l_quantity)::BIGINT END)::DOUBLE AS returned_qty,
         sum(round(l_discount * 100)::BIGINT)::DOUBLE / (count(*) * 100e0) AS mean_discount,
         sum(round(l_tax * 100)::BIGINT)::DOUBLE / (count(*) * 100e0) AS mean_tax,
         count_if(l_linestatus = 'O')::DOUBLE / (count(*) * 1e0) AS open_share
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL)"""

LABELS = WEEKS + """,
labelled AS (
  SELECT *, (coalesce(returned_qty, 0) > qty_sum / 2e0)::INT AS label FROM weeks
  WHERE floor((date - DATE '1970-01-01') / 7e0)::BIGINT % 4 = 0)"""

DAYS = """
days AS (
  SELECT (user_id % 4)::INT AS cohort, user_id AS unit, ts::DATE AS date, event_type AS target,
         count(*)::DOUBLE AS n_events, sum(round(value * 100)::BIGINT)::DOUBLE / 100e0 AS value_sum
  FROM events GROUP BY ALL)"""

PEOPLE = """
people AS (
  SELECT n_regionkey AS cohort, c_custkey AS unit, c_mktsegment AS platform, c_acctbal AS balance, n_orders, spent, n_closed
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n_orders, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100000e0 AS spent,
                    count_if(o_orderstatus = 'F')::DOUBLE AS n_closed FROM orders GROUP BY ALL) ON c_custkey = o_custkey)"""

LONG = WEEKS + """,
series AS (
  UNPIVOT (SELECT cohort, unit, date, line_count, qty_sum, returned_qty, mean_discount, mean_tax, open_share FROM weeks)
  ON line_count, qty_sum, returned_qty, mean_discount, mean_tax, open_share INTO NAME target VALUE value)"""

FORECASTS = LONG + """,
logs AS (SELECT *, ln(1e0 + greatest(value, 0e0)) AS observed_log FROM series WHERE value IS NOT NULL),
hist AS (SELECT *, CASE WHEN count(observed_log) OVER w >= 7 THEN avg(observed_log) OVER w END AS reg_history FROM logs
         WINDOW w AS (PARTITION BY cohort, unit, target ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cohort, unit, target ORDER BY date) - 1 AS pos,
                  count(*) OVER (PARTITION BY cohort, unit, target) AS n FROM hist WHERE reg_history IS NOT NULL),
cuts AS (SELECT *, floor(n * 65e-2)::BIGINT AS e, floor(n * 65e-2)::BIGINT + ceil((n - floor(n * 65e-2)) / 2e0)::BIGINT AS m,
                floor(n * 35e-2)::BIGINT AS c35, floor(n * 5e-1)::BIGINT AS c50, floor(n * 85e-2)::BIGINT AS c85 FROM ranked),
blocks AS (
  SELECT 'fixed' AS regime, 'early' AS half, 'train' AS role, * FROM cuts WHERE pos < e UNION ALL
  SELECT 'fixed', 'early', 'test', * FROM cuts WHERE pos >= e AND pos < m UNION ALL
  SELECT 'fixed', 'late', 'train', * FROM cuts WHERE pos < e UNION ALL
  SELECT 'fixed', 'late', 'test', * FROM cuts WHERE pos >= m UNION ALL
  SELECT 'expanding', 'early', 'train', * FROM cuts WHERE pos < e UNION ALL
  SELECT 'expanding', 'early', 'test', * FROM cuts WHERE pos >= e AND pos < m UNION ALL
  SELECT 'expanding', 'late', 'train', * FROM cuts WHERE pos < m UNION ALL
  SELECT 'expanding', 'late', 'test', * FROM cuts WHERE pos >= m UNION ALL
  SELECT 'disjoint', 'early', 'train', * FROM cuts WHERE pos < c35 UNION ALL
  SELECT 'disjoint', 'early', 'test', * FROM cuts WHERE pos >= c35 AND pos < c50 UNION ALL
  SELECT 'disjoint', 'late', 'train', * FROM cuts WHERE pos >= c50 AND pos < c85 UNION ALL
  SELECT 'disjoint', 'late', 'test', * FROM cuts WHERE pos >= c85),
base AS (SELECT regime, half, target, cohort, avg(observed_log) FILTER (role = 'train') AS reg_calendar FROM blocks GROUP BY ALL),
pred AS (SELECT * FROM blocks JOIN base USING (regime, half, target, cohort) WHERE role = 'test')"""

METRICS = FORECASTS + """,
edges AS (SELECT regime, target, list_sort(list_distinct(quantile_cont(observed_log, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ed FROM pred GROUP BY ALL),
states AS (SELECT p.*, len(ed) - 1 AS k, CASE WHEN len(ed) > 2 THEN len(list_filter(ed[2:len(ed) - 1], lambda x: x < observed_log)) ELSE 0 END AS state
           FROM pred p JOIN edges USING (regime, target)),
cells AS (SELECT regime, cohort, unit, target, half, k, state, count(*)::DOUBLE AS c FROM states GROUP BY ALL),
shares AS (SELECT *, c / sum(c) OVER (PARTITION BY regime, cohort, unit, target, half) AS p FROM cells),
ent AS (SELECT regime, cohort, unit, target, half, abs(sum(p * ln(p))) / CASE WHEN any_value(k) > 1 THEN ln(any_value(k)) ELSE 1e0 END AS observed_entropy FROM shares GROUP BY regime, cohort, unit, target, half),
scales AS (SELECT regime, target, stddev_pop(observed_log) AS target_scale FROM pred GROUP BY ALL),
halfm AS (SELECT regime, cohort, unit, target, half, count(*) AS n_obs, avg(abs(observed_log - reg_history)) AS mae_history,
                 avg(abs(observed_log - reg_calendar)) AS mae_calendar, stddev_pop(observed_log) AS observed_sd FROM pred GROUP BY ALL HAVING count(*) >= 10),
skills AS (SELECT *, -mae_history / nullif(target_scale, 0e0) AS forecastability_raw,
                  CASE WHEN mae_calendar > 1e-6 THEN 1 - mae_history / mae_calendar END AS history_skill
           FROM halfm JOIN ent USING (regime, cohort, unit, target, half) JOIN scales USING (regime, target)),
m AS (SELECT *,
  CASE WHEN forecastability_raw IS NOT NULL THEN CASE WHEN stddev_pop(forecastability_raw) OVER w > 1e-12 THEN (forecastability_raw - avg(forecastability_raw) OVER w) / stddev_pop(forecastability_raw) OVER w ELSE 0e0 END END AS forecastability_raw_z,
  CASE WHEN history_skill IS NOT NULL THEN CASE WHEN stddev_pop(history_skill) OVER w > 1e-12 THEN (history_skill - avg(history_skill) OVER w) / stddev_pop(history_skill) OVER w ELSE 0e0 END END AS history_skill_z,
  CASE WHEN observed_sd IS NOT NULL THEN CASE WHEN stddev_pop(observed_sd) OVER w > 1e-12 THEN (observed_sd - avg(observed_sd) OVER w) / stddev_pop(observed_sd) OVER w ELSE 0e0 END END AS observed_sd_z,
  CASE WHEN observed_entropy IS NOT NULL THEN CASE WHEN stddev_pop(observed_entropy) OVER w > 1e-12 THEN (observed_entropy - avg(observed_entropy) OVER w) / stddev_pop(observed_entropy) OVER w ELSE 0e0 END END AS observed_entropy_z
  FROM skills WINDOW w AS (PARTITION BY regime, target, half))"""

COMPOSITES = METRICS + """,
comp AS (SELECT regime, 'core' AS scope, cohort, unit, half, count(DISTINCT target) AS n_targets, avg(forecastability_raw_z) AS forecastability,
                avg(history_skill_z) AS history_skill, avg(observed_sd_z) AS variability, avg(observed_entropy_z) AS entropy
         FROM m WHERE target IN ('line_count', 'qty_sum', 'mean_discount', 'mean_tax') GROUP BY ALL HAVING count(DISTINCT target) >= 3
         UNION ALL
         SELECT regime, 'rich', cohort, unit, half, count(DISTINCT target), avg(forecastability_raw_z), avg(history_skill_z), avg(observed_sd_z), avg(observed_entropy_z)
         FROM m GROUP BY regime, cohort, unit, half HAVING count(DISTINCT target) >= 5)"""
