"""Reading, writing and checking tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspan.plans import panels
from longspan.sources import ingest, validate
from longspan.sources.workspace import folder, written

from .base import DAYS, PEOPLE, WEEKS, query, rounded, r6


def _cohort_files(spark, d) -> str:
    """Cohort folders with a CSV of weekly values each, in as many files as tasks wrote, so no task holds a cohort."""
    root = folder(spark)
    w = panels.supplier_weeks(spark, d).select("cohort", F.col("unit").alias("pid"), "date", "qty_sum", "returned_qty", F.lit(1).alias("Unnamed: 0"))
    w = written(w.withColumnRenamed("Unnamed: 0", "one"), "cohort-weeks").withColumnRenamed("one", "Unnamed: 0")
    for c in range(5):
        w.where(F.col("cohort") == c).drop("cohort").write.option("header", True).csv(f"{root}/INS-W_{c + 1}/FeatureData/steps.csv")
    return root


SCHEMA = "pid long, date date, qty_sum double, returned_qty double, `Unnamed: 0` int"


@query("SELECT 'INS-W_' || (r_regionkey + 1) AS cohort, r_regionkey + 1 AS cohort_index FROM region")
def src01_cohort_discovery(spark, d):
    return ingest.cohorts(spark, _cohort_files(spark, d)).select("cohort", "cohort_index")


@query("SELECT count(*) AS n_cohorts, list(c ORDER BY c)::VARCHAR AS cohorts FROM (SELECT 'INS-W_' || (r_regionkey + 1) AS c FROM region)")
def src02_root_audit(spark, d):
    a = ingest.audit_root(ingest.cohorts(spark, _cohort_files(spark, d)))
    return a.select("n_cohorts", F.concat(F.lit("["), F.array_join("cohorts", ", "), F.lit("]")).alias("cohorts"))


@query(f"WITH {WEEKS} SELECT 'INS-W_' || (cohort + 1) AS cohort, unit::VARCHAR AS unit, date, qty_sum FROM weeks")
def src03_src05_src10_pruned_csv(spark, d):
    df = ingest.read_csv(spark, f"{_cohort_files(spark, d)}/*/FeatureData/steps.csv", SCHEMA, ["pid", "date", "qty_sum"], cohort_level=4)
    return ingest.dated(df).select("cohort", "unit", "date", "qty_sum")


@query(f"WITH {WEEKS} SELECT 'INS-W_' || (cohort + 1) AS cohort, count(*) AS n_rows, 5 AS n_columns FROM weeks GROUP BY ALL")
def src04_file_shapes(spark, d):
    s = ingest.file_shapes(spark, [f"{_cohort_files(spark, d)}/*/FeatureData/steps.csv"])
    return s.groupBy(ingest.path_part(F.col("path"), 4).alias("cohort")).agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").cast("int").alias("n_columns"))


@query(f"WITH {WEEKS} SELECT unit, date, returned_qty, returned_qty IS NOT NULL AS label_available FROM weeks")
def src06_optional_labels(spark, d):
    return ingest.labels(panels.supplier_weeks(spark, d), ["returned_qty", "phq4", "BDI2"], "returned_qty")


@query(f"WITH {PEOPLE} SELECT platform, count(*) AS n FROM people GROUP BY ALL")
def src07_platforms(spark, d):
    return panels.people(spark, d).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WEEKS} SELECT cohort, unit, date, 1 AS dataset_idx, qty_sum AS f__qty_sum, returned_qty AS f__returned_qty, (1 + (returned_qty IS NOT NULL)::INT) / 2e0 AS feature_coverage FROM weeks")
def src09_prj05_prefixed_table(spark, d):
    w = panels.supplier_weeks(spark, d).select("cohort", "unit", "date", "qty_sum", "returned_qty")
    out = ingest.prefixed(w, "f", ("cohort", "unit", "date"))
    return out.withColumn("dataset_idx", F.lit(1)).withColumn("feature_coverage", ingest.coverage(["f__qty_sum", "f__returned_qty"]))


@query("SELECT o_custkey AS unit, o_totalprice AS spent FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def src11_src12_snk02_parquet(spark, d):
    """A cached copy partitioned by status, read with one column and one partition."""
    path = f"{folder(spark)}/orders"
    ingest.write_parquet(panels.table(spark, d, "orders"), path, ["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'F' AND o_totalprice > 100000").select(F.col("o_custkey").alias("unit"), F.col("o_totalprice").alias("spent"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(round(o_totalprice * 100)::BIGINT) / 1e2, 2) AS total FROM orders GROUP BY ALL")
def src11_content_addressed_cache(spark, d):
    """A pruned CSV scan kept as Parquet under the digest of its files; the second read, which this is, scans no CSV."""
    root = folder(spark)
    panels.table(spark, d, "orders").write.option("header", True).csv(f"{root}/orders-csv")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panels.table(spark, d, "orders").schema.fields)
    for _ in range(2):
        orders = ingest.cached_csv(spark, f"{root}/orders-csv", ["o_orderstatus", "o_totalprice"], f"{root}/cache", schema)
    return orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100, 2).alias("total"))


@query("SELECT c_custkey::VARCHAR AS unit, lower(c_mktsegment) AS platform FROM customer")
def src07_platform_file(spark, d):
    """Each unit's platform, read from a file with several platforms a unit."""
    path = f"{folder(spark)}/platform"
    both = F.concat("c_mktsegment", F.lit(";other"))
    panels.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), both.alias("platform")).write.option("header", True).csv(path)
    return ingest.platforms(spark, path)


@query("SELECT s_suppkey AS unit, 1 AS wave, s_acctbal AS phq4, NULL::DOUBLE AS pss4 FROM supplier UNION ALL SELECT c_custkey, 2, NULL, c_acctbal FROM customer UNION ALL SELECT n_nationkey, 3, NULL, NULL FROM nation")
def src13_set01_optional_columns(spark, d):
    a = panels.table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.lit(1).alias("wave"), F.col("s_acctbal").alias("phq4"))
    b = panels.table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.lit(2).alias("wave"), F.col("c_acctbal").alias("pss4"))
    c = panels.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("unit"), F.lit(3).alias("wave"))
    return ingest.union_all([a, b, c])


@query(f"WITH {PEOPLE} SELECT cohort, unit, coalesce(n_closed, n_orders, balance) AS construct, platform FROM people")
def src14_baseline(spark, d):
    """One row a person by the first known instrument; repeated rows are settled by an explicit order."""
    p = panels.people(spark, d)
    twice = p.union(p).withColumn("construct", F.coalesce("n_closed", "n_orders", "balance"))
    return twice.groupBy("cohort", "unit").agg(F.min("construct").alias("construct"), F.min("platform").alias("platform"))


@query("SELECT DISTINCT cohort, unit FROM (SELECT 'W' || (s_nationkey % 3) AS cohort, s_suppkey::VARCHAR AS unit FROM supplier UNION ALL SELECT 'X' || (s_nationkey % 2), s_suppkey::VARCHAR FROM supplier)")
def src15_repeat_pairs(spark, d):
    s = panels.table(spark, d, "supplier").select(F.concat(F.lit("W"), F.col("s_nationkey") % 3).alias("a"), F.concat(F.lit("X"), F.col("s_nationkey") % 2).alias("b"), F.concat(F.col("s_suppkey").cast("string"), F.lit("#z#1")).alias("id"))
    inner = s.groupBy("a", "b").agg(F.collect_list("id").alias("ids")).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "ids"))).alias("m"))
    text = inner.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("a", "m"))).alias("dep_weekly"))).alias("text"))
    return ingest.repeat_pairs(text, "text", "dep_weekly")


@query()
def src17_file_hashes(spark, d):
    return ingest.file_hashes(spark, f"{d}/region.parquet").select("length", "sha256")


@query("SELECT 'INS-W_6' AS cohort, 'steps.csv' AS file, 'missing' AS problem UNION ALL SELECT 'INS-W_1', 'sleep.csv', 'missing' UNION ALL SELECT 'INS-W_6', 'sleep.csv', 'missing' UNION ALL SELECT 'INS-W_' || (r_regionkey + 1), 'sleep.csv', 'missing' FROM region WHERE r_regionkey > 0")
def src18_layout_check(spark, d):
    files = ingest.listing(spark, _cohort_files(spark, d), "*.csv")
    found = files.groupBy(ingest.path_part(F.col("path"), 4).alias("cohort"), ingest.path_part(F.col("path"), 2).alias("file")).agg(F.sum("length").alias("length"))
    expected = spark.range(1, 7).select(F.concat(F.lit("INS-W_"), "id").alias("cohort"), F.explode(F.array(F.lit("steps.csv"), F.lit("sleep.csv"))).alias("file"))
    return validate.missing_files(expected, found)


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def snk01_csv_round_trip(spark, d):
    path = f"{folder(spark)}/customers"
    ingest.write_csv(panels.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), path)
    return ingest.read_csv(spark, path, "c_custkey long, c_acctbal double, c_mktsegment string")


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def snk03_json_rows(spark, d):
    return ingest.json_rows(panels.table(spark, d, "region").select("r_regionkey", "r_name"))


@query(r"SELECT n_nationkey, replace(replace(n_name, '_', '\_'), '%', '\%') || ' & ' || format('{:.3f}', n_nationkey / 7e0) || ' \\' AS latex FROM nation")
def snk04_latex_rows(spark, d):
    n = panels.table(spark, d, "nation").withColumn("share", F.col("n_nationkey") / 7.0)
    return ingest.latex_rows(n, ["n_name", "share"]).select("n_nationkey", "latex")


@query("SELECT 'c_acctbal' AS \"column\", count_if(NOT c_acctbal BETWEEN 0 AND 9000) AS n_bad FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer")
def val01_bounds(spark, d):
    return validate.out_of_bounds(panels.table(spark, d, "customer"), {"c_acctbal": (0, 9000), "c_mktsegment": (0, 1)})


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n_rows FROM customer GROUP BY ALL HAVING count(*) > 1")
def val02_duplicate_keys(spark, d):
    return validate.duplicate_keys(panels.table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT min(n_nationkey) AS n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def val03_to_val05_checked_join(spark, d):
    n = panels.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.min("n_nationkey").alias("n_nationkey"))
    r = validate.require_columns(panels.table(spark, d, "region"), ["r_name"], {"r_name": 5}).withColumn("k", F.col("r_regionkey"))
    out = validate.join_one_to_one(n, r, ["k"])
    return validate.require_rows(n, out).select("n_nationkey", "r_name")


@query(f"WITH {DAYS} SELECT target, cohort FROM (SELECT DISTINCT target FROM days), (SELECT DISTINCT cohort FROM days) EXCEPT SELECT target, cohort FROM days WHERE NOT (target = 'click' AND cohort = 1)")
def val06_missing_grid_cells(spark, d):
    kept = panels.user_days(spark, d).where("NOT (target = 'click' AND cohort = 1)")
    return validate.missing_cells(kept, "target", "cohort")


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def val07_unmapped(spark, d):
    mapping = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    return validate.unmapped(panels.table(spark, d, "customer"), "c_mktsegment", mapping)


@query("SELECT * FROM (VALUES ('data/raw/x.csv', 'not on the list'), ('data/raw/x.csv', 'forbidden folder'), ('results/a.parquet', 'forbidden kind'), ('results/b.csv', 'identifier column'), ('results/c.json', 'too large')) t(path, problem)")
def val08_release_audit(spark, d):
    rows = [("data/raw/x.csv", 10, "a,b"), ("results/a.parquet", 10, None), ("results/b.csv", 10, "cohort, PID"), ("results/c.json", 30 << 20, None), ("results/ok.csv", 10, "cohort,n")]
    return validate.release_problems(spark.createDataFrame(rows, "path string, length long, header string"), ["results/"])


DIFF = """e AS (SELECT cohort, unit, spent, n_orders FROM people WHERE spent IS NOT NULL), a AS (SELECT cohort, unit + CASE WHEN unit % 17 = 0 THEN 1000000 ELSE 0 END AS unit,
 CASE WHEN unit % 5 = 0 THEN spent + 5e-1 * 1e-9 WHEN unit % 7 = 0 THEN spent + 1e-6 ELSE spent END AS spent, CASE WHEN unit % 11 = 0 THEN NULL ELSE n_orders END AS n_orders FROM e),
j AS (SELECT coalesce(e.cohort, a.cohort) AS cohort, coalesce(e.unit, a.unit) AS unit, e.unit IS NULL AS extra, a.unit IS NULL AS missing, e.spent AS es, a.spent AS s, e.n_orders AS eo, a.n_orders AS o FROM e FULL JOIN a ON e.cohort = a.cohort AND e.unit = a.unit),
l AS (SELECT cohort, unit, extra, missing, unnest(['spent', 'n_orders']) AS "column", unnest([es, eo]) AS expected, unnest([s, o]) AS actual, unnest([1e-9, 0e0]) AS tolerance FROM j)"""


@query(f"""WITH {PEOPLE}, {DIFF} SELECT cohort, unit, "column", round(expected, 6) AS expected, round(actual, 6) AS actual, CASE WHEN missing THEN 'missing' WHEN extra THEN 'extra' ELSE 'differs' END AS problem FROM l
WHERE missing OR extra OR NOT (expected IS NOT DISTINCT FROM actual OR coalesce(abs(expected - actual) <= tolerance, false))""")
def val10_tolerance_diff(spark, d):
    """A table of results against a copy with planted changes: within and beyond the tolerance, lost values and renamed units."""
    e = panels.people(spark, d).select("cohort", "unit", "spent", "n_orders").where("spent IS NOT NULL")
    u = F.col("unit")
    a = e.select(
        "cohort", (u + F.when(u % 17 == 0, 1000000).otherwise(0)).alias("unit"),
        F.when(u % 5 == 0, F.col("spent") + 0.5e-9).when(u % 7 == 0, F.col("spent") + 1e-6).otherwise(F.col("spent")).alias("spent"), F.when(u % 11 != 0, F.col("n_orders")).alias("n_orders"),
    )
    return rounded(validate.differences(e, a, ["cohort", "unit"], {"spent": 1e-9, "n_orders": 0.0}))


@query("SELECT 'page' || r_regionkey || '.md' AS path, 'lost' || r_regionkey || '.md' AS link FROM region")
def val09_broken_links(spark, d):
    pages = panels.table(spark, d, "region").select(F.concat(F.lit("page"), "r_regionkey", F.lit(".md")).alias("path"), F.concat(F.lit("see [a](page0.md#x), [b](lost"), "r_regionkey", F.lit(".md) and [c](https://example.org/)")).alias("text"))
    return validate.broken_links(pages, pages.select(F.col("path").alias("link"))).select("path", "link")

