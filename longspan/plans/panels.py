"""The driver's tables as panels: cohort, unit, date and values.

Sums are made of whole numbers (cents, hundredths), so they do not depend on the
order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGETS = ["line_count", "qty_sum", "returned_qty", "mean_discount", "mean_tax", "open_share"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(c: str, scale: int = 100):
    """The whole number next to c * scale, halves away from zero, as ``round`` but without its decimal numbers; a value that is none is an error."""
    x = F.col(c) * scale
    near = F.rint(x)  # halves to even; the difference is exact
    return (near + F.when((x - near == 0.5) & (x > 0), 1.0).when((x - near == -0.5) & (x < 0), -1.0).otherwise(0.0)).cast("long")


def supplier_weeks(spark: SparkSession, d: str) -> DataFrame:
    """One row per supplier and week with shipments: cohort is the region."""
    place = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    place = place.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("cohort"))
    day = F.to_date("l_shipdate")
    lines = table(spark, d, "lineitem").withColumn("date", F.date_sub(day, F.weekday(day)))
    n = F.count(F.lit(1))
    weeks = lines.groupBy(F.col("l_suppkey"), "date").agg(
        n.alias("line_count"),
        F.sum(whole("l_quantity", 1)).cast("double").alias("qty_sum"),
        F.sum(F.when(F.col("l_returnflag") == "R", whole("l_quantity", 1))).cast("double").alias("returned_qty"),
        (F.sum(whole("l_discount")) / (n * 100.0)).alias("mean_discount"),
        (F.sum(whole("l_tax")) / (n * 100.0)).alias("mean_tax"),
        (F.count_if(F.col("l_linestatus") == "O") / (n * 1.0)).alias("open_share"),
    )
    return weeks.join(place, "l_suppkey").select("cohort", F.col("l_suppkey").alias("unit"), "date", F.col("line_count").cast("double").alias("line_count"), *TARGETS[1:])


def long(df: DataFrame, targets: list[str], keys: tuple[str, ...] = ("cohort", "unit", "date")) -> DataFrame:
    return df.unpivot(list(keys), targets, "target", "value")


def labelled_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth week has a label: whether returns are over half of the quantity."""
    w = supplier_weeks(spark, d)
    return w.where(F.pmod(F.floor(F.unix_date("date") / 7), F.lit(4)) == 0).withColumn("label", (F.coalesce("returned_qty", F.lit(0.0)) > F.col("qty_sum") / 2).cast("int"))


def user_days(spark: SparkSession, d: str) -> DataFrame:
    """cohort, unit, date, target, n_events, value_sum, by event type."""
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 4).cast("int").alias("cohort"), F.col("user_id").alias("unit"), F.to_date("ts").alias("date"), F.col("event_type").alias("target")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events"), (F.sum(whole("value")) / 100.0).alias("value_sum")
    )


def part_days(spark: SparkSession, d: str) -> DataFrame:
    """Events up to the end of the morning, afternoon and evening of each user's day."""
    e = table(spark, d, "events")
    at = lambda h: F.count_if(F.hour("ts") < h).alias
    return e.groupBy((F.col("user_id") % 4).cast("int").alias("cohort"), F.col("user_id").alias("unit"), F.to_date("ts").alias("date")).agg(at(12)("morning"), at(18)("afternoon"), at(24)("evening"))


def people(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer: region, segment and three measures that may be missing."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), (F.sum(whole("o_totalprice")) / 100000.0).alias("spent"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("n_closed")
    )
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("n_regionkey").alias("cohort"), F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("platform"), F.col("c_acctbal").alias("balance")).join(o, "unit", "left")


def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: cohort is the language, the cluster is the source, the score the length."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("cohort"), F.col("source").alias("cluster"), F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
