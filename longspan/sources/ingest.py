"""Reading cohort folders of daily CSV files into one person-day table, and writing results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.functions.numeric import nan_to_null

KEYS = ("cohort", "unit", "date")
COHORT = r"_(\d+)$"


def cohort_index(name: Column) -> Column:
    return F.regexp_extract(name, COHORT, 1).try_cast("int")


def path_part(path: Column, from_end: int) -> Column:
    """A folder of a path, counted from its end (1: the file)."""
    return F.element_at(F.split(path, "/"), -from_end)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length of all files below ``root``, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def cohorts(spark: SparkSession, root: str, prefix: str = "INS-W_") -> DataFrame:
    """cohort, cohort_index, n_files of the cohort folders below ``root``, in order; a missing root is an error."""
    name = F.regexp_extract("path", f"/({re.escape(prefix)}[^/]+)/", 1)
    found = listing(spark, root).select(name.alias("cohort")).where("cohort <> ''")
    return found.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_files")).withColumn("cohort_index", cohort_index(F.col("cohort"))).orderBy("cohort")


def audit_root(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("cohort").alias("n_cohorts"), F.array_sort(F.collect_set("cohort")).alias("cohorts"))


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, columns: list[str] | None = None, cohort_level: int | None = None) -> DataFrame:
    """CSV with a header, index columns without a name dropped, only ``columns`` read where given.

    ``cohort_level`` adds ``cohort`` from the folder so many levels above the file's end.
    """
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if cohort_level:
        df = df.withColumn("cohort", path_part(F.input_file_name(), cohort_level))
    unnamed = [c for c in df.columns if not c or re.match(r"(Unnamed|_c\d)", c)]
    df = df.drop(*unnamed)
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in columns or c == "cohort"])
    return nan_to_null(df)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cached_csv(spark: SparkSession, path: str, columns: list[str], cache: str, schema: str | None = None) -> DataFrame:
    """``columns`` of the CSV files at ``path``, kept as Parquet in ``cache`` under the digest of the files and the columns.

    The digests are made where the files lie; only one of 64 characters comes to the
    driver.  A copy counts once its success marker is there, so a job that broke off
    is made anew; a changed, added or removed file, or other columns, have another place.
    """
    files = file_hashes(spark, path).select(F.concat_ws(":", F.element_at(F.split("path", "/"), -1), "length", "sha256").alias("f"))
    parts = files.groupBy(F.pmod(F.xxhash64("f"), F.lit(1024)).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("f")), "\n"), 256).alias("h"))
    whole = parts.agg(F.sha2(F.concat_ws("\n", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), F.lit("|".join([*sorted(columns), schema or ""]))), 256)).first()[0]
    place = f"{cache}/{whole}"
    if not exists(spark, f"{place}/_SUCCESS"):
        read_csv(spark, path, schema, columns).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def platforms(spark: SparkSession, path: str) -> DataFrame:
    """unit and its first platform (the part before ``;``), lower-cased, of a platform file with ``pid`` and ``platform``."""
    first = F.lower(F.trim(F.split("platform", ";")[0]))
    return read_csv(spark, path, "pid string, platform string").select(F.col("pid").alias("unit"), F.when(first != "", first).alias("platform"))


def file_shapes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, n_rows, n_columns of CSV files."""
    rows = spark.read.text(paths).select(F.input_file_name().alias("path"), "value").where("value <> ''")
    counts = rows.groupBy("path").agg((F.count(F.lit(1)) - 1).alias("n_rows"))
    heads = rows.groupBy("path").agg(F.max(F.size(F.split("value", ","))).alias("n_columns"))
    return counts.join(heads, "path")


def dated(df: DataFrame, pid: str = "pid") -> DataFrame:
    """unit as text and date at day grain."""
    return df.withColumn("unit", F.col(pid).cast("string")).withColumn("date", F.to_date("date")).drop(*([pid] if pid != "unit" else []))


def labels(df: DataFrame, wanted: list[str], main: str) -> DataFrame:
    """Only the label columns that exist, with ``label_available``."""
    kept = [c for c in wanted if c in df.columns]
    return df.select("unit", "date", *kept, F.col(main).isNotNull().alias("label_available"))


def prefixed(df: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{name}__{c}" for c in df.columns if c not in keys})


def person_days(families: dict[str, DataFrame], weekly: DataFrame, platforms: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Families joined on all days of any, then labels of the day and the unit's platform, with coverage."""
    out = None
    for name, df in families.items():
        df = prefixed(df, name, keys)
        out = df if out is None else out.join(df, list(keys), "full")
    features = [c for c in out.columns if c not in keys]
    out = out.join(weekly, list(keys), "left").join(platforms, [k for k in keys if k != "date"], "left")
    return out.withColumn("feature_coverage", coverage(features)).withColumn("label_available", F.coalesce("label_available", F.lit(False)))


def coverage(columns: list[str]) -> Column:
    """Share of the columns that are not null in a row."""
    known = [F.col(f"`{c}`").isNotNull().cast("int") for c in columns]
    return sum(known[1:], known[0]) / F.lit(float(len(columns)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def repeat_pairs(texts: DataFrame, column: str, key: str) -> DataFrame:
    """(cohort, unit) pairs of a nested JSON map: both cohorts, and the text before ``#``."""
    kind = f"`{key}` map<string,map<string,array<string>>>"
    outer = texts.select(F.explode(F.from_json(column, kind)[key]).alias("first", "inner"))
    pairs = outer.select("first", F.explode("inner").alias("second", "ids")).select("first", "second", F.explode("ids").alias("id"))
    unit = F.split("id", "#", 2)[0]
    return pairs.select("first", unit.alias("unit")).union(pairs.select("second", unit)).toDF("cohort", "unit").distinct()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def latex_rows(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """One table line per row: ``_`` and ``%`` escaped, doubles with fixed digits."""
    kind = dict(df.dtypes)
    cells = [F.coalesce(F.format_string(f"%.{digits}f", F.col(c)) if kind[c] == "double" else F.regexp_replace(F.col(c).cast("string"), "([_%])", r"\\$1"), F.lit("--")) for c in columns]
    return df.withColumn("latex", F.concat(F.array_join(F.array(*cells), " & "), F.lit(r" \\")))
