"""Checks of the data contract: each returns what is wrong, or raises where asked to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks the contract."""


def out_of_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """column, n_bad: values that are no finite number within the bounds, one pass for all columns."""
    bad = []
    for c, (low, high) in bounds.items():
        x = F.col(c).try_cast("double")
        bad.append(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNotNull() & (x.isNull() | F.isnan(x) | ~x.between(low, high))).alias("n_bad")))
    return df.agg(F.array(*bad).alias("bad")).select(F.inline("bad"))


def require_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """The table with numeric columns, or an error that names the bad ones."""
    wrong = {r["column"]: r["n_bad"] for r in out_of_bounds(df, bounds).where("n_bad > 0").collect()}
    if wrong:
        raise ContractError(f"values out of bounds: {wrong}")
    return df.withColumns({c: F.col(c).try_cast("double") for c in bounds})


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    for side in (left, right):
        if not duplicate_keys(side, keys).isEmpty():
            raise ContractError(f"keys {keys} are not unique")
    return left.join(right, keys, how)


def require_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.count(), after.count()
    if a != b:
        raise ContractError(f"{a} rows became {b}")
    return after


def require_columns(df: DataFrame, columns: list[str], least: dict[str, int] | None = None) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"columns missing: {missing}")
    few = df.agg(*[F.count(c).alias(c) for c in (least or {})]).first().asDict() if least else {}
    if short := {c: n for c, n in few.items() if n < least[c]}:
        raise ContractError(f"too few values: {short}")
    return df


def missing_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Combinations of two columns' values that do not occur."""
    pairs = df.select(a, b).distinct()
    held = pairs.groupBy(a).agg(F.collect_set(b).alias("_held"))
    every = df.agg(F.collect_set(b).alias("_all"))  # the values of one axis of the grid
    return held.join(every, F.lit(True)).select(a, F.explode(F.array_except("_all", "_held")).alias(b))


def unmapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    return df.select(column).distinct().join(mapping, column, "left_anti")


def missing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """cohort, file, problem: expected files that are absent or empty."""
    state = expected.join(found, ["cohort", "file"], "left")
    return state.where("length IS NULL OR length = 0").select("cohort", "file", F.when(F.col("length").isNull(), "missing").otherwise("empty").alias("problem"))


def differences(expected: DataFrame, actual: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """keys, column, expected, actual, problem of two result tables, cell by cell.

    Rows are matched on ``keys``, where nulls are equal; a row of one side only is
    ``missing`` or ``extra``, once for each column.  Numbers may differ by the column's
    absolute tolerance (0: not at all); two nulls or two NaN are equal, one is not.
    Keys must be unique in both tables.
    """
    for side in (expected, actual):
        if not duplicate_keys(side, keys).isEmpty():
            raise ContractError(f"keys {keys} are not unique")
    cells = lambda df, side: df.select(*keys, F.map_from_arrays(F.array(*[F.lit(c) for c in tolerances]), F.array(*[F.col(c).cast("double") for c in tolerances])).alias(side))
    right = cells(actual, "actual").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = cells(expected, "expected").join(right, same, "full")
    rows = both.select(
        *[F.when(F.col("expected").isNotNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], "expected", "actual",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(t)).alias("tolerance")) for c, t in tolerances.items()])).alias("c"),
    )
    e, a = F.col("expected")[F.col("c.column")], F.col("actual")[F.col("c.column")]
    odd = lambda x: x.isNull() | F.isnan(x)
    equal = e.eqNullSafe(a) | (~odd(e) & ~odd(a) & (F.abs(e - a) <= F.col("c.tolerance")))
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(~equal, "differs")
    return rows.select(*keys, "c.column", e.alias("expected"), a.alias("actual"), problem.alias("problem")).where("problem IS NOT NULL")


def require_same(expected: DataFrame, actual: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """``actual``, or an error that counts the problems and shows the first of them."""
    found = differences(expected, actual, keys, tolerances)
    first = found.orderBy(*keys, "column").limit(5).collect()
    if first:
        raise ContractError(f"{found.count()} cells are not as expected, first {[r.asDict() for r in first]}")
    return actual


#: Limits of a public release.
MAX_BYTES = 20 * 1024 * 1024
FORBIDDEN_SUFFIXES = (".parquet", ".pkl", ".pickle", ".feather", ".h5", ".db", ".sqlite")
FORBIDDEN_PREFIXES = ("data/raw/", "data/processed/", "logs/")
IDENTIFIERS = ("pid", "user_id", "participant_id", "device_id", "email")


def release_problems(files: DataFrame, allowed: list[str]) -> DataFrame:
    """path, problem for files (path, length, header) that may not be published."""
    p = F.lower("path")
    checks = [
        (~F.lit(False) & ~F.exists(F.array(*[F.lit(a) for a in allowed]), lambda a: F.col("path").startswith(a)), "not on the list"),
        (F.exists(F.array(*[F.lit(s) for s in FORBIDDEN_SUFFIXES]), lambda s: p.endswith(s)), "forbidden kind"),
        (F.exists(F.array(*[F.lit(s) for s in FORBIDDEN_PREFIXES]), lambda s: p.startswith(s)), "forbidden folder"),
        (F.col("length") > MAX_BYTES, "too large"),
        (F.exists(F.split(F.lower(F.coalesce("header", F.lit(""))), ","), lambda c: F.trim(c).isin(*IDENTIFIERS)), "identifier column"),
    ]
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]), lambda x: x.isNotNull())
    return files.select("path", F.explode(found).alias("problem"))


def broken_links(pages: DataFrame, known: DataFrame) -> DataFrame:
    """path, link of Markdown links to relative places that do not exist; ``known`` has a column ``link``."""
    links = pages.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)#\s]+)[^)]*\)"), 1)).alias("link"))
    return links.where(~F.col("link").rlike("^[a-z]+:")).distinct().join(known, "link", "left_anti")


def close(value: float, wanted: float, tolerance: float = 1e-12) -> None:
    if not abs(value - wanted) <= tolerance:
        raise ContractError(f"{value} is not {wanted}")
