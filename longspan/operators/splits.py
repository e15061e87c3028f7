"""Chronological, grouped and stratified splits; each returns the rows with a role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.hashing import draw_hash
from longspan.sources.workspace import written

from . import ranking
from .windows import Trajectory


def role(is_test: Column) -> Column:
    return F.when(is_test, "test").otherwise("train")


def by_cohort(df: DataFrame, train: list, test: list) -> DataFrame:
    """Labelled rows of the train and test cohorts."""
    c = F.col("cohort")
    return df.where(F.col("label").isNotNull() & c.isin(*train, *test)).withColumn("role", role(c.isin(*test)))


def within_unit(df: DataFrame, t: Trajectory, test_share: float, least: int = 4, least_train: int = 2) -> DataFrame:
    """The last rows are the test: max(1, half-even round of n * share); short trajectories go."""
    n = t.size()
    n_test = F.greatest(F.lit(1), F.bround(n * F.lit(test_share), 0).cast("int"))
    out = df.withColumn("n_rows", n).withColumn("n_test", n_test).withColumn("position", t.position())
    out = out.where((F.col("n_rows") >= least) & (F.col("n_rows") - F.col("n_test") >= least_train))
    return out.withColumn("role", role(F.col("position") >= F.col("n_rows") - F.col("n_test")))


def role_bits(df: DataFrame, t: Trajectory, shares: list[float], least: int = 4, least_train: int = 2) -> DataFrame:
    """Adds ``roles``: the roles of ``within_unit`` for every share in one number, two bits each.

    Bit 2c is set for a training row of the c-th share, bit 2c + 1 for a test row, none
    where the trajectory is too short for it; all shares need one sort.
    """
    out = df.withColumn("_n", t.size()).withColumn("_at", t.position())
    bits = F.lit(0)
    for c, share in enumerate(shares):
        n_test = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share), 0).cast("int"))
        usable = (F.col("_n") >= least) & (F.col("_n") - n_test >= least_train)
        bits = bits + F.when(usable, F.when(F.col("_at") >= F.col("_n") - n_test, 2 << (2 * c)).otherwise(1 << (2 * c))).otherwise(0)
    return out.withColumn("roles", bits.cast("int")).where("roles > 0").drop("_n", "_at")


def forecast(df: DataFrame, t: Trajectory, test_share: float, least: int = 5) -> DataFrame:
    """cut = max(1, floor(n * (1 - share))), with one test row at least."""
    n = t.size()
    cut = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(1.0 - test_share)).cast("int")), n - 1)
    out = df.withColumn("n_rows", n).withColumn("cut", cut).withColumn("position", t.position())
    return out.where(F.col("n_rows") >= least).withColumn("role", role(F.col("position") >= F.col("cut")))


def floor_split(df: DataFrame, t: Trajectory, train_share: float = 0.65, least: int = 4) -> DataFrame:
    out = df.withColumn("n_rows", t.size()).withColumn("position", t.position()).where(F.col("n_rows") >= least)
    cut = F.least(F.greatest(F.lit(1), F.floor(F.col("n_rows") * F.lit(train_share)).cast("int")), F.col("n_rows") - 1)
    return out.withColumn("role", role(F.col("position") >= cut))


def held_out_units(df: DataFrame, keys: list[str], test_share: float, seed: int, least: int = 4) -> DataFrame:
    """Whole groups of ``least`` rows or more, in the order of a hash; the first ceil(share * groups) are the test.

    The place of a group in the order comes from ranges of the hash, so no task holds the order of all.
    """
    groups = df.groupBy(*keys).count().where(F.col("count") >= least).withColumn("u", draw_hash(F.lit(seed), *[F.col(k) for k in keys]))
    placed = ranking.numbered(groups.select(*keys, "u"), [], ["u", *keys])
    is_test = F.col("i") < F.ceil(F.col("n") * F.lit(test_share))
    return df.join(placed.select(*keys, is_test.alias("is_test")), keys).withColumn("role", role(F.col("is_test"))).drop("is_test")


def stratified_holdouts(df: DataFrame, stratum: str, unit: str, repetitions: int, test_share: float = 0.2) -> DataFrame:
    """``rep`` and role: in every stratum the first round(share * n) units in a hash order are the test.

    Places in the order come from ranges of the hash, so no task holds a stratum.
    """
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    drawn = reps.withColumn("_draw", draw_hash(F.col("rep"), F.col(unit)))
    placed = ranking.numbered(drawn, ["rep", stratum], ["_draw", unit])
    return placed.withColumn("role", role(F.col("i") < F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(test_share) + F.lit(0.5))))).drop("_draw", "i", "n")


def holdout_sums(df: DataFrame, stratum: str, unit: str, sums: dict[str, Column], repetitions: int, test_share: float = 0.2, deviations: float = 8.0) -> DataFrame:
    """rep and ``sums`` (aggregates that add up) over the test rows of ``stratified_holdouts``; units are unique in a stratum.

    Draws are uniform, so the last test unit's lies near the test share of their range.
    Units with smaller draws are added up where they are; only those within
    ``deviations`` of that place, of the order of the root of a stratum, are put in order.
    """
    k = F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(test_share) + F.lit(0.5)))
    p = F.col("_k") / F.col("_size")
    around = deviations * F.sqrt(p * (1 - p) / F.col("_size")) + 2 * deviations / F.col("_size")
    strata = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size")).withColumn("_k", k)
    strata = written(strata.select(stratum, "_k", ((p - around) * 2.0**48).alias("_low"), ((p + around) * 2.0**48).alias("_high")), "strata")
    # dealt anew: a row is ``repetitions`` draws, and a small table is one file
    rows = ranking.join_on(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), strata, [stratum])
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).withColumn("_draw", draw_hash(F.col("rep"), F.col(unit)))
    near = F.col("_draw") >= F.col("_low")
    kept = rows.where(F.col("_draw") <= F.col("_high")).groupBy("rep", stratum, "_k", F.when(near, F.col("_draw")).alias("_at"), F.when(near, F.col(unit)).alias("_unit"))
    kept = written(kept.agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(name) for name, c in sums.items()]), "near-the-last")
    found = kept.groupBy("rep", stratum, "_k").agg(F.sum(F.when(F.col("_at").isNull(), F.col("_rows")).otherwise(0)).alias("_sure"), F.sum("_rows").alias("_all"))
    if found.where("_sure <= _k AND _all >= _k").count() < repetitions * strata.count():
        return holdout_sums(df, stratum, unit, sums, repetitions, test_share, float("inf"))
    w = Window.partitionBy("rep", stratum).orderBy(F.col("_at").asc_nulls_first(), "_unit").rowsBetween(Window.unboundedPreceding, -1)
    tested = kept.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0))).where("_before < _k")
    return tested.groupBy("rep").agg(*[F.sum(name).alias(name) for name in sums])


def leave_one_out(df: DataFrame, cohorts: list, cohort: str = "cohort") -> DataFrame:
    """Every row once for each held-out cohort."""
    out = df.withColumn("held_out", F.explode(F.array(*[F.lit(c) for c in cohorts])))
    return out.withColumn("role", role(F.col(cohort) == F.col("held_out")))


def blocks(n: Column) -> list[tuple[str, str, str, Column, Column]]:
    """(regime, half, role, first place, place after the last) of the blocks of a trajectory of ``n`` rows, for three ways to cut it.

    With e = 65 % (rounded down) and m in the middle of the rest (rounded up):
    fixed trains on 0-e and tests e-m and m-n; expanding also trains the late
    half on 0-m; disjoint trains on 0-35 % and tests 35-50 %, then trains on
    50-85 % and tests 85-100 %.
    """
    at = lambda share: F.floor(n * F.lit(share))
    zero, end = F.lit(0), at(0.65)
    middle = end + F.ceil((n - end) / F.lit(2.0))
    return [
        ("fixed", "early", "train", zero, end), ("fixed", "early", "test", end, middle),
        ("fixed", "late", "train", zero, end), ("fixed", "late", "test", middle, n),
        ("expanding", "early", "train", zero, end), ("expanding", "early", "test", end, middle),
        ("expanding", "late", "train", zero, middle), ("expanding", "late", "test", middle, n),
        ("disjoint", "early", "train", zero, at(0.35)), ("disjoint", "early", "test", at(0.35), at(0.5)),
        ("disjoint", "late", "train", at(0.5), at(0.85)), ("disjoint", "late", "test", at(0.85), n),
    ]


def regimes(position: Column, n: Column, role: str | None = None) -> Column:
    """(regime, half, role) of a row at ``position`` among ``n``; ``role``: only the blocks of that role."""
    found = [
        F.when((position >= low) & (position < high), F.struct(F.lit(name).alias("regime"), F.lit(half).alias("half"), F.lit(r).alias("role")))
        for name, half, r, low, high in blocks(n)
        if role in (None, r)
    ]
    return F.filter(F.array(*found), lambda b: b.isNotNull())


def block_bits(position: Column, n: Column) -> Column:
    """The blocks of a row at ``position`` among ``n`` as one number: bit b is set for the b-th of ``blocks``."""
    bits = F.lit(0)
    for b, (_, _, _, low, high) in enumerate(blocks(n)):
        bits = bits + F.when((position >= low) & (position < high), 1 << b).otherwise(0)
    return bits


def with_regimes(df: DataFrame, t: Trajectory) -> DataFrame:
    out = df.withColumn("position", t.position()).withColumn("n_rows", t.size())
    return out.withColumn("block", F.explode(regimes(F.col("position"), F.col("n_rows")))).select("*", "block.regime", "block.half", "block.role").drop("block")
