"""Bootstrap, permutation and simulation with reproducible, hash-made draws."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.functions.numeric import EPS, probit
from longspan.sources.workspace import written

from . import draws


def interval(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The 2.5 and 97.5 % quantiles of draws."""
    return df.groupBy(*by).agg(F.count(value).alias("n_draws"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def permutation_p(null: DataFrame, statistic: str, observed: Column) -> DataFrame:
    return null.agg(((F.count_if(F.col(statistic) >= observed) + 1) / (F.count(statistic) + F.lit(1.0))).alias("p"))


def detectable_r(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest correlation that ``n`` pairs detect, by Fisher's transform."""
    return F.when(n > 3, F.tanh((probit(F.lit(1 - alpha / 2)) + probit(F.lit(power))) / F.sqrt(n - 3)))


def normal_draw(*parts: Column) -> Column:
    """A standard normal number from the md5 of the parts joined with ``|`` (two uniforms, by Box and Muller)."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    uniform = lambda at: (F.conv(F.substring(digest, at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(2.0 * math.pi * uniform(13))


def shift_of(area: float) -> float:
    """How far apart two unit normals are whose area is ``area``."""
    return math.sqrt(2.0) * NormalDist().inv_cdf(area)


def simulate_power(designs: DataFrame, areas: list[float], simulations: int) -> DataFrame:
    """true_auc, simulation, mean_auc: mean area over units with binormal scores.

    ``designs`` (unit, n_positive, n_negative) has a row per unit.  Scores are hash
    draws, the same for every area, to which positives add the area's shift.  A unit's
    draws of one simulation are one row's arrays, so only areas' sums are shuffled.
    """
    parallel = 8 * designs.sparkSession.sparkContext.defaultParallelism  # a number of its own, so small designs are not put together
    rows = designs.where("n_positive > 0 AND n_negative > 0").repartition(parallel, "unit").withColumn("simulation", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
    scores = lambda first, last: F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda k: normal_draw(F.col("simulation"), F.col("unit"), k))
    p, n = F.col("n_positive"), F.col("n_negative")
    rows = rows.select("simulation", scores(F.lit(1), p).alias("pos"), scores(p + 1, p + n).alias("neg"))
    shifts = np.array([shift_of(a) for a in areas])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for pos, neg in zip(part.column("pos"), part.column("neg")):
                pos, neg = (v.values.to_numpy(zero_copy_only=False) for v in (pos, neg))
                below = np.searchsorted(np.sort(neg), pos[None, :] + shifts[:, None], side="right")
                out.append(below.sum(1) / (len(pos) * len(neg)))
            yield pa.RecordBatch.from_arrays([part.column("simulation"), pa.array([list(v) for v in out], pa.list_(pa.float64()))], ["simulation", "aucs"])

    units = rows.mapInArrow(run, "simulation int, aucs array<double>").select("simulation", F.posexplode("aucs").alias("area", "auc"))
    value = F.element_at(F.array(*[F.lit(float(a)) for a in areas]), F.col("area") + 1)
    return units.groupBy("area", "simulation").agg(F.avg("auc").alias("mean_auc")).select(value.alias("true_auc"), "simulation", "mean_auc")


#: Units of one design that a task simulates together, and simulations of a batch.
UNITS, SIMULATIONS = 64, 1000
#: The normal distribution function on a grid; straight lines between its places are right to 1e-8.
GRID = np.linspace(-9.0, 9.0, 72_001)


def normal_share(x: np.ndarray) -> np.ndarray:
    return np.interp(x, GRID, _shares())


@functools.lru_cache(maxsize=1)
def _shares() -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in GRID])


def sampled_areas(positives: int, negatives: int, shift: float, shape: tuple[int, ...], rng: np.random.Generator) -> np.ndarray:
    """Areas of binormal samples: drawn scores of the smaller class, and of the larger one only how many lie between them.

    Of the negatives above one positive, those below the next are binomial in the
    share of the distribution between the two, so a sample costs its smaller class.
    """
    few, many = min(positives, negatives), max(positives, negatives)
    score = np.sort(rng.standard_normal((*shape, few)), axis=-1) + shift  # by symmetry positives and negatives change places
    share, below, before = normal_share(score), np.zeros(shape, np.int64), np.zeros(shape)
    wins = np.zeros(shape, np.int64)
    for i in range(few):
        p = np.clip((share[..., i] - before) / np.maximum(1.0 - before, 1e-300), 0.0, 1.0)
        below = below + rng.binomial(many - below, p)
        wins += below
        before = share[..., i]
    return wins / (positives * negatives)


#: Most pairs (positives x negatives) and rows of a unit whose distribution of pairs is computed; frequencies that a task sweeps together.
PAIRS, UNIT_ROWS, FREQUENCIES = 4096, 160, 32
#: Nodes of a panel of the sweep, rows expected in one at most, and how far the sweep goes beyond the means.
NODES, PANEL_ROWS, REACH = 16, 8.0, 6.5


def _panels(positives: int, negatives: int, shift: float) -> np.ndarray:
    """Edges of panels of at most PANEL_ROWS expected rows and a width of 1: a power of the share below varies little within one."""
    edges, end = [min(0.0, shift) - REACH], max(0.0, shift) + REACH
    rows = lambda a, b: positives * (NormalDist(shift).cdf(b) - NormalDist(shift).cdf(a)) + negatives * (NormalDist().cdf(b) - NormalDist().cdf(a))
    while edges[-1] < end:
        width = min(1.0, end - edges[-1])
        while rows(edges[-1], edges[-1] + width) > PANEL_ROWS:
            width *= 0.75
        edges.append(edges[-1] + width)
    return np.array(edges)


def pair_transforms(most: dict[int, int], shift: float, roots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each number of positives i, mean root ** (ordered pairs) for 0 .. most[i] negatives (rows) and each root (columns).

    ``most`` does not grow with i.  The largest of i positives and j negatives below x is a positive, which makes j pairs,
    or a negative, which makes none, so the mean for (i, j) is an integral over x of those for (i - 1, j) and (i, j - 1).
    Integrals are exact for polynomials of NODES - 1 degrees within a panel.
    """
    node, weight = np.polynomial.legendre.leggauss(NODES)
    powers = node[:, None] ** np.arange(NODES)
    upto = ((node[:, None] ** np.arange(1, NODES + 1) - (-1.0) ** np.arange(1, NODES + 1)) / np.arange(1, NODES + 1)) @ np.linalg.inv(powers)
    edges = _panels(max(most), most[0], shift)
    panels, half = len(edges) - 1, np.diff(edges)[:, None] / 2
    x = edges[:-1, None] + half * (node + 1)
    density = [(half * np.exp(-((x - m) ** 2) / 2))[..., None] / math.sqrt(2 * math.pi) for m in (shift, 0.0)]
    power = roots[None, :] ** np.arange(most[0] + 1)[:, None]
    above: list[np.ndarray] = []
    for i in range(max(most) + 1):
        row, ends = [], []
        for j in range(most[i] + 1):
            if i == j == 0:
                row.append(np.ones((panels, NODES, len(roots)), complex))
                ends.append(np.ones(len(roots), complex))
                continue
            rate = np.zeros((panels, NODES, len(roots)), complex)
            if i:
                rate += (i * density[0]) * power[j] * above[j]
            if j:
                rate += (j * density[1]) * row[j - 1]
            flat = rate.view(float)
            inside, whole = (upto @ flat).view(complex), (weight @ flat).view(complex)
            before = np.cumsum(whole, axis=0)
            inside[1:] += before[:-1, None]
            row.append(inside)
            ends.append(before[-1])
        above = row
        yield i, np.array(ends)


def drawn_sums(shares: np.ndarray, times: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Sums of ``times`` draws of 0 .. len(shares) - 1 with these shares, drawn from the distribution of the sum.

    The distribution is the power of one draw's transform.  Where a sum can take many values, it is kept modulo a width outside of
    which a sum falls with a chance below 2 e**-80 by Bernstein's inequality.
    """
    top, values = len(shares) - 1, np.arange(len(shares))
    mean = float(shares @ values)
    reach = 80 * top / 3 + math.sqrt((80 * top / 3) ** 2 + 160 * times * float(shares @ (values - mean) ** 2))
    width = min(times * top, 2 * math.ceil(reach)) + 1
    size = 1 << max(1, (width - 1).bit_length())
    wrapped = np.bincount(values % size, shares, size)
    sums = np.fft.irfft(np.fft.rfft(wrapped) ** times, size)
    low = 0 if times * top < size else math.floor(times * mean) - size // 2
    upto = np.cumsum(np.maximum(np.roll(sums, -(low % size)), 0.0))
    return low + np.minimum(np.searchsorted(upto, rng.random(draws) * upto[-1], side="right"), size - 1)


def _counted_power(counts: DataFrame, areas: list[float], simulations: int, seed: int) -> DataFrame:
    """area, draw, sums: summed areas of all units of ``counts`` (n_positive, n_negative, m), drawn from the sums' distributions."""
    spark = counts.sparkSession
    parallel = 8 * spark.sparkContext.defaultParallelism
    kinds = [(r.n_positive, r.n_negative) for r in counts.select("n_positive", "n_negative").collect()]  # at most as many as products up to PAIRS
    size = max((p * n for p, n in kinds), default=1) + 1
    most, wanted = {}, {}
    for p, n in kinds:
        wanted.setdefault(p, []).append(n)
    for i in range(max(wanted, default=0), -1, -1):
        most[i] = max([*wanted.get(i, ()), most.get(i + 1, 0)])

    def sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for area, first in zip(part["area"], part["first"]):
                roots = np.exp(-2j * np.pi * np.arange(first, min(size // 2 + 1, first + FREQUENCIES)) / size)
                for i, means in pair_transforms(most, shift_of(areas[area]), roots):
                    of = wanted.get(i, [])
                    if of:
                        yield pd.DataFrame({"area": area, "n_positive": i, "n_negative": of, "first": first, "re": list(means[of].real), "im": list(means[of].imag)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for r in part.itertuples():
                means = np.concatenate([np.asarray(x["re"]) + 1j * np.asarray(x["im"]) for x in sorted(r.parts, key=lambda x: x["first"])])
                shares = np.maximum(np.fft.irfft(means, size)[: r.n_positive * r.n_negative + 1], 0.0)
                rng = np.random.default_rng([seed, r.area, r.n_positive, r.n_negative])
                sums = drawn_sums(shares / shares.sum(), r.m, simulations, rng) / (r.n_positive * r.n_negative)
                total[r.area] = total.get(r.area, 0.0) + sums
        for area, sums in total.items():
            for draw in range(0, simulations, SIMULATIONS):
                yield pd.DataFrame({"area": [area], "draw": [draw], "sums": [sums[draw : draw + SIMULATIONS]]})

    tasks = spark.range(len(areas)).select(F.col("id").cast("int").alias("area"), F.explode(F.sequence(F.lit(0), F.lit(size // 2), F.lit(FREQUENCIES))).alias("first"))
    means = tasks.repartition(parallel, "area", "first").mapInPandas(sweep, "area int, n_positive long, n_negative long, first int, re array<double>, im array<double>")
    means = means.groupBy("area", "n_positive", "n_negative").agg(F.collect_list(F.struct("first", "re", "im")).alias("parts"))  # size / 2 numbers
    return means.join(F.broadcast(counts), ["n_positive", "n_negative"]).mapInPandas(run, "area int, draw int, sums array<double>")


def sampled_power(designs: DataFrame, areas: list[float], simulations: int, seed: int = 20_260_831, pairs: int = PAIRS) -> DataFrame:
    """true_auc, simulation, mean_auc as ``simulate_power``, by exact sampling of the areas themselves.

    Units of one (n_positive, n_negative) are alike.  Up to ``pairs`` pairs (and UNIT_ROWS rows) a unit, the
    distribution of a unit's area gives that of all alike units' sum, from which it is drawn, so
    work grows with the kinds of units.  Larger units are counted and simulated UNITS at a
    time; every piece has a seed of its own, so results do not depend on tasks.
    """
    counts = designs.where("n_positive > 0 AND n_negative > 0").groupBy("n_positive", "n_negative").agg(F.count(F.lit(1)).alias("m"))
    counts = written(counts, "kinds")
    few = (F.col("n_positive") * F.col("n_negative") <= pairs) & (F.col("n_positive") + F.col("n_negative") <= UNIT_ROWS)
    pieces = counts.where(~few).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(UNITS).cast("long"))))
    pieces = pieces.withColumn("area", F.explode(F.array(*[F.lit(i) for i in range(len(areas))]))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1), F.lit(SIMULATIONS))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                rng = np.random.default_rng([seed, r.area, r.draw, r.n_positive, r.n_negative, r.first])
                shape = (min(UNITS, r.m - r.first), min(SIMULATIONS, simulations - r.draw))
                yield pd.DataFrame({"area": [r.area], "draw": [r.draw], "sums": [sampled_areas(r.n_positive, r.n_negative, shift_of(areas[r.area]), shape, rng).sum(0)]})

    spread = pieces.repartition(2 * designs.sparkSession.sparkContext.defaultParallelism, "n_positive", "n_negative", "first", "area", "draw")
    simulated = spread.mapInPandas(run, "area int, draw int, sums array<double>")
    sums = draws.summed(_counted_power(counts.where(few), areas, simulations, seed).unionByName(simulated), ["area"], ["total"])
    n = counts.agg(F.sum("m").alias("units"))
    value = F.element_at(F.array(*[F.lit(float(a)) for a in areas]), F.col("area") + 1)
    return sums.join(F.broadcast(n), F.lit(True)).select(value.alias("true_auc"), F.col("draw").alias("simulation"), (F.col("total") / F.col("units")).alias("mean_auc"))


def permuted_profiles(pairs: DataFrame, n_draws: int, least: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, draw, mean_cosine: late profiles dealt anew within cohorts, against the early ones (cohort, unit, early, late)."""
    sums = draws.permutation_sums(pairs, "cohort", ["unit"], F.col("early"), F.col("late"), n_draws, draws.masked_cosines(least), ["total", "n"], by=by)
    return sums.select(*by, "draw", (F.col("total") / F.nullif(F.col("n"), F.lit(0.0))).alias("mean_cosine"))


def permuted_correlations(df: DataFrame, x: list[str], y: list[str], n_draws: int, stratum: str, order: list[str]) -> DataFrame:
    """draw and a column ``x|y`` for each pair: correlations over complete rows with ``y`` dealt anew within strata.

    Means and spreads do not change by dealing, so only the sums of products are made
    for each draw, of standardised columns; null where a column does not vary.
    """
    rows = written(df.dropna(subset=[*x, *y]).select(stratum, *order, *x, *y), "complete")
    moments = rows.agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{k}_{c}") for c in (*x, *y) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.when(F.col(f"_s_{c}") > EPS, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
    pairs = [f"{a}|{b}" for a in x for b in y]
    sums = draws.permutation_sums(rows.join(F.broadcast(moments), F.lit(True)), stratum, order, F.array(*map(z, x)), F.array(*map(z, y)), n_draws, draws.cross_products, pairs)
    varies = moments.select("_n", *[(F.col(f"_s_{c}") > EPS).alias(f"_v_{c}") for c in (*x, *y)])
    out = sums.join(F.broadcast(varies), F.lit(True))
    return out.select("draw", *[F.when(F.col(f"_v_{a}") & F.col(f"_v_{b}"), F.col(f"{a}|{b}") / F.col("_n")).alias(f"{a}|{b}") for a in x for b in y])
