"""Thousands of draws by matrix products and by arithmetic partners.

Bootstrap: a draw is a vector of how often each row or cluster is taken, and sums
over the drawn rows are products of these weights with a matrix of the rows' values.
The weights are made in the tasks, once for each batch of draws.  Areas under the ROC curve over
drawn clusters come from one ordering of the scores, cut into ranges: a task adds up
its range's weighted counts for a batch of draws.

Permutation: a keyed bijection says by arithmetic which row's values a row gets in a
draw.  Rows are dealt once to pairs of blocks of their stratum, and each pair adds up
its part of every draw's statistic; values are not copied for each draw.

All blocks are of bounded size: BLOCK rows or clusters, BATCH draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.hashing import FIRST, PRIME, SECOND, draw_hash, partners, round_tables, scrambled
from longspan.sources.workspace import written

from .ranking import cells, join_on, numbered

#: Rows of a block of a permutation, clusters or rows of a block of weights, draws of a batch, cells of a task.
ROWS, BLOCK, BATCH, CELLS = 1 << 20, 1024, 500, 1 << 21
#: Cells of a range of scores for each cluster, at least.
CLUSTER_ROWS = 16
#: Key of the weights.
SEED = 20_260_830



def _folded(x: np.ndarray) -> np.ndarray:
    """Congruent modulo PRIME, which is 2^31 - 1, and shorter."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def slot_counts(n: int, draws: np.ndarray) -> np.ndarray:
    """draws x n: how often each of n things is taken when n are taken with replacement.

    The arithmetic of ``scrambled``; remainders are made by folding.
    """
    keys, out = scrambled(draws.astype(np.int64), SEED).astype(np.uint64), np.zeros((len(draws), n), np.uint16)
    step = max(CELLS // 16, n // 8)
    for lo in range(0, n, step):  # a stretch of slots at a time
        first = (np.arange(lo, min(n, lo + step), dtype=np.int64) % PRIME * FIRST % PRIME).astype(np.uint64)
        for d, key in enumerate(keys):
            t = first + key
            t = _folded(_folded(t * t) * np.uint64(SECOND) + key)
            t = _folded(_folded(t * t))
            t[t >= PRIME] -= np.uint64(PRIME)
            out[d] += np.bincount((t.astype(np.uint32) % np.uint32(n)).astype(np.int64), minlength=n).astype(np.uint16)
    return out


def weights(sizes: DataFrame, by: list[str], draws: int) -> DataFrame:
    """by, draw (first of its batch), block, w (bytes of draws x BLOCK counts) of every group; ``sizes``: by, n.

    A task holds the counts of one batch of a group: BATCH draws, or as few, one at
    least, as keep them to some two million numbers.
    """
    most = sizes.agg(F.max("n")).first()[0] or 1
    per = max(1, min(BATCH, CELLS // most))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sizes.select(*by).schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                n, first = int(row["n"]), int(row["draw"])
                counts = slot_counts(n, np.arange(first, min(draws, first + per)))
                for block in range(0, n, BLOCK):
                    yield pd.DataFrame({**{k: [row[k]] for k in by}, "draw": [first], "block": [block // BLOCK], "w": [counts[:, block : block + BLOCK].tobytes()]})

    rows = sizes.where("n > 0").select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(per))).alias("draw"))
    # a number of its own: rows of a few bytes would be joined to one task
    return rows.repartition(4 * sizes.sparkSession.sparkContext.defaultParallelism, *by, "draw").mapInPandas(run, f"{names}{', ' * bool(by)}draw int, block int, w binary")


def summed(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Parts of draws (by, draw of the first, sums: draws x names in a row) added up."""
    rows = df.select(*by, "draw", F.posexplode("sums").alias("at", "v"))
    rows = rows.select(*by, (F.col("draw") + F.floor(F.col("at") / len(names))).cast("int").alias("draw"), (F.col("at") % len(names)).alias("k"), "v")
    of = [F.sum(F.when(F.col("k") == i, F.col("v"))).alias(name) for i, name in enumerate(names)]
    return rows.groupBy(*by, "draw").agg(*of)


def bootstrap_sums(df: DataFrame, columns: dict[str, Column], draws: int, by: list[str], order: list[str]) -> DataFrame:
    """by, draw, n and the sums of ``columns`` over n rows drawn with replacement from each group."""
    rows = numbered(df.select(*by, *order, F.array(*[c.cast("double") for c in columns.values()]).alias("_v")), by, order)
    rows = written(rows.select(*by, "i", "n", "_v"), "numbered-rows")
    sizes = written(rows.groupBy(*by).agg(F.max("n").alias("n")), "sizes")
    blocks = rows.groupBy(*by, F.floor(F.col("i") / BLOCK).cast("int").alias("block")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "_v"))), lambda x: x["_v"])).alias("v"))
    k = len(columns)
    w = weights(sizes, by, draws)
    pairs = join_on(w, written(blocks, "row-blocks"), [*by, "block"])
    schema = pairs.select(*by, "draw").schema
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for w, v in zip(part.column("w").to_pylist(), part.column("v")):
                matrix = v.values.to_numpy(zero_copy_only=False).reshape(-1, k)
                out.append((np.frombuffer(w, np.uint16).reshape(-1, len(matrix)).astype(np.float64) @ matrix).ravel())
            columns = [part.column(c) for c in (*by, "draw")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], [*by, "draw", "sums"])

    sums = summed(pairs.mapInArrow(run, f"{names}, sums array<double>"), by, list(columns))
    return join_on(sums, sizes, by) if by else sums.join(F.broadcast(sizes), F.lit(True))


def bootstrap_correlations(df: DataFrame, x: str, y: str, draws: int, by: list[str], order: list[str], least: int = 10) -> DataFrame:
    """by, draw, r of rows drawn with replacement, for groups of ``least`` rows; from five sums a draw."""
    rows = df.dropna(subset=[x, y])
    means = rows.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    rows = join_on(rows, means, by) if by else rows.join(F.broadcast(means), F.lit(True))
    a, b = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    s = bootstrap_sums(rows, {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}, draws, by, order).where(F.col("n") >= least)
    spread = lambda c: F.col(c * 2) - F.col(c) * F.col(c) / F.col("n")
    size = F.sqrt(F.greatest(spread("a") * spread("b"), F.lit(0.0)))
    return s.select(*by, "draw", F.when(size > 1e-12, (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.nullif(size, F.lit(0.0))).alias("r"))


# areas over drawn clusters


def part_sums(cluster: np.ndarray, place: np.ndarray, pos: np.ndarray, neg: np.ndarray, w: np.ndarray) -> np.ndarray:
    """draws x 3 of cells in the order of their score: twice the pairs won (ties half), positives and negatives, weighted.

    ``w`` (clusters x draws) says how often each cluster is taken; ``place`` is equal for equal scores.
    """
    out = np.zeros((w.shape[1], 3))
    step, lo = max(1, CELLS // 4 // w.shape[1]), 0
    while lo < len(place):
        hi = min(len(place), lo + step)
        if hi < len(place):  # a score stays whole where it is not longer than a stretch
            cut = int(np.searchsorted(place, place[hi]))
            hi = cut if cut > lo else hi
        starts = np.flatnonzero(np.diff(place[lo:hi], prepend=place[lo] - 1))
        taken = w[cluster[lo:hi]]
        p, n = (np.add.reduceat(taken * c[lo:hi, None], starts, axis=0) for c in (pos, neg))
        first = lo > 0 and place[lo] == place[lo - 1]
        upto = n.cumsum(0) + out[:, 2]
        out[:, 0] += (p * (2 * upto - n)).sum(0)
        if first:  # the score began in an earlier stretch: its earlier cells tie with these
            out[:, 0] += p_last * n[0] - p[0] * n_last
        p_last, n_last = p[-1] + (p_last if first and len(starts) == 1 else 0), n[-1] + (n_last if first and len(starts) == 1 else 0)
        out[:, 1] += p.sum(0)
        out[:, 2] = upto[-1]
        lo = hi
    return out


def cluster_areas(df: DataFrame, cluster: list[str], y: str, scores: dict[str, str], draws: int) -> DataFrame:
    """draw, kind, auroc: the area of each score over clusters drawn with replacement, all rows of a cluster together.

    Counts of distinct scores of a cluster are ordered once, by ranges, and a range is
    packed in one row; a task takes a range and a batch of draws, makes the weights of a
    few draws at a time and adds up the pairs that are won inside its range.  Pairs of
    different ranges come from the ranges' totals of each draw.  The work is that of the
    cells times the draws; the number of ranges does not grow with the clusters.
    """
    clusters = written(numbered(df.select(*cluster).distinct(), [], cluster).select(*cluster, F.col("i").cast("int").alias("i")), "clusters")
    n_clusters = clusters.count()
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("score")) for k, c in scores.items()]))
    rows = join_on(df.select(*cluster, y, both.alias("s")).select(*cluster, y, "s.*").where(F.col(y).isNotNull() & F.col("score").isNotNull()), clusters, cluster)
    counts = written(cells(rows, "score", ["kind", "i"], {"p": F.col(y).cast("long"), "n": 1 - F.col(y).cast("long")}), "cluster-cells")
    size = max(ROWS, CLUSTER_ROWS * n_clusters)  # weights cost their clusters once a range
    order = [F.col("kind"), F.col("score")]
    ranges = -(-counts.count() // size)
    ordered = counts.repartitionByRange(max(1, ranges), *order).sortWithinPartitions(*order, "i").withColumn("part", F.spark_partition_id())

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a kind and range: its cells as arrays of numbers."""
        held: dict[tuple, list] = {}
        for part in parts:
            kinds, numbers = part.column("kind").to_pylist(), part.column("part").to_pylist()
            cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ("i", "score", "p", "n")]
            cuts = [0, *[k for k in range(1, len(kinds)) if kinds[k] != kinds[k - 1]], len(kinds)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    held.setdefault((kinds[lo], numbers[lo]), []).append([c[lo:hi] for c in cols])
        for (kind, number), pieces in held.items():
            i, score, p, n = (np.concatenate(c) for c in zip(*pieces))
            place = np.concatenate([[0], np.cumsum(score[1:] != score[:-1])])
            blobs = [i.astype(np.int32), place.astype(np.int32), p.astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([number], pa.int32()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], ["kind", "part", "i", "place", "p", "n"])

    ranges_of = written(ordered.mapInArrow(packed, "kind string, part int, i binary, place binary, p binary, n binary"), "packed-ranges")
    parallel = 4 * df.sparkSession.sparkContext.defaultParallelism
    few = max(1, min(32, CELLS // max(1, n_clusters)))  # draws whose weights are in memory together
    per = max(few, -(-draws // -(-parallel // max(1, ranges_of.count()))))
    tasks = ranges_of.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(per)))).repartition(parallel, "part", "kind", "draw")

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                at = lambda c, k=k: part.column(c)[k]
                i, place, p, n = (np.frombuffer(at(c).as_buffer(), np.int32) for c in ("i", "place", "p", "n"))
                p, n, first, out = p.astype(np.float64), n.astype(np.float64), at("draw").as_py(), []
                for lo in range(first, min(draws, first + per), few):
                    w = slot_counts(n_clusters, np.arange(lo, min(draws, first + per, lo + few)))
                    out.append(part_sums(i, place, p, n, np.ascontiguousarray(w.T.astype(np.float64))).ravel())
                yield pa.RecordBatch.from_arrays([pa.array([at("kind").as_py()]), pa.array([at("part").as_py()], pa.int32()), pa.array([first], pa.int32()), pa.array([np.concatenate(out)], pa.list_(pa.float64()))], ["kind", "part", "draw", "sums"])

    s = written(summed(tasks.mapInArrow(sums, "kind string, part int, draw int, sums array<double>"), ["kind", "part"], ["wins", "p", "n"]), "range-sums")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("kind", "draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("wins", F.col("wins") / 2 + F.col("p") * below).groupBy("draw", "kind").agg(*[F.sum(c).alias(c) for c in ("wins", "p", "n")])
    return s.select("draw", "kind", (F.col("wins") / F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("auroc"))


# permutation within strata


def cross_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """draws x (columns of x times columns of y): sums of products; a row whose y is not here has NaN."""
    if np.isnan(y.sum()):
        y = np.where(np.isnan(y), 0.0, y)
    return np.matmul(x.T, y).reshape(len(y), -1)


def masked_cosines(least: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """draws x 2: sum and number of the rows' cosines over places known in both."""

    def statistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = ~np.isnan(x)[None] & ~np.isnan(y)
        a, b = np.where(both, x[None], 0.0), np.where(both, y, 0.0)
        size = np.sqrt((a * a).sum(2) * (b * b).sum(2))
        use = (both.sum(2) >= least) & (size > 1e-12)
        cosine = np.divide((a * b).sum(2), size, out=np.zeros_like(size), where=use)
        return np.stack([cosine.sum(1), use.sum(1)], 1)

    return statistic


#: Rows that a task deals at a time.
STRETCH = 1 << 16


def permutation_sums(df: DataFrame, stratum: str, order: list[str], x: Column, y: Column, draws: int, statistic: Callable, names: list[str], rows_a_block: int = ROWS, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, draw and the sums ``names`` of ``statistic`` over all rows of a group, where each row's ``y`` is that of its partner in the stratum.

    ``x`` and ``y`` are arrays of numbers (null: not known).  Rows are packed in blocks
    of a million of their stratum; a pair of blocks is a group.  Where there are fewer
    groups than cores, each is dealt to several batches of draws.
    """
    by = list(by)
    rows = numbered(df.select(*by, F.col(stratum).alias("_s"), *order, x.alias("_x"), y.alias("_y")), [*by, "_s"], order)
    rows = written(rows.select(*by, "_s", "i", "n", F.floor(F.col("i") / rows_a_block).cast("int").alias("block"), "_x", "_y"), "permuted-rows")
    keys = [*by, "_s", "block"]
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*keys, "n").schema.fields) + "i long, x binary, y binary"

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a block, with its first place and its rows' numbers."""
        now, first, held = None, None, []

        def one() -> pa.RecordBatch:
            blobs = [pa.array([b"".join(v[k] for v in held)], pa.binary()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*first, *blobs], [*keys, "n", "i", "x", "y"])

        for part in parts:
            names_of = list(zip(*[part.column(c).to_pylist() for c in keys]))
            cuts = [0, *[k for k in range(1, len(names_of)) if names_of[k] != names_of[k - 1]], len(names_of)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if now != names_of[lo]:
                    if held:
                        yield one()
                    now, first, held = names_of[lo], [part.column(c).slice(lo, 1) for c in (*keys, "n", "i")], []
                held.append([part.column(c).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes() for c in ("_x", "_y")])
        if held:
            yield one()

    blocks = written(rows.repartition(*keys).sortWithinPartitions(*keys, "i").mapInArrow(packed, schema), "packed-rows")
    seeds = F.pmod(draw_hash(F.coalesce(F.col("_s").cast("string"), F.lit(""))), F.lit(PRIME))
    size = blocks.select(F.sum(F.ceil(F.col("n") / rows_a_block))).first()[0] or 1
    parallel = 4 * df.sparkSession.sparkContext.defaultParallelism
    per = -(-draws // max(1, min(draws, -(-parallel // int(size)))))
    batch = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(per))).alias("draw")
    every = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / rows_a_block).cast("int")))
    blocks = blocks.withColumn("seed", seeds)
    left = blocks.select(*by, "_s", F.col("block").alias("a"), every.alias("b"), F.lit(0).alias("side"), "i", "n", "seed", F.col("x").alias("v"))
    right = blocks.select(*by, "_s", every.alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"), "i", "n", "seed", F.col("y").alias("v"))
    both = left.unionByName(right).select("*", batch)
    names_by = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*by).schema.fields)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("side")
        n, seed, begin = int(group["n"].iloc[0]), int(group["seed"].iloc[0]), int(key[-1])
        start, low = map(int, group["i"])
        length = lambda at: min(rows_a_block, n - at)
        x, y = (np.frombuffer(v).reshape(length(at), -1) for v, at in zip(group["v"], (start, low)))
        whole = len(y) == n  # no partner is elsewhere
        y = np.vstack([y, np.full(y.shape[1], np.nan)])
        out, stretch = [], min(STRETCH, len(x))
        step = max(1, CELLS // 4 // (stretch * max(x.shape[1], y.shape[1])))
        for lo in range(begin, min(draws, begin + per), step):
            mine, total = np.arange(lo, min(draws, begin + per, lo + step)), 0
            tables = round_tables(n, mine, seed)
            for at in range(0, len(x), stretch):
                part = x[at : at + stretch]
                j = partners(np.arange(start + at, start + at + len(part)), n, mine, seed, tables) - low
                total = total + statistic(part, y.take(j if whole else np.where((j >= 0) & (j < len(y) - 1), j, len(y) - 1), axis=0))
            out.append(total.ravel())
        return pd.DataFrame({**{b: [key[i]] for i, b in enumerate(by)}, "draw": [begin], "sums": [np.concatenate(out)]})

    return summed(both.groupBy(*by, "_s", "a", "b", "draw").applyInPandas(run, f"{names_by}draw int, sums array<double>"), by, names)
