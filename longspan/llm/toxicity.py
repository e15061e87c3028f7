"""Toxicity by a chain of linear classifiers.

The categories have an order.  Each category's model sees the text features and
the probabilities of all earlier categories; in training those come from
out-of-fold predictions, so a later model meets earlier probabilities as
unsure as they will be on new texts.  Features are hashed presence flags of
words, of word beginnings and of runs of symbols over the whole text; a model
uses those that tell its category best in its own training rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, lower_table, row_blocks, SpanHash, text_bytes, unit_hash

BITS = 20
PREFIXES = (4, 5, 6)
#: Bound of the training sample: rows with, and rows without, the last category.
TRAIN_ROWS = 2000
#: Most features of one model, and rows of its category that a feature needs.
FEATURES, LEAST_SHARE = 600, 0.01
FOLDS = 4
#: Share of rejected texts that must be right, out of fold and weighted back to all labelled texts; a chain that cannot reach it rejects nothing.
LEAST_PRECISION = 0.9

#: Categories of the labels table in the order of the chain; the last decides.
CATEGORIES: tuple[tuple[str, Column | str], ...] = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of every run of letters or symbols, with repetitions."""
    kind = np.full(256, 2, np.uint8)
    kind[list(b" \t\n\x0b\x0c\r")] = 0
    kind[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
    data = lower_table()[data]
    k = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if len(k):
        edge[1:-1] |= k[1:] != k[:-1]
    marks = np.flatnonzero(edge)
    starts, ends = marks[:-1], marks[1:]
    keep = k[starts] > 0 if len(k) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    row = np.searchsorted(offsets, starts, side="right") - 1
    h = SpanHash(data)
    shift = np.uint64(64 - BITS)
    rows, out = [row], [h(starts, ends, 1) >> shift]
    for n in PREFIXES:
        long = ends - starts > n
        rows.append(row[long])
        out.append(h(starts[long], starts[long] + n, 2) >> shift)
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


def distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row << BITS | feature)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Linear:
    """One category's logistic model: chosen features, their weights, weights of earlier probabilities, bias."""

    chosen: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, n: int, row: np.ndarray, feature: np.ndarray, before: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.chosen] = self.weights
        z = np.bincount(row, table[feature], n) + before @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(n: int, row: np.ndarray, feature: np.ndarray, y: np.ndarray, before: np.ndarray, most: int = FEATURES, decay: float = 0.5, steps: int = 250) -> Linear:
    """Class-balanced logistic regression on the features with the highest smoothed log odds."""
    if y.all() or not y.any():
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), 30.0 if n and y.all() else -30.0)
    size = 1 << BITS
    inside, outside = np.bincount(feature[y[row]], minlength=size), np.bincount(feature[~y[row]], minlength=size)
    positive, negative = y.sum(), (~y).sum()
    odds = np.log((inside + 0.5) / (positive + 1)) - np.log((outside + 0.5) / (negative + 1))
    enough = np.flatnonzero(inside >= max(3, LEAST_SHARE * positive))
    score = odds[enough] * np.sqrt(inside[enough])
    chosen = np.sort(enough[(odds[enough] > 0.7)][np.argsort(-score[odds[enough] > 0.7], kind="stable")[:most]])
    slot = np.full(size, -1)
    slot[chosen] = np.arange(len(chosen))
    used = slot[feature] >= 0
    x = np.zeros((n, len(chosen) + before.shape[1] + 1), np.float32)
    x[row[used], slot[feature[used]]] = 1
    x[:, len(chosen) : -1] = before
    x[:, -1] = 1
    share = np.where(y, 0.5 / positive, 0.5 / negative).astype(np.float32)
    w, m, v = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    penal = np.full(x.shape[1], decay / n, np.float32)
    penal[len(chosen) :] = 0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ ((p - y) * share) + penal * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Linear(chosen, w[: len(chosen)].astype(float), w[len(chosen) : -1].astype(float), float(w[-1]))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5
    out_of_fold: np.ndarray | None = None

    def predict(self, n: int, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.column_stack([out, model.predict(n, row, feature, out)])
        return out


def fit_chain(names: list[str], row: np.ndarray, feature: np.ndarray, y: np.ndarray, group: np.ndarray, weight: np.ndarray | None = None) -> Chain:
    """``y``: rows x categories; ``group``: rows with equal values share a fold (copies of one text).

    ``weight``: how many labelled texts a row of the sample stands for; precision and F1
    of the threshold use it, so that the threshold means the same at every size.
    """
    n = len(y)
    chain, before, fold = Chain(names), np.zeros((n, 0)), group % FOLDS
    for k in range(len(names)):
        out = np.zeros(n)
        for f in range(FOLDS):
            learn, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(test):
                continue
            place = np.full(n, -1)
            place[learn] = np.arange(len(learn))
            mine = place[row] >= 0
            model = fit_linear(len(learn), place[row[mine]], feature[mine], y[learn, k], before[learn])
            out[test] = model.predict(n, row[~mine], feature[~mine], before)[test]
        chain.models.append(fit_linear(n, row, feature, y[:, k], before))
        before = np.column_stack([before, out])
    chain.out_of_fold = before
    last, p = y[:, -1], before[:, -1]
    w = np.ones(n) if weight is None else weight
    grid = np.round(np.arange(0.1, 0.91, 0.05), 2)
    hits = np.array([w[(p >= t) & last].sum() for t in grid])
    taken = np.array([w[p >= t].sum() for t in grid])
    f1 = 2 * hits / np.maximum(1, taken + w[last].sum())
    right = hits / np.maximum(1, taken)
    f1[right < LEAST_PRECISION] = 0
    best = grid[f1 >= f1.max() - 1e-12]
    chain.threshold = float(best[len(best) // 2]) if f1.max() > 0 else 2.0
    return chain


def learn(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, train_rows: int = TRAIN_ROWS) -> Chain | None:
    """A chain from a sample of about ``train_rows`` labelled texts with, and as many without, the last category."""
    names = [c for c, _ in categories]
    truth = [F.max(F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False))).alias(f"y{i}") for i, (_, c) in enumerate(categories)]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*truth)
    last = f"y{len(names) - 1}"
    counts = {r[last]: r["count"] for r in known.groupBy(last).count().collect()}
    with_share, without_share = (min(1.0, train_rows / max(1, counts.get(v, 0))) for v in (True, False))
    share = F.when(F.col(last), with_share).otherwise(without_share)
    chosen = known.where(unit_hash(F.lit("toxicity"), F.col("doc_id")) < share)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    # a doc_id may stand for many rows: of more than six times the sample, the first by a hash
    rows = rows.orderBy(unit_hash(F.lit("toxicity"), F.col("doc_id"), F.crc32("text")), "doc_id", "text").limit(6 * train_rows)
    ys = [f"y{i}" for i in range(len(names))]

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_blocks(offsets, 1 << 18):
                row, feature = distinct(*features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                first = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "copy_of", *ys)] + [lists], ["doc_id", "copy_of", *ys, "features"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", F.crc32("text").alias("copy_of"), "text", *ys).mapInArrow(run, f"doc_id {kind}, copy_of long, {', '.join(y + ' boolean' for y in ys)}, features array<int>").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("doc_id", "ascending"), ("copy_of", "ascending")]).combine_chunks()
    y = np.column_stack([got.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ys])
    lists = got.column("features").chunk(0) if got.column("features").num_chunks else got.column("features").combine_chunks()
    feature = lists.flatten().to_numpy()
    often = np.bincount(feature, minlength=1 << BITS) >= 3  # no model uses rarer ones
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))[often[feature]]
    feature = feature[often[feature]]
    copy_of = got.column("copy_of").to_numpy()
    _, single = np.unique(copy_of, return_index=True)  # copies of a text count once
    place = np.full(len(y), -1)
    place[np.sort(single)] = np.arange(len(single))
    mine = place[row] >= 0
    single = np.sort(single)
    weight = np.where(y[single, -1], 1 / with_share, 1 / without_share)
    return fit_chain(names, place[row[mine]], feature[mine], y[single], copy_of[single], weight)


def toxicity(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, p_<category> for each category, rejected: one row per input row.

    A text is rejected if the probability of the last category reaches the
    threshold that served out-of-fold predictions best; if none was right often
    enough, no text is.  Null and empty texts
    have no features and are never rejected, and nothing is if there are no
    labels for any text.  Labels of several rows for one doc_id count if any
    does; a null label counts as not.  Repeated rows get equal results; an empty
    table gives an empty result; further columns are ignored.
    """
    names = [c for c, _ in categories]
    chain = learn(docs, labels, categories, train_rows)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            n = len(offsets) - 1
            p = np.zeros((n, len(names)))
            if chain is not None:
                wanted = np.zeros(1 << BITS, bool)
                for model in chain.models:
                    wanted[model.chosen] = True
                for lo, hi in row_blocks(offsets, 1 << 18):
                    row, feature = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    used = wanted[feature]
                    p[lo:hi] = chain.predict(hi - lo, *distinct(row[used], feature[used]))
            rejected = (p[:, -1] >= chain.threshold) & (np.diff(offsets) > 0) if chain is not None else np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p[:, i]) for i in range(len(names))], pa.array(rejected)], ["doc_id", *[f"p_{c}" for c in names], "rejected"])

    return in_batches(rows).mapInArrow(run, f"doc_id {kind}, {', '.join(f'p_{c} double' for c in names)}, rejected boolean")
