"""Language identification with a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window, the
largest value of each filter feeds a softmax.  The network is trained in numpy
on windows of a bounded sample of labelled texts.  Prediction cuts every whole
text into windows of the same length and averages the windows' probabilities by
their bytes.  A filter over one-hot bytes is a sum of table rows, so pairs of
adjacent bytes are folded into one table and a filter of width four costs two
look-ups a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, in_batches, row_blocks, text_bytes, unit_hash

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bound of the training sample: documents in all, and windows from each.
TRAIN_DOCS, TRAIN_WINDOWS = 3200, 4
UNDETERMINED = "und"


class ByteConvNet:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.weights = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self._pairs = None

    def fold(self) -> None:
        """Tables over byte pairs, for prediction."""
        self._pairs = []
        for t in self.tables:
            w = len(t)
            pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            self._pairs.append((pairs, t[w - 1] if w % 2 else None))

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each window (rows of WINDOW bytes), cut at zero."""
        n = len(windows)
        pair = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            pairs, last = self._pairs[i]
            m = WINDOW - w + 1
            y = pairs[0].take(pair[:, :m], axis=0)
            for k, t in enumerate(pairs[1:], 1):
                y += t.take(pair[:, 2 * k : 2 * k + m], axis=0)
            if last is not None:
                y += last.take(windows[:, w - 1 : w - 1 + m], axis=0)
            out[:, i * FILTERS : (i + 1) * FILTERS] = y.max(axis=1)
        return np.maximum(out, 0)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross entropy; the gradient of a maximum goes to the bytes that made it."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.weights, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x, n = windows[rows], len(rows)
                tops, hidden = [], np.empty((n, len(WIDTHS) * FILTERS), np.float32)
                for i, w in enumerate(WIDTHS):
                    size = WINDOW - w + 1
                    y = self.tables[i][0].take(x[:, :size], axis=0)
                    for k in range(1, w):
                        y += self.tables[i][k].take(x[:, k : k + size], axis=0)
                    top = y.argmax(axis=1)
                    tops.append(top)
                    hidden[:, i * FILTERS : (i + 1) * FILTERS] = np.take_along_axis(y, top[:, None, :], axis=1)[:, 0]
                live = hidden > 0
                hidden *= live
                z = hidden @ self.weights + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), labels[rows]] -= 1
                p /= n
                back = (p @ self.weights.T) * live
                grads = []
                for i, w in enumerate(WIDTHS):
                    g, d = np.zeros_like(self.tables[i]), back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(x, tops[i] + k, axis=1), np.arange(FILTERS)[None, :]), d)
                    grads.append(g)
                grads += [hidden.T @ p + 1e-4 * self.weights, p.sum(axis=0)]
                step += 1
                lr = rate * (1 - epoch / epochs)
                for q, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-filled windows over each row's bytes, each window's row and its number of bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    used = np.minimum(sizes[row] - nth * WINDOW, WINDOW)
    out = np.zeros((len(row), WINDOW), np.uint8)
    start = np.cumsum(counts) - counts
    place = np.repeat(start * WINDOW - offsets[:-1], sizes) + np.arange(len(data))
    out.reshape(-1)[place] = data
    return out, row, used


def training_sample(docs: DataFrame, learn, max_docs: int = TRAIN_DOCS) -> list[tuple[str, list[str]]]:
    """(lang, passages) of about ``max_docs`` labelled documents, equally many of each language."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_docs).collect()}
    if not counts:
        return []
    each = max(1, max_docs // len(counts))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    draw = unit_hash(F.lit("langid"), F.col("doc_id"), F.crc32("text"))  # texts of one doc_id are drawn one by one
    rows = rows.where(draw < share[F.col("lang")])
    cut = lambda j: F.substring(F.col("text"), (F.floor(unit_hash(F.lit(f"cut{j}"), F.col("doc_id")) * F.greatest(F.lit(1), F.length("text") - WINDOW)) + 1).cast("int"), F.lit(WINDOW))
    # spans are drawn from all over a text; prediction uses every byte
    some = rows.orderBy(draw, "doc_id", "lang").limit(3 * max_docs)  # only copies of a text could be more
    got = some.select("doc_id", "lang", F.array(*[cut(j) for j in range(TRAIN_WINDOWS)]).alias("spans")).collect()
    return [(r["lang"], r["spans"]) for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"]))]


def fit(sample: list[tuple[str, list[str]]], seed: int = 7) -> ByteConvNet | None:
    """A network for the languages of the sample; None if there are none."""
    classes = sorted({lang for lang, _ in sample})
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for lang, spans in sample:
        for j, span in enumerate(spans):
            raw = np.frombuffer(span.encode()[:WINDOW], np.uint8)
            if j % 2 and len(raw) > 24:  # short texts occur too
                raw = raw[: rng.integers(12, len(raw))]
            if len(raw):
                rows.append(np.pad(raw, (0, WINDOW - len(raw))))
                labels.append(classes.index(lang))
    net = ByteConvNet(classes, seed)
    if len(classes) > 1:
        net.train(np.array(rows), np.array(labels))
    net.fold()
    return net


def score_rows(net: ByteConvNet | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language and its mean probability for each row."""
    n = len(offsets) - 1
    total = np.zeros((n, len(net.classes)))
    windows, row, used = windows_of(data, offsets)
    for at in range(0, len(windows), 512):
        part = slice(at, at + 512)
        np.add.at(total, row[part], net.predict(windows[part]) * used[part, None])
    total /= np.maximum(np.diff(offsets), 1)[:, None]
    best = total.argmax(axis=1)
    return best, np.clip(total[np.arange(n), best], 0, 1)


def identify(docs: DataFrame, learn=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row and its whole text.

    Rows whose ``learn`` condition holds (by default, crc32 of the doc_id modulo
    4 is not 2) and that have a lang and a letter are learned from; a sample of
    about ``TRAIN_DOCS`` of them is drawn by a hash of the doc_id.  A null text or
    one without a letter gets ``und`` and score 0, and so do all rows if nothing
    can be learned; an empty table gives an empty result.  Repeated rows get equal
    results.  Further columns are ignored.
    """
    held_out = crc_mod("doc_id", 4) == 2
    net = fit(training_sample(docs, ~held_out if learn is None else learn))
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.zeros(len(known), int), np.zeros(len(known))
            if net is not None:
                for lo, hi in row_blocks(offsets, 1 << 20):
                    best[lo:hi], score[lo:hi] = score_rows(net, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            known &= net is not None
            names = np.array([*(net.classes if net else []), UNDETERMINED], object)
            lang = names[np.where(known, best, -1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return in_batches(rows).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
