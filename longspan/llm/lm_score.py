"""LM scoring with a gated recurrent network over words.

Word counts come from all training texts: each task counts the words of its
share, one shuffle adds the counts up.  The most frequent words are the output
vocabulary of a GRU, whose softmax is factored into classes; any other word is
"unknown" to the network times its smoothed share of all such words, so the
probability covers every text.  Truncated backpropagation in numpy first fits the
network on a bounded sample of whole texts and then, in parallel, on every word
and end of every training text; the tasks' weights are averaged by their tokens.

Scoring runs texts side by side in lanes, window by window.  The state goes from
one window to the next and starts anew with each text, so the result is the
log-likelihood of the complete text.  Counts of frequent words travel to the
tasks (a bounded table); the rest are joined by one shuffle.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, in_batches, lower_table, materialize, row_blocks, SpanHash, text_bytes, unit_hash, word_spans

HIDDEN, CLASSES, PER_CLASS = 20, 32, 32
WINDOW, LANES = 64, 256
#: Words whose counts are sent to all tasks, and slots of the table that holds them there.
COMMON, SLOT_BITS = 130_000, 20
#: Bound of the first, single-machine fit: texts.
WARM_DOCS = 800
#: The second fit takes every training text whole, with so many texts side by side and steps an update; its rate is for a
#: full window, less for one with fewer tokens (long texts end alone), and halves after so many updates.
FIT_LANES, FIT_WINDOW, FIT_RATE, FIT_HALF = 256, 32, 0.03, 150
#: Bytes of text that are cut into words at once, and tokens of whole texts that run side by side (a longer text is alone).
BLOCK_BYTES, GROUP_TOKENS = 1 << 20, 1 << 21
#: Groups over which the tasks' weights are summed before the driver adds them up.
SUM_GROUPS = 32
END_HASH = 1  # no word has this hash but by a chance of 2**-64


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END_HASH after each text, and each text's first token (one more at the end)."""
    data = lower_table()[data]
    starts, ends, first = word_spans(data, offsets)
    h = SpanHash(data)(starts, ends, 8)
    first = first + np.arange(len(first))
    out = np.full(int(first[-1]), END_HASH, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[first[1:] - 1] = False
    out[is_word] = h
    return out, first


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash as long), n over all texts, with the end of each text counted as a word."""

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([n for _, n in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts, first)

    def out(parts):
        keys, counts = merged(parts)
        for at in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000].view(np.int64)), pa.array(counts[at : at + 200_000])], ["word", "n"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_blocks(offsets, 1 << 22):
                words, _ = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                parts.append(np.unique(words, return_counts=True))
                size += len(parts[-1][0])
                if size > 4_000_000:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > 3_000_000:  # a task's table stays bounded
                        yield from out(parts)
                        parts, size = [], 0
        if parts:
            yield from out(parts)

    return in_batches(docs.select("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Totals, and the common words by falling count; the first of them are the network's vocabulary."""

    all_n: int
    all_v: int
    words: np.ndarray
    n: np.ndarray

    def build(self) -> None:
        """Slots of a table without chains: of words that meet, the most frequent stays."""
        slot = (self.words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        _, winner = np.unique(slot, return_index=True)  # the first, thus the most frequent
        winner = np.sort(winner)
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.logs = np.zeros(1 << SLOT_BITS)
        self.ids = np.zeros(1 << SLOT_BITS, np.int16)
        slot = slot[winner]
        self.keys[slot] = self.words[winner]
        self.logs[slot] = np.log10(self.n[winner] + 1.0)
        # 0 is unknown, 1 the end of a text; then the placed words by count
        is_end = self.words[winner] == END_HASH
        rank = np.cumsum(~is_end) + 1
        self.ids[slot] = np.where(is_end, 1, np.where(rank < CLASSES * PER_CLASS, rank, 0))
        inside = is_end | (rank < CLASSES * PER_CLASS)
        self.rest = self.all_n - int(self.n[winner][inside].sum()) + self.all_v - int(inside.sum()) + 1

    def look_up(self, words: np.ndarray):
        """Network id, whether the table has the word, log10(count + 1) if so."""
        slot = (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = self.keys[slot] == words
        end = words == END_HASH
        ids = np.where(hit, self.ids[slot], 0)
        ids[end] = 1
        return ids, hit, self.logs[slot] * hit


class Gru:
    """x: input weights of each word, u: recurrent weights (update, reset, new), wc, bc: classes, ww, bw: words in classes.

    The unknown word has a class of its own, the last one, where it is sure.  The
    gates are 0.5 + 0.5 * tanh, a logistic function of twice the argument.
    """

    def __init__(self, weights: list[np.ndarray] | None = None, seed: int = 5):
        rng, h = np.random.default_rng(seed), HIDDEN
        make = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
        zeros = lambda *s: np.zeros(s, np.float32)
        self.p = weights or [make(CLASSES * PER_CLASS, 3 * h), make(h, 3 * h), make(h, CLASSES + 1), zeros(CLASSES + 1), make(CLASSES, h, PER_CLASS), zeros(CLASSES, PER_CLASS)]
        self.m, self.v, self.steps = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in self.p])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Gru":
        out, at = cls(), 0
        for i, a in enumerate(out.p):
            out.p[i] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size
        return out

    def run(self, inputs: np.ndarray, state: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States after each of a window's steps (steps, lanes, hidden); an input of 1 starts a text anew."""
        h, u = HIDDEN, self.p[1]
        drive = self.p[0][inputs]
        states = np.empty((*inputs.shape, h), np.float32)
        fresh = inputs == 1
        if keep is not None:
            keep |= {"old": np.empty_like(states), "gates": np.empty((*inputs.shape, 2 * h), np.float32), "new": np.empty_like(states), "part": np.empty_like(states)}
        for t in range(len(inputs)):
            if fresh[t].any():
                state = np.where(fresh[t][:, None], np.float32(0), state)
            g = state @ u
            gates = drive[t, :, : 2 * h]
            gates += g[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = drive[t, :, 2 * h :]
            new += gates[:, h:] * g[:, 2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep["old"][t], keep["gates"][t], keep["new"][t], keep["part"][t] = state, gates, new, g[:, 2 * h :]
            out = states[t]
            np.subtract(state, new, out=out)
            out *= gates[:, :h]
            out += new
            state = out
        return states

    def outputs(self, hidden: np.ndarray, targets: np.ndarray, grads: list | None = None):
        """Natural log-probabilities of targets; with ``grads``, also the gradient of the mean loss by the states."""
        _, _, wc, bc, ww, bw = self.p
        n = len(targets)
        kind, word = np.where(targets == 0, CLASSES, targets // PER_CLASS).astype(np.int16), targets % PER_CLASS
        back = None

        def layer(x, weights, bias, target):
            s = x @ weights
            s += bias
            if np.abs(weights).sum(axis=0).max() + np.abs(bias).max() > 60:  # states are within one; else no exponential overflows
                s -= s.max(axis=1, keepdims=True)
            at = np.arange(len(s))
            got = s[at, target]
            np.exp(s, out=s)
            total = s.sum(axis=1)
            if grads is not None:
                s *= (1 / (total * n))[:, None]
                s[at, target] -= np.float32(1 / n)
            return got - np.log(total), s

        logs, e = layer(hidden, wc, bc, kind)
        if grads is not None:
            back = e @ wc.T
            grads[2] += hidden.T @ e
            grads[3] += e.sum(axis=0)
        order = np.argsort(kind, kind="stable")
        marks = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = order[marks[c] : marks[c + 1]]
            if not len(rows):
                continue
            hc, known = hidden[rows], int(c == 0)  # the first place of the first class is that of the unknown word
            got, e = layer(hc, ww[c][:, known:], bw[c][known:], word[rows] - known)
            logs[rows] += got
            if grads is not None:
                back[rows] += e @ ww[c][:, known:].T
                grads[4][c][:, known:] += hc.T @ e
                grads[5][c][known:] += e.sum(axis=0)
        return logs, back

    def learn(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, state: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """One step of Adam on a window, gradients stopping at its start; the state after it and the mean loss."""
        h, u = HIDDEN, self.p[1]
        keep: dict = {}
        states = self.run(inputs, state, keep)
        grads = [np.zeros_like(a) for a in self.p]
        where = np.flatnonzero(live.reshape(-1))
        logs, back = self.outputs(states.reshape(-1, h)[where], targets.reshape(-1)[where], grads)
        d_states = np.zeros_like(states).reshape(-1, h)
        d_states[where] = back
        d_states = d_states.reshape(states.shape)
        old, z, r, new, part = keep["old"], keep["gates"][..., :h], keep["gates"][..., h:], keep["new"], keep["part"]
        # the factors of the gradient by the state that do not depend on later steps
        to_new = (1 - z) * (1 - new * new)
        to_gates = np.concatenate([(old - new) * z * (1 - z) * 2, to_new * part * r * (1 - r) * 2], axis=2)
        d_drive, d_part = np.empty((*inputs.shape, 3 * h), np.float32), np.empty((*inputs.shape, 3 * h), np.float32)
        fresh, ut, d = inputs == 1, np.ascontiguousarray(u.T), np.zeros_like(state)
        for t in range(len(inputs) - 1, -1, -1):
            d = d + d_states[t]
            out = d_drive[t]
            np.multiply(d, to_gates[t, :, :h], out=out[:, :h])
            np.multiply(d, to_gates[t, :, h:], out=out[:, h : 2 * h])
            np.multiply(d, to_new[t], out=out[:, 2 * h :])
            dg = d_part[t]
            dg[:, : 2 * h] = out[:, : 2 * h]
            np.multiply(out[:, 2 * h :], r[t], out=dg[:, 2 * h :])
            d = d * z[t] + dg @ ut
            if fresh[t].any():
                d[fresh[t]] = 0
        grads[1] = old.reshape(-1, h).T @ d_part.reshape(-1, 3 * h)
        flat = inputs.reshape(-1)
        order = np.argsort(flat.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
        grads[0][flat[order][first]] = np.add.reduceat(d_drive.reshape(-1, 3 * h)[order], first, axis=0)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        self.steps += 1
        for a, g, m, v in zip(self.p, grads, self.m, self.v):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)
        return states[-1], -float(logs.mean())


def lanes(first: np.ndarray, most: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Token positions (steps, lanes), -1 past a lane's end; texts go whole to the shortest lane, the long ones first."""
    sizes = np.diff(first)
    n = min(most, len(sizes))
    heap, members = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        long, lane = heapq.heappop(heap)
        members[lane].append(i)
        heapq.heappush(heap, (long + int(sizes[i]), lane))
    long = np.array([sum(int(sizes[i]) for i in m) for m in members])
    out = np.full((int(long.max()), n), -1, np.int64)
    order = np.argsort(-long, kind="stable")
    for column, lane in enumerate(order.tolist()):
        out[: long[lane], column] = np.concatenate([np.arange(first[i], first[i + 1]) for i in members[lane]])
    return out, long[order]


def windows(ids: np.ndarray, first: np.ndarray, most: int = LANES, width: int = WINDOW):
    """(positions, inputs, live) of each window; lanes that have ended are left out."""
    place, long = lanes(first, most)
    flat = np.append(ids, 1)
    for at in range(0, len(place), width):
        active = int((long > at).sum())
        p = place[at : at + width, :active]
        before = np.full_like(p, -1)
        before[1:] = p[:-1]
        if at:
            before[0] = place[at - 1, :active]
        inputs = flat[before]
        inputs[before < 0] = 1
        yield p, inputs, p >= 0


def score_block(net: Gru, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of every token, the state carried through each whole text."""
    out, state = np.zeros(len(ids)), None
    for p, inputs, live in windows(ids, first):
        state = np.zeros((p.shape[1], HIDDEN), np.float32) if state is None else state[: p.shape[1]]
        states = net.run(inputs, state)
        state = states[-1]
        at = p[live]
        out[at] = net.outputs(states[live], ids[at])[0]
    return out / np.log(10)


def fit_block(net: Gru, ids: np.ndarray, first: np.ndarray, rate: float, most: int = 16, width: int = 32, half: float | None = None) -> list[float]:
    """Losses of the updates; with ``half`` the rate follows the tokens of a window and falls with the updates so far."""
    losses, state = [], None
    for p, inputs, live in windows(ids, first, most, width):
        state = np.zeros((p.shape[1], HIDDEN), np.float32) if state is None else state[: p.shape[1]]
        own = rate * min(1.0, live.sum() / (most * width)) / (1 + net.steps / half) if half else rate
        state, loss = net.learn(inputs, ids[np.maximum(p, 0)], live, state, own)
        losses.append(loss)
    return losses


def warm_fit(docs: DataFrame, counts: Counts, n_train: int, epochs: int = 2) -> Gru:
    """The first fit, on about WARM_DOCS whole texts."""
    share = min(1.0, WARM_DOCS / max(1, n_train))
    got = docs.where(unit_hash(F.lit("lm"), F.col("doc_id")) < share).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").limit(2 * WARM_DOCS).toArrow()
    net = Gru()
    data, offsets = text_bytes(got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string()))
    if got.num_rows:
        words, first = tokens(data, offsets)
        ids = counts.look_up(words)[0]
        for epoch in range(epochs):
            fit_block(net, ids, first, 0.01 / (1 + epoch))
    return net


def in_groups(parts):
    """Lists of (rows, ids, first token of each row) until they have GROUP_TOKENS tokens: texts of many rows fill all lanes."""
    group, size = [], 0
    for part in parts:
        group.append(part)
        size += len(part[1])
        if size >= GROUP_TOKENS:
            yield group
            group, size = [], 0
    if group:
        yield group


def joined(group) -> tuple[np.ndarray, np.ndarray]:
    first = np.cumsum(np.concatenate([[0], *[np.diff(f) for _, _, f in group]]))
    return np.concatenate([ids for _, ids, _ in group]), first


def spread_fit(docs: DataFrame, counts: Counts, net: Gru) -> Gru:
    """The second fit: every task goes on from the first one over all windows of its training texts, ends included."""
    weights, kept = net.flat(), (counts.all_n, counts.all_v, counts.words[:4096], counts.n[:4096])

    def run(batches):
        own, table, seen = Gru.of(weights), Counts(*kept), 0
        table.build()

        def parts():
            for batch in batches:
                data, offsets = text_bytes(batch.column("text"))
                for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                    words, first = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    yield None, table.look_up(words)[0].astype(np.int16), first

        for group in in_groups(parts()):
            ids, first = joined(group)
            fit_block(own, ids, first, FIT_RATE, FIT_LANES, FIT_WINDOW, FIT_HALF)
            seen += len(ids)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUM_GROUPS], pa.int32()), pa.array([seen]), pa.array([(own.flat().astype(np.float64) * seen).tobytes()])], ["part", "seen", "weights"])

    def add(batches):
        total, seen = 0.0, 0
        for batch in batches:
            for s, w in zip(batch.column("seen").to_pylist(), batch.column("weights")):
                seen += s
                total = total + np.frombuffer(w.as_py(), np.float64)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total.tobytes()])], ["seen", "weights"])

    each = in_batches(docs.select(F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(run, "part int, seen long, weights binary")
    sums = each.repartition(SUM_GROUPS, "part").select("seen", "weights").mapInArrow(add, "seen long, weights binary").collect()
    if not sums:
        return net
    return Gru.of(sum(np.frombuffer(r["weights"], np.float64) for r in sums) / sum(r["seen"] for r in sums))


def lm_score(docs: DataFrame, learn=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Rows whose ``learn`` condition holds (by default, crc32 of the doc_id modulo
    7 is not 2) are learned from.  A null text counts as empty: it has one token,
    its end.  Repeated rows are scored alike and count as often as they occur.
    With nothing to learn from, the base is log10(1) a token and the network is an
    untrained one.  The network's weights are an average over the tasks that read
    the training texts, so ``score`` depends a little on how the table's files are
    split; all other columns do not.  A text of any length is read whole, its words
    one window after the other.  An empty table gives an empty result; further columns are
    ignored.
    """
    held_out = crc_mod("doc_id", 7) == 2
    rows = docs.select("doc_id", held_out.alias("held_out"), (~held_out if learn is None else learn).alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    train = rows.where("learn")
    table = materialize(count_words(train), "word-counts")
    sums = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == END_HASH, F.col("n"))).alias("ends")).first()
    top = table.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    counts = Counts(int(sums["n"] or 0), sums["v"], top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy())
    counts.build()
    net = Gru()
    if counts.all_n:
        net = spread_fit(train, counts, warm_fit(train, counts, int(sums["ends"] or 0)))
    weights, kept = net.flat(), (counts.all_n, counts.all_v, counts.words, counts.n)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        net, c = Gru.of(weights), Counts(*kept)
        c.build()
        base_log, rest_log = np.log10(c.all_n + c.all_v + 1.0), np.log10(float(c.rest))
        uid = TaskContext.get().partitionId() << 33
        kinds = pa.list_(pa.int64())

        def parts():
            for batch in batches:
                data, offsets = text_bytes(batch.column("text"))
                for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                    words, first = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    ids, hit, logs = c.look_up(words)
                    n = np.diff(first)
                    add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023, E731  every text has a token
                    extra = add(np.where(ids == 0, logs - rest_log, 0.0))
                    edges = np.concatenate([[0], np.cumsum(add((~hit).astype(np.int64)))]).astype(np.int32)
                    rare = pa.ListArray.from_arrays(pa.array(edges), pa.array(words[~hit].view(np.int64)), kinds)
                    of_rows = [*[batch.column(x).slice(lo, hi - lo) for x in ("doc_id", "held_out")], pa.array(n.astype(np.int64)), pa.array(add(hit.astype(np.int64))), pa.array(add(logs) - n * base_log), extra, rare]
                    yield of_rows, ids.astype(np.int16), first

        for group in in_groups(parts()):
            ids, first = joined(group)
            score, at = np.add.reduceat(score_block(net, ids, first), first[:-1]), 0
            for of_rows, _, own in group:
                size = len(own) - 1
                *columns, extra, rare = of_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + size)), *columns, pa.array(score[at : at + size] + extra), rare],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                uid, at = uid + size, at + size

    scored = materialize(in_batches(rows.select("doc_id", "held_out", "text")).mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"), "lm-scores")
    rare = scored.select("uid", F.explode("rare").alias("word"))
    more = rare.join(table, "word").groupBy("uid").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more"))
    out = scored.drop("rare").join(more, "uid", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.all_n).cast("long").alias("train_tokens"), (F.col("base_score") + extra).alias("base_score"), (F.col("score") + extra).alias("score"),
    )
