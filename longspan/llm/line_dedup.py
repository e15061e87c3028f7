"""Line dedup by winnowed runs of words.

Lines are cut at line breaks and folded after punctuation or after a word chosen
by its hash, so a passage inside a line has lines of its own.  A word counts with
the space that follows it inside its line.
Of every WINDOW neighbouring runs of GRAM words the one with the smallest hash is
posted, so any two places that agree in MIN_WORDS words post a common run of
them, wherever the passage starts and however it is punctuated.  A repeated run
is aligned with its first occurrence (smallest doc_id, then position); occurrences
on one diagonal of two documents are one candidate region.  Both whole texts are
then compared, hashes first and bytes next, the match grows to its full extent
beyond the posted runs word by word, and if it has enough words, its lines are
removed from the later place.  The parts of lines at its ends go with them only
where they make up more than half of it or are long enough themselves.  All that
is removed stands at an earlier place too, so the first copy of everything stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, in_batches, materialize, row_blocks, SpanHash, text_bytes, with_texts, word_spans

#: Words of a matching run that is removed, of a posted run, and neighbouring runs of which one is posted.
#: A passage of MIN_WORDS words agrees in one less with the space behind them, and GRAM + WINDOW - 1 words share a post.
MIN_WORDS, GRAM, WINDOW = 40, 20, 20
#: Cleaned texts whose spans, four for each on average, may be broadcast (about 40 MB).
BROADCAST_CUTS = 250_000
FOLD_AFTER = b".,;:!?|"


class Lines:
    """Folded lines of a block of texts: byte span of each, and hash, line and text of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_spans(data, offsets)
        h = SpanHash(data)
        stop = np.zeros(256, bool)
        stop[list(FOLD_AFTER)] = True
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        last = np.zeros(len(starts), bool)
        if len(starts):
            last[:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
            last |= stop[data[ends - 1]] | (h(starts, ends, 5) & np.uint64(15) == 0)
            last[first[1:][np.diff(first) > 0] - 1] = True
        end_word = np.flatnonzero(last)
        self.begin_word = np.append(0, end_word[:-1] + 1) if len(end_word) else end_word
        self.edges = np.append(self.begin_word, len(starts))
        self.starts, self.ends = starts[self.begin_word], ends[end_word]
        self.word_starts, self.word_ends, self.first_word = starts, ends, first
        past = ends.copy()
        past[:-1] = np.where(last[:-1], ends[:-1], starts[1:])
        self.hash = h(starts, past, 6)

    def removable(self, a: int, b: int, min_words: int) -> list[tuple[int, int]]:
        """What goes of a matching run of words: its whole lines, and the parts of lines at its ends where they are long.

        The run goes as it is if less than half of it are whole lines.
        """
        edges = self.edges
        low, high = int(edges[np.searchsorted(edges, a)]), int(edges[np.searchsorted(edges, b, side="right") - 1])
        if 2 * (high - low) < b - a:
            return [(a, b)]
        return [(low, high), *[(p, q) for p, q in ((a, low), (high, b)) if q - p >= min_words]]

    def chunks(self) -> tuple[np.ndarray, ...]:
        """Text, first word, word past the end, first byte, key and byte past the end of every posted run of words."""
        n = len(self.hash) - GRAM + 1
        if n < WINDOW:
            return (np.zeros(0, np.int64),) * 6
        at = np.arange(n)
        grams = SpanHash(self.hash)(at, at + GRAM, 7)
        least, width = grams, 1
        while width < WINDOW:  # the smallest of a window, the last one of equals
            step = min(width, WINDOW - width)
            later = least[step:] <= least[: len(least) - step]
            at = np.where(later, at[step:], at[: len(at) - step])
            least = np.where(later, least[step:], least[: len(least) - step])
            width += step
        row = np.repeat(np.arange(len(self.first_word) - 1), np.diff(self.first_word))
        at = np.unique(at[row[: len(at)] == row[GRAM + WINDOW - 2 :]])
        pos = at - self.first_word[row[at]]
        return row[at], pos, pos + GRAM, self.word_starts[at], grams[at].view(np.int64), self.word_ends[at + GRAM - 1]


def places(docs: DataFrame) -> DataFrame:
    """place (doc_id and hash of the text: repeated rows are one), text; without null doc_ids."""
    return docs.where("doc_id IS NOT NULL").select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("place"), "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """key, place, pos of all posted runs of words."""
    rows = places(docs)
    kind = rows.schema["place"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_blocks(offsets, 1 << 18):
                row, pos, _, _, key, _ = Lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).chunks()
                at = batch.column("place").slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key), at, pa.array(pos.astype(np.int32))], ["key", "place", "pos"])

    return in_batches(rows).mapInArrow(run, f"key long, place {kind}, pos int")


def regions(docs: DataFrame) -> DataFrame:
    """place, first_place, diagonals: pairs of texts and where their posted runs line up."""
    occ = materialize(occurrences(docs), "line-posts")
    first = occ.groupBy("key").agg(F.min(F.struct("place", "pos")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("key", "first")
    first = materialize(first, "line-firsts")  # a plain side, so that a key with very many places can be split
    later = occ.join(first, "key").where(F.struct("place", "pos") != F.col("first"))
    lined = later.groupBy("place", F.col("first.place").alias("first_place"), (F.col("pos") - F.col("first.pos")).alias("shift")).agg(F.min("pos").alias("low"), (F.max("pos") + GRAM).alias("high"))
    return lined.groupBy("place", "first_place").agg(F.collect_list(F.struct(F.col("shift").cast("int").alias("shift"), "low", "high")).alias("diagonals"))  # as many as the later text has posted runs, at most


def matching_runs(equal: np.ndarray) -> np.ndarray:
    """(first, past) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def same_words(a: bytes, b: bytes) -> bool:
    return a == b or a.split() == b.split()


def removals(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_hash, spans (begin, end in characters, ascending)."""
    found = materialize(regions(docs), "line-regions")
    wanted = broadcast_if_small(found.select(F.explode(F.array("place", "first_place")).alias("place")).distinct())
    texts = materialize(places(docs).join(wanted, "place", "left_semi").dropDuplicates(["place"]), "line-texts")
    rows = with_texts(found, texts.withColumnRenamed("place", "node"), {"place": "text", "first_place": "first_text"})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            firsts = batch.column("first_key").to_numpy()
            new = np.append(True, firsts[1:] != firsts[:-1])[: len(firsts)]  # neighbours with one first text read it once
            which = np.append(np.cumsum(new) - 1, new.sum())
            (da, oa), (db, ob) = text_bytes(batch.column("text")), text_bytes(batch.column("first_text").take(pa.array(np.flatnonzero(new))))
            edges = batch.column("diagonals").offsets.to_numpy()
            shifts, lows, highs = (batch.column("diagonals").values.field(c).to_numpy() for c in ("shift", "low", "high"))
            out = []
            for lo, hi in row_blocks(oa + ob[which], 1 << 18):
                f0, f1 = which[lo], which[hi - 1] + 1
                later, early = da[oa[lo] : oa[hi]], db[ob[f0] : ob[f1]]
                x, y = Lines(later, oa[lo : hi + 1] - oa[lo]), Lines(early, ob[f0 : f1 + 1] - ob[f0])
                chars = np.concatenate([[0], np.cumsum((later & 0xC0) != 0x80)])
                later, early = later.tobytes(), early.tobytes()
                for i in range(hi - lo):
                    u0, j = x.first_word[i], which[lo + i] - f0
                    v0 = y.first_word[j]
                    hx, hy = x.hash[u0 : x.first_word[i + 1]], y.hash[v0 : y.first_word[j + 1]]
                    base = chars[oa[lo + i] - oa[lo]]
                    gone, free = np.zeros(len(hx), bool), np.arange(len(hx))
                    same = lambda w, s: later[x.word_starts[u0 + w] : x.word_ends[u0 + w]] == early[y.word_starts[v0 + w - s] : y.word_ends[v0 + w - s]]  # noqa: B023, E731
                    mine = np.arange(edges[lo + i], edges[lo + i + 1])
                    for d in mine[np.argsort(lows[mine] - highs[mine], kind="stable")].tolist():  # the long ones first
                        if not len(free):
                            break
                        shift, low, high = int(shifts[d]), int(lows[d]), int(highs[d])
                        begin, end = max(0, shift), min(len(hx), len(hy) + shift)
                        if end <= begin:
                            continue
                        k = int(np.searchsorted(free, low))
                        g0, g1 = int(free[k - 1]) + 1 if k else 0, int(free[k]) if k < len(free) else len(hx)
                        if high <= g1 and (g0 <= begin or not same(g0 - 1, shift)) and (g1 >= end or not same(g1, shift)):
                            continue  # the match ends inside what goes already, as for the many diagonals of one word over and over
                        runs = matching_runs(hx[begin:end] == hy[begin - shift : end - shift]) + begin
                        runs = runs[(runs[:, 1] > low) & (runs[:, 0] < high) & (runs[:, 1] - runs[:, 0] >= min_words - 1)]
                        for a, b in runs.tolist():
                            u, v = u0 + a, v0 + a - shift
                            if b < end and same(b, shift):
                                b += 1  # a word that only differs in what follows it
                            if b - a < min_words or gone[a:b].all() or not same_words(later[x.word_starts[u] : x.word_ends[u0 + b - 1]], early[y.word_starts[v] : y.word_ends[v0 + b - shift - 1]]):
                                continue
                            for p, q in x.removable(u, u0 + b, min_words):
                                gone[p - u0 : q - u0] = True
                            free = np.flatnonzero(~gone)
                    for a, b in matching_runs(gone):
                        past = x.word_starts[u0 + b] if u0 + b < x.first_word[i + 1] else oa[lo + i + 1] - oa[lo]
                        out.append((lo + i, int(chars[x.word_starts[u0 + a]] - base), int(chars[past] - base)))
            at = pa.array([r[0] for r in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), *[pa.array([r[j] for r in out], pa.int32()) for j in (1, 2)]],
                ["doc_id", "text_hash", "begin", "end"],
            )

    spans = rows.select("place.doc_id", "place.text_hash", "text", F.xxhash64("first_place").alias("first_key"), "first_text", "diagonals").mapInArrow(run, f"doc_id {kind}, text_hash long, begin int, end int")
    return spans.distinct().groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and n_spans and n_chars_removed.

    Columns of these two names in the input are replaced.  Rows are never
    dropped: a text whose every line occurs earlier becomes empty.  A null text
    stays null, and rows with a null doc_id are left as they are.  Texts of any
    length are taken whole; a task holds a block of them, or one pair of texts.
    Repeated rows of one doc_id with one text are one place and are cleaned alike;
    different texts of one doc_id are places of their own, in the order of a hash.
    An empty table gives an empty result.
    """
    docs = docs.drop("n_spans", "n_chars_removed")
    cuts = materialize(removals(docs, min_words), "line-cuts").select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "spans")
    size = cuts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("spans")).alias("spans")).first()
    few = size["rows"] <= BROADCAST_CUTS and (size["spans"] or 0) <= 4 * BROADCAST_CUTS
    rows = docs.join(F.broadcast(cuts) if few else cuts, (F.col("doc_id") == F.col("cut_id")) & (F.xxhash64("text") == F.col("cut_hash")), "left")
    cleaned = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), s["begin"] - acc["at"]))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cleaned)
    out = rows.withColumn("clean_text", text)
    return out.select(
        *[F.col("clean_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).alias("n_spans"),
        F.coalesce(F.length("text") - F.length("clean_text"), F.lit(0)).alias("n_chars_removed"),
    )
