"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Every code point has a class, and a class is a function on the states of a small
automaton that knows where pieces begin.  Composition of such functions is
associative, so the states of all characters of a block of texts come from a
prefix scan over function numbers with one composition table; no regular
expression is involved.  Look-ahead (the second letter of a contraction, the
last white space before text) is put into the class beforehand.  The resulting
slices go through a cache of merged pieces; each token's byte offset is kept,
and decoding lays the vocabulary's bytes out at these offsets.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, row_blocks, text_bytes

# classes of characters
LETTER, S_T_M_D, PAIR, NUMBER, OTHER, APOSTROPHE, SPACE_IN, SPACE_LAST, WHITE_IN, WHITE_LAST = range(10)
# states after a character: between pieces, in a run of letters, numbers or others, after an apostrophe that
# begins a piece, after the first of a contraction's two letters, after a space that begins a piece, in white space
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_APOSTROPHE, IN_PAIR, IN_SPACE, IN_WHITE = range(8)
STATES = 8
#: The characters of \s in the splitting pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces kept in a worker's cache before it starts anew.
CACHE_PIECES = 200_000
BLOCK_BYTES = 1 << 18


def step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this character."""
    if kind in (SPACE_IN, WHITE_IN):
        return IN_WHITE, state != IN_WHITE
    if kind == SPACE_LAST:
        return IN_SPACE, True
    if kind == WHITE_LAST:
        return FRESH, True
    if state == IN_PAIR:
        return FRESH, False
    if kind == APOSTROPHE:
        joins = state in (IN_OTHERS, IN_APOSTROPHE, IN_SPACE)
        return (IN_OTHERS if joins else IN_APOSTROPHE), not joins
    if kind == OTHER:
        return IN_OTHERS, state not in (IN_OTHERS, IN_APOSTROPHE, IN_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, IN_SPACE)
    if state == IN_APOSTROPHE and kind == S_T_M_D:
        return FRESH, False
    if state == IN_APOSTROPHE and kind == PAIR:
        return IN_PAIR, False
    return IN_LETTERS, state not in (IN_LETTERS, IN_SPACE)


@functools.cache
def automaton():
    """Function number of each class, of each class at a text's start, composition table, values, begin table."""
    by_class = [tuple(step(s, c)[0] for s in range(STATES)) for c in range(10)]
    at_start = [(step(FRESH, c)[0],) * STATES for c in range(10)]
    known = {f: i for i, f in enumerate(dict.fromkeys(by_class + at_start))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in by_class:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    values = np.array(list(known), np.uint8)
    table = np.zeros((len(known), len(known)), np.int32)
    for f, i in known.items():
        for g, j in known.items():
            table[i, j] = known[tuple(g[s] for s in f)]
    begins = np.array([[step(s, c)[1] for c in range(10)] for s in range(STATES)])
    return np.array([known[f] for f in by_class], np.int32), np.array([known[f] for f in at_start], np.int32), table, values, begins


@functools.cache
def base_classes() -> np.ndarray:
    """Class of every code point, before look-ahead."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            out[c] = LETTER
        elif major == "N":
            out[c] = NUMBER
    out[WHITE] = WHITE_IN
    out[0x20] = SPACE_IN
    out[0x27] = APOSTROPHE
    out[[ord(c) for c in "stmd"]] = S_T_M_D
    return out


def scan(numbers: np.ndarray, table: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix products of function numbers: within blocks, over the blocks, then together."""
    n, size = len(numbers), len(table)
    if n <= width:
        out = numbers.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], numbers[i]]
        return out
    blocks = -(-n // width)
    padded = np.full(blocks * width, numbers[-1], np.int32)
    padded[:n] = numbers
    acc = np.ascontiguousarray(padded.reshape(blocks, width).T)
    flat = table.reshape(-1)
    for j in range(1, width):
        acc[j] = flat[acc[j - 1] * size + acc[j]]
    before = scan(np.ascontiguousarray(acc[-1]), table)
    acc[:, 1:] = flat[before[:-1] * size + acc[:, 1:]]
    return np.ascontiguousarray(acc.T).reshape(-1)[:n]


def piece_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where pieces begin, for the code points of texts that begin at ``starts``."""
    if not len(points):
        return np.zeros(0, np.int64)
    by_class, at_start, table, values, begins = automaton()
    kinds = base_classes()[points]
    first = np.zeros(len(points) + 1, bool)
    first[starts] = True
    ends_text = first[1:].copy()
    ends_text[-1] = True
    following = np.append(points[1:], 0)
    following[ends_text] = 0
    white = kinds >= SPACE_IN
    last = white & ~ends_text & ~np.append(white[1:], False)
    kinds[last] += 1
    e = following == ord("e")
    pair = ((points == ord("r")) & e) | ((points == ord("v")) & e) | ((points == ord("l")) & (following == ord("l")))
    kinds[pair] = PAIR
    first = first[:-1]
    numbers = np.where(first, at_start[kinds], by_class[kinds])
    after = values[scan(numbers, table), FRESH]
    before = np.empty_like(after)
    before[0] = FRESH
    before[1:] = after[:-1]
    before[first] = FRESH
    return np.flatnonzero(begins[before, kinds])


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: adjacent parts with the lowest rank merge first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.sizes)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if mid < 0 or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, -1
            if stop < n:
                left[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(piece[left[i] : stop])) is not None:
                heapq.heappush(heap, (r, left[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


class Codec(dict):
    """Cache from a piece to its number; the ids of piece k are ids[at[k] : at[k] + n[k]]."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids, self.at, self.n = [], [], []
        self._arrays = None

    def __missing__(self, piece: str) -> int:
        ids = self.vocabulary.merge(piece.encode())
        number = len(self.at)
        self.at.append(len(self.ids))
        self.n.append(len(ids))
        self.ids += ids
        self[piece] = number
        return number

    def arrays(self):
        """The cache's lists as arrays; only what is new is converted."""
        old = self._arrays or (np.zeros(0, np.int32),) * 3
        lists = (self.ids, self.at, self.n)
        self._arrays = tuple(a if len(a) == len(x) else np.concatenate([a, np.array(x[len(a) :], np.int32)]) for a, x in zip(old, lists))
        return self._arrays

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, each token's byte offset in its text, and the first token of each text (one more at the end)."""
        if len(self.at) > CACHE_PIECES:
            self.reset()
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(lead)])[offsets]
        begin = piece_starts(points, chars[:-1][chars[1:] > chars[:-1]])
        edges = begin.tolist()
        numbers = np.array(list(map(self.__getitem__, [text[a:b] for a, b in zip(edges, edges[1:] + [len(text)])])), np.int64)
        all_ids, at, n = self.arrays()
        counts = n[numbers].astype(np.int64) if len(numbers) else np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = all_ids[np.repeat(at[numbers] - (ends - counts), counts) + np.arange(total)] if total else np.zeros(0, np.int32)
        piece_of_text = np.searchsorted(begin, chars)
        first = np.concatenate([[0], ends])[piece_of_text]
        sizes = self.vocabulary.sizes[ids]
        place = np.cumsum(sizes) - sizes - np.repeat(offsets[:-1], np.diff(first))
        return ids, place, first

    def decode(self, ids: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts and their offsets, laid out by the tokens' offsets."""
        v = self.vocabulary
        sizes = v.sizes[ids]
        last = np.maximum(first[1:] - 1, 0)
        long = np.where(np.diff(first) > 0, (place[last] + sizes[last]) if len(ids) else 0, 0)
        offsets = np.concatenate([[0], np.cumsum(long)])
        total = int(offsets[-1])
        begin = place + np.repeat(offsets[:-1], np.diff(first))
        out = np.zeros(total, np.uint8)
        nth = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(begin, sizes) + nth] = v.bytes[np.repeat(v.places[ids], sizes) + nth]
        return out, offsets


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(Vocabulary(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids, offsets (and decoded: the bytes made from these two) for every row and whole text.

    ``offsets`` are the tokens' byte offsets in the text.  A null or empty text
    has no tokens.  Repeated rows get equal results, a text of any length is one
    row, an empty table gives an empty result, further columns are ignored.
    ``path`` names a file of ranks that every executor can open.
    """
    path = path or default_path()
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        code = codec(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                ids, place, first = code.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                edges = pa.array(first, pa.int32())
                out = [batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(place.astype(np.int32)))]
                names = ["doc_id", "ids", "offsets"]
                if decoded:
                    back, at = code.decode(ids, place, first)
                    out.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(back)]))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(out, names)

    return in_batches(rows).mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded (binary) from doc_id, ids and offsets; null lists count as empty."""
    path = path or default_path()
    empty = F.array().cast("array<int>")
    rows = encoded.select("doc_id", F.coalesce("ids", empty).alias("ids"), F.coalesce("offsets", empty).alias("offsets"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        code = codec(path)
        for batch in batches:
            ids, place = batch.column("ids"), batch.column("offsets")
            first = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            back, at = code.decode(ids.flatten().to_numpy(), place.flatten().to_numpy().astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(back)]).cast(pa.binary())], ["doc_id", "decoded"])

    return in_batches(rows).mapInArrow(run, f"doc_id {kind}, decoded binary")


def digest(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, derived from what ``encode`` returns; ``ids`` too if wanted.

    One row per input row.  A null or empty text has no tokens and the digests of
    nothing; repeated rows get equal digests; a text of any length is encoded
    whole; an empty table gives an empty result; further columns are ignored.
    """
    e = encode(docs, path, decoded=True)
    return e.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )
