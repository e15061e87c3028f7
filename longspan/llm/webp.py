"""Media columns: lossless WebP files, written from byte payloads and read back into pixel arrays.

The reader covers the whole lossless format: prefix codes (simple, normal and
by meta codes), back-references, the colour cache, and the predictor,
cross-colour, green and palette transforms.  Bits are read in order, which is
serial; where only the green channel of an image carries information (palette
images) the symbol at every bit position is looked up at once and only the
chain from one symbol to the next is walked.
"""

from __future__ import annotations

import functools
import struct
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, row_blocks, text_bytes

#: Payloads are padded to whole rows of this many samples.
ROW = 576
MAX_SIDE = 1 << 14
#: Order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
CACHE_FACTOR = 0x1E35A7BD


class FormatError(ValueError):
    """The bytes are no lossless WebP file."""


@functools.cache
def near_offsets() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: by distance, then by |dx|, right before left."""
    places = [(x, y) for x in range(-7, 9) for y in range(8) if y or x > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# ---------------------------------------------------------------- prefix codes


@functools.cache
def reversed_bits() -> np.ndarray:
    """The 16-bit values with their bits in the other order."""
    out = np.zeros(1 << 16, np.uint32)
    for k in range(16):
        out |= ((np.arange(1 << 16, dtype=np.uint32) >> k) & 1) << (15 - k)
    return out


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical code of each symbol, bits reversed so that the first bit read is the lowest."""
    out = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order].astype(np.int64)
    # codes in order, aligned to 16 bits, are the running sum of the shares that they take
    share = 1 << (16 - sizes)
    out[order] = reversed_bits()[(np.cumsum(share) - share) & 0xFFFF]
    return out


class PrefixCode:
    """Look-up tables by the next ``width`` bits; one symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None or not len(used):
            self.only, self.width = self.only or 0, 0
            return
        sizes = lengths[used].astype(np.int64)
        self.width = int(sizes.max())
        if int((1 << (self.width - sizes)).sum()) != 1 << self.width:
            raise FormatError("incomplete prefix code")
        order = used[np.argsort(sizes, kind="stable")]
        by_first_bit = np.repeat(order, 1 << (self.width - lengths[order].astype(np.int64)))
        self.symbol = by_first_bit[reversed_bits()[: 1 << self.width] >> (16 - self.width)].astype(np.int32)
        self.bits = lengths[self.symbol].astype(np.uint8)
        self.lists = None

    @classmethod
    def of_one(cls, symbol: int) -> "PrefixCode":
        out = cls.__new__(cls)
        out.only, out.width = symbol, 0
        return out

    def read(self, bits: "BitReader") -> int:
        if self.width == 0:
            return self.only
        if self.lists is None:
            self.lists = (self.symbol.tolist(), self.bits.tolist())
        at = bits.peek(self.width)
        bits.at += self.lists[1][at]
        return self.lists[0][at]


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(8), at

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        if byte >= len(self.data):
            raise FormatError("file ends early")
        return int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out


#: Repeated code lengths: the value (None: the one before), bits of the count, least count.
REPEATS = {16: (None, 2, 3), 17: (0, 3, 3), 18: (0, 7, 11)}


def read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if len(set(symbols)) == 1:
            return PrefixCode.of_one(symbols[0])
        lengths = np.zeros(alphabet, np.uint8)
        lengths[symbols] = 1
        return PrefixCode(lengths)
    lengths = np.zeros(alphabet, np.uint8)
    small = np.zeros(19, np.uint8)
    for i in range(4 + bits.read(4)):
        small[LENGTH_ORDER[i]] = bits.read(3)
    code = PrefixCode(small)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, previous, out = 0, 8, [0] * alphabet
    symbols, sizes = (code.symbol.tolist(), code.bits.tolist()) if code.width else ([code.only], [0])
    mask, data, place, end = len(symbols) - 1, bits.data, bits.at, 8 * len(bits.data)
    while at < alphabet and left:
        left -= 1
        if place >= end:
            raise FormatError("file ends early")
        ahead = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        s, n = symbols[ahead & mask], sizes[ahead & mask]
        place += n
        if s < 16:
            out[at] = s
            at += 1
            previous = s or previous
            continue
        value, more, least = REPEATS[s]
        n = (ahead >> n & ((1 << more) - 1)) + least
        place += more
        if at + n > alphabet:
            raise FormatError("too many code lengths")
        if value is None:
            out[at : at + n] = [previous] * n
        at += n
    bits.at = place
    lengths[:] = out
    return PrefixCode(lengths)


def prefix_value(bits: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


# ---------------------------------------------------------------- pixels


def walk_green(bits: BitReader, codes: list[PrefixCode], width: int, n: int) -> np.ndarray | None:
    """Pixels where red, blue and alpha are constant and no cache is used; None if that is not so."""
    green = codes[0]
    if any(c.width for c in codes[1:4]) or (green.width and green.symbol.max() >= 256 + LENGTH_CODES):
        return None
    constant = codes[3].only << 24 | codes[1].only << 16 | codes[2].only
    if green.width == 0:
        return None if green.only >= 256 else np.full(n, constant | green.only << 8, np.uint32)
    start = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8)[start:]
    usable = len(raw) - 3
    words = raw[:usable].astype(np.int64)
    words |= raw[1 : usable + 1].astype(np.int64) << 8
    words |= raw[2 : usable + 2].astype(np.int64) << 16
    peeks = words[:, None] >> np.arange(8)
    peeks &= (1 << green.width) - 1
    peeks = peeks.reshape(-1)
    step = green.bits.take(peeks)
    # four symbols at once where all of them begin in the file
    place = np.arange(max(0, len(step) - 3 * green.width))
    two = step[: max(0, len(step) - green.width)].copy()
    two += step.take(np.arange(len(two)) + two)
    four = two[: len(place)] + two.take(place + two[: len(place)]) if len(place) else two[:0]
    one_step, four_steps = step.tobytes(), four.tobytes()
    out, have, at = np.empty(n, np.uint8), 0, bits.at - 8 * start
    while have < n:
        fours, ones = [], []
        add = fours.append
        try:
            for _ in repeat(None, (n - have) // 4):
                add(at)
                at += four_steps[at]
        except IndexError:  # also where a copy stands for most of the rest
            at = fours.pop()
        add = ones.append
        try:
            for _ in repeat(None, n - have - 4 * len(fours)):
                add(at)
                at += one_step[at]
        except IndexError:
            ones.pop()
        chain = np.empty((len(fours), 4), np.int64)
        chain[:, 0] = fours
        for k in range(3):
            chain[:, k + 1] = chain[:, k] + step.take(chain[:, k])
        chain = np.append(chain.reshape(-1), np.array(ones, np.int64))
        symbols = green.symbol.take(peeks.take(chain))
        copy = np.flatnonzero(symbols >= 256)
        literals = int(copy[0]) if len(copy) else len(symbols)
        out[have : have + literals] = symbols[:literals]
        have += literals
        if have == n:
            break
        if not len(copy):
            raise FormatError("file ends early")
        bits.at = int(chain[literals]) + 8 * start
        length, distance = read_copy(bits, codes, green.read(bits), width, have)
        length = min(length, n - have)
        if distance == 1:
            out[have : have + length] = out[have - 1]
        else:
            for i in range(have, have + length, distance):
                part = min(distance, have + length - i)
                out[i : i + part] = out[i - distance : i - distance + part]
        have += length
        at = bits.at - 8 * start
    bits.at = at + 8 * start
    return out.astype(np.uint32) << 8 | np.uint32(constant)


def read_copy(bits: BitReader, codes: list[PrefixCode], symbol: int, width: int, have: int) -> tuple[int, int]:
    """Length and distance in pixels of a back-reference."""
    length = prefix_value(bits, symbol - 256)
    code = prefix_value(bits, codes[4].read(bits))
    if code > 120:
        distance = code - 120
    else:
        dx, dy = near_offsets()[code - 1]
        distance = max(1, dx + dy * width)
    if distance > have:
        raise FormatError("back-reference before the first pixel")
    return length, distance


def read_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An image of prefix codes, before any transform is undone."""
    n = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_of, shift, n_groups = None, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = read_pixels(bits, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
        groups_of = (meta >> 8 & 0xFFFF).reshape((height + (1 << shift) - 1) >> shift, -1).tolist()
        n_groups = int((meta >> 8 & 0xFFFF).max()) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else None
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    groups = [[read_code(bits, s) for s in sizes] for _ in range(n_groups)]
    if groups_of is None and cache is None and (fast := walk_green(bits, groups[0], width, n)) is not None:
        return fast
    out: list[int] = []
    codes, to_cache = groups[0], 0
    while len(out) < n:
        at = len(out)
        if groups_of is not None:
            codes = groups[groups_of[at // width >> shift][at % width >> shift]]
        s = codes[0].read(bits)
        if s < 256:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 256 + LENGTH_CODES:
            length, distance = read_copy(bits, codes, s, width, at)
            for i in range(at, min(n, at + length)):
                out.append(out[i - distance])
        else:
            out.append(cache[s - 256 - LENGTH_CODES])
        if cache is not None:
            for p in out[to_cache:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            to_cache = len(out)
    return np.array(out, np.uint32)


# ---------------------------------------------------------------- transforms


def channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) signed values: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4).astype(np.int32)


def joined(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view("<u4")[..., 0]


def guess(mode: int, left, top, top_left, top_right) -> list[int]:
    """Prediction of the four channels by one of the predictor's modes."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clip = lambda xs: [min(255, max(0, x)) for x in xs]
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left))
        return left if to_left < to_top else top
    if mode == 12:
        return clip([x + t - c for x, t, c in zip(left, top, top_left)])
    if mode == 13:
        m = mean(left, top)
        return clip([x + int((x - c) / 2) for x, c in zip(m, top_left)])
    return [0, 0, 0, 255]


def predict(pixels: np.ndarray, modes: np.ndarray, bits: int, inverse: bool = True) -> np.ndarray:
    """Adds (or takes away) each pixel's prediction from its neighbours."""
    height, width = pixels.shape
    given = channels(pixels).tolist()
    out = [[None] * width for _ in range(height)]
    whole = out if inverse else given
    sign = 1 if inverse else -1
    modes = (modes >> 8 & 15).tolist()
    for y in range(height):
        for x in range(width):
            if y == 0:
                g = [0, 0, 0, 255] if x == 0 else whole[0][x - 1]
            elif x == 0:
                g = whole[y - 1][0]
            else:
                above = whole[y - 1]
                right = above[x + 1] if x + 1 < width else whole[y][0]
                g = guess(modes[y >> bits][x >> bits], whole[y][x - 1], above[x], above[x - 1], right)
            out[y][x] = [(a + sign * b) & 255 for a, b in zip(given[y][x], g)]
    return joined(np.array(out))


def cross_colour(pixels: np.ndarray, elements: np.ndarray, bits: int, inverse: bool = True) -> np.ndarray:
    height, width = pixels.shape
    p, e = channels(pixels), channels(elements)
    e = e[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v: (v & 255 ^ 128) - 128
    delta = lambda t, c: signed(t) * signed(c) >> 5
    sign = 1 if inverse else -1
    red = p[..., 2] + sign * delta(e[..., 0], p[..., 1])
    blue = p[..., 0] + sign * (delta(e[..., 1], p[..., 1]) + delta(e[..., 2], red if inverse else p[..., 2]))
    return joined(np.stack([blue & 255, p[..., 1], red & 255, p[..., 3]], -1))


def green_to_others(pixels: np.ndarray, sign: int) -> np.ndarray:
    p = channels(pixels)
    p[..., [0, 2]] += sign * p[..., [1]]
    return joined(p & 255)


def palette_bits(colours: int) -> int:
    """Log2 of the pixels that share one packed pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_palette(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = palette_bits(len(table))
    index = pixels >> 8 & 255
    if bits:
        each = 8 >> bits
        index = (index[..., None] >> (np.arange(1 << bits, dtype=np.uint32) * each)) & ((1 << each) - 1)
        index = index.reshape(len(pixels), -1)[:, :width]
    return np.append(table, np.zeros(256 - len(table), np.uint32)).astype(np.uint32)[index]


def decode(media: bytes) -> np.ndarray:
    """Pixels (height, width) as 32-bit ARGB values."""
    if media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L" or len(media) < 25 or media[20] != 0x2F:
        raise FormatError("no lossless WebP file")
    bits = BitReader(media[21 : 20 + struct.unpack("<I", media[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise FormatError("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise FormatError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            across, down = (now + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size
            data = read_pixels(bits, across, down, False).reshape(down, across)
            undo.append((kind, data, size, now))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, None, 0, now))
        else:
            n = bits.read(8) + 1
            table = joined(np.cumsum(channels(read_pixels(bits, n, 1, False)), axis=0) & 255)
            undo.append((kind, table, 0, now))
            b = palette_bits(n)
            now = (now + (1 << b) - 1) >> b
    pixels = read_pixels(bits, now, height, True).reshape(height, now)
    for kind, data, size, wide in reversed(undo):
        if kind == PREDICTOR:
            pixels = predict(pixels, data, size)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, data, size)
        elif kind == SUBTRACT_GREEN:
            pixels = green_to_others(pixels, 1)
        else:
            pixels = from_palette(pixels, data, wide)
    return pixels


# ---------------------------------------------------------------- writing


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of an optimal prefix code; rare symbols count more until no length is over ``most``."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights, least = counts[used].tolist(), 1
    while True:
        order = sorted(range(len(used)), key=lambda i: max(weights[i], least))
        leaves, joint = [max(weights[i], least) for i in order], []
        n = len(leaves)
        parent, i, j = [0] * (2 * n - 1), 0, 0
        for node in range(n, 2 * n - 1):  # both rows are ascending; of equals the leaf comes first
            both = 0
            for _ in (0, 1):
                if i < n and (j == len(joint) or leaves[i] <= joint[j]):
                    both += leaves[i]
                    parent[i] = node
                    i += 1
                else:
                    both += joint[j]
                    parent[n + j] = node
                    j += 1
            joint.append(both)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= most:
            for i, d in zip(order, depth):
                lengths[used[i]] = d
            return lengths
        least = least * 2 + 1


class BitWriter:
    """Fields of (value, number of bits), joined at the end."""

    def __init__(self):
        self.values, self.sizes, self.few = [], [], []

    def put(self, value: int, n: int) -> None:
        self.few.append((value, n))

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.few:
            few, self.few = np.array(self.few, np.int64), []
            self.put_all(few[:, 0], few[:, 1])
        self.values.append(values.astype(np.uint64))
        self.sizes.append(sizes.astype(np.int64))

    def bytes(self) -> bytes:
        self.put_all(np.zeros(0), np.zeros(0))
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        at = ends - sizes
        n_bytes = int(ends[-1] + 7) // 8
        # a field of up to 32 bits reaches over at most two aligned 32-bit words
        shifted = values << (at & 31).astype(np.uint64)
        word = at >> 5
        out = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        low = np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        high = np.add.reduceat(shifted >> np.uint64(32), first)
        out[word[first]] += low
        out[word[first] + 1] += high
        return out.astype("<u4").tobytes()[:n_bytes]


NO_BITS = np.zeros(256, np.uint32)


def put_one(bits: BitWriter, symbol: int) -> None:
    for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
        bits.put(value, n)


def put_code(bits: BitWriter, lengths: np.ndarray) -> None:
    """A prefix code: in the simple form for up to two byte symbols, else by run-length coded lengths."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        bits.put(1, 1)
        bits.put(len(used) - 1, 1)
        bits.put(1, 1)
        for s in used:
            bits.put(s, 8)
        return
    symbols, extras, widths = [], [], []

    def emit(s: int, extra: int = 0, width: int = 0) -> None:
        symbols.append(s)
        extras.append(extra)
        widths.append(width)

    all_lengths, at = lengths.tolist(), 0
    stop = used[-1] + 1
    while at < stop:
        if all_lengths[at]:
            emit(all_lengths[at])
            at += 1
            continue
        run = 1
        while all_lengths[at + run] == 0:
            run += 1
        at += run
        while run >= 11:
            n = min(run, 138)
            emit(18, n - 11, 7)
            run -= n
        if run >= 3:
            emit(17, run - 3, 3)
            run = 0
        for _ in range(run):
            emit(0)
    if len(symbols) < 2:
        emit(0)  # the count of stored lengths is two at least
    small = code_lengths(np.bincount(symbols, minlength=19), 7)
    bits.put(0, 1)
    stored = max(4, max(i for i, s in enumerate(LENGTH_ORDER) if small[s]) + 1)
    bits.put(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        bits.put(int(small[s]), 3)
    bits.put(1, 1)
    width = max(2, (len(symbols) - 2).bit_length())
    width += width & 1
    bits.put((width - 2) // 2, 3)
    bits.put(len(symbols) - 2, width)
    s, words = np.array(symbols), code_words(small)
    n = small if np.count_nonzero(small) > 1 else np.zeros_like(small)
    fields = np.column_stack([words[s], extras]).reshape(-1)
    sizes = np.column_stack([n[s], widths]).reshape(-1)
    bits.put_all(fields, sizes)


def prefix_symbol(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number for lengths or distance codes from 1."""
    v = np.asarray(values, np.int64) - 1
    if not len(v):
        return v, v, v
    high = np.maximum(np.floor(np.log2(np.maximum(v, 1))).astype(np.int64), 1)
    second = v >> (high - 1) & 1
    few = v < 4
    extra = np.where(few, 0, high - 1)
    return np.where(few, v, 2 * high + second), np.where(few, 0, v & ((1 << extra) - 1)), extra


def put_pixels(bits: BitWriter, pixels: np.ndarray, main: bool, copies: list[tuple[int, int, int]] = (), cache_bits: int = 0) -> None:
    """An image with one code group; ``copies`` are (first pixel, length, distance code), in order."""
    pixels = np.asarray(pixels, np.uint32).reshape(-1)
    if cache_bits:
        bits.put(1, 1)
        bits.put(cache_bits, 4)
    else:
        bits.put(0, 1)
    if main:
        bits.put(0, 1)
    literal = np.ones(len(pixels), bool)
    for at, length, _ in copies:
        literal[at : at + length] = False
    green = (pixels >> 8 & 255).astype(np.int64)
    hit = np.zeros(len(pixels), bool)
    if cache_bits:
        cache = [0] * (1 << cache_bits)
        for i, p in enumerate(pixels.tolist()):
            k = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
            hit[i] = literal[i] and cache[k] == p
            cache[k] = p
            if hit[i]:
                green[i] = 256 + LENGTH_CODES + k
    at = np.flatnonzero(literal)
    full = literal & ~hit
    green = green[at]
    plain = not cache_bits and bool(((pixels ^ pixels[0]) & np.uint32(0xFFFF00FF) == 0).all())
    channel = lambda rows: [(pixels[rows] >> k & 255).astype(np.int64) for k in (16, 0, 24)]
    begin = length_symbol = far_symbol = np.zeros(0, np.int64)
    if len(copies):
        begin, lengths, far = np.array(copies, np.int64).T
        length_symbol, length_extra, length_bits = prefix_symbol(lengths)
        far_symbol, far_extra, far_bits = prefix_symbol(far)
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    drawn = [np.concatenate([green, 256 + length_symbol]), *channel(at[:1] if plain else full), far_symbol]
    tables = []
    for n, symbols in zip(sizes, drawn):
        if len(symbols) < 2 and (not len(symbols) or symbols[0] < 256):  # takes no bits
            put_one(bits, int(symbols[0]) if len(symbols) else 0)
            tables.append((NO_BITS, NO_BITS))
            continue
        lengths = code_lengths(np.bincount(symbols, minlength=n))
        if np.count_nonzero(lengths) == 1 and lengths[256:].any():
            lengths[0] = 1  # the simple form holds byte symbols only
        put_code(bits, lengths)
        words = code_words(lengths)
        tables.append((words, lengths if np.count_nonzero(lengths) > 1 else np.zeros_like(lengths)))
    word, size = tables[0][0][green], tables[0][1][green]
    if plain:
        word, size = word[:, None], size[:, None]
    else:
        fields, widths, shown = [word], [size], ~hit[at]
        for symbols, (w, n) in zip(channel(at), tables[1:4]):
            fields.append(np.where(shown, w[symbols], 0))
            widths.append(np.where(shown, n[symbols], 0))
        word, size = np.column_stack(fields), np.column_stack(widths)
    if not len(begin):
        bits.put_all(word.reshape(-1), size.reshape(-1))
        return
    done = 0
    for k, first in enumerate(np.searchsorted(at, begin).tolist()):
        bits.put_all(word[done:first].reshape(-1), size[done:first].reshape(-1))
        done = first
        s, d = int(256 + length_symbol[k]), int(far_symbol[k])
        bits.put_all(
            np.array([tables[0][0][s], length_extra[k], tables[4][0][d], far_extra[k]]),
            np.array([tables[0][1][s], length_bits[k], tables[4][1][d], far_bits[k]]),
        )
    bits.put_all(word[done:].reshape(-1), size[done:].reshape(-1))


def file_of(bits: BitWriter) -> bytes:
    body = b"\x2f" + bits.bytes()
    pad = len(body) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(pad)


def header(width: int, height: int) -> BitWriter:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise FormatError("the image is too large")
    bits = BitWriter()
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(0, 1)
    bits.put(0, 3)
    return bits


def encode_samples(samples: np.ndarray, width: int) -> bytes:
    """A palette image whose green channel holds the samples; a closing run is one back-reference."""
    height = len(samples) // width
    bits = header(width, height)
    values = np.flatnonzero(np.bincount(samples, minlength=256))
    table = OPAQUE | values << 8
    bits.put(1, 1)
    bits.put(PALETTE, 2)
    bits.put(len(values) - 1, 8)
    steps = channels(table.astype(np.uint32))
    put_pixels(bits, joined(np.diff(steps, axis=0, prepend=0) & 255), False)
    slot = np.zeros(256, np.uint8)
    slot[values] = np.arange(len(values))
    index = slot[samples].reshape(height, width)
    b = palette_bits(len(values))
    if b:
        per = 1 << b
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per).astype(np.uint32)
        index = (index << (np.arange(per, dtype=np.uint32) * (8 >> b))).sum(axis=2)
    index = index.reshape(-1).astype(np.uint32)
    bits.put(0, 1)
    other = np.flatnonzero(index != index[-1])
    run = len(index) - (int(other[-1]) + 1 if len(other) else 0) - 1
    copies = [(len(index) - run, run, 2)] if 4 <= run <= 4096 else []  # distance code 2 is the pixel before
    put_pixels(bits, index << 8 | np.uint32(OPAQUE), True, copies)
    return file_of(bits)


def encode_pixels(pixels: np.ndarray, transforms: tuple[int, ...] = (), tile: int = 2, copies=(), cache_bits: int = 0, seed: int = 0) -> bytes:
    """Any ARGB image with chosen transforms (of random modes per tile), copies and cache."""
    height, width = pixels.shape
    rng = np.random.default_rng(seed)
    bits = header(width, height)
    for kind in transforms:
        bits.put(1, 1)
        bits.put(kind, 2)
        across, down = (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
        if kind == PREDICTOR:
            data = (rng.integers(0, 16, (down, across)) << 8 | OPAQUE).astype(np.uint32)
            pixels = predict(pixels, data, tile, inverse=False)
        elif kind == CROSS_COLOUR:
            data = (rng.integers(0, 1 << 24, (down, across)) | OPAQUE).astype(np.uint32)
            pixels = cross_colour(pixels, data, tile, inverse=False)
        elif kind == SUBTRACT_GREEN:
            pixels = green_to_others(pixels, -1)
            continue
        else:
            raise FormatError("palettes are written by encode_samples")
        bits.put(tile - 2, 3)
        put_pixels(bits, data, False)
    bits.put(0, 1)
    put_pixels(bits, pixels, True, copies, cache_bits)
    return file_of(bits)


# ---------------------------------------------------------------- columns


#: Bytes of one image; a longer payload is several images in a row.
IMAGE = ROW * MAX_SIDE


def pack(payload: np.ndarray) -> bytes:
    """The payload padded with 255 to whole rows of ROW samples, as WebP files one after the other."""
    rows = max(1, -(-len(payload) // ROW))
    payload = np.append(payload, np.full(rows * ROW - len(payload), 255, np.uint8))
    return b"".join(encode_samples(payload[at : at + IMAGE], ROW) for at in range(0, len(payload), IMAGE))


def unpack(media: bytes) -> tuple[np.ndarray, int, int]:
    """Samples, width and height in all of the files in ``media``, which must be of one width."""
    parts, widths, height, at = [], set(), 0, 0
    while at < len(media) or not parts:
        if len(media) - at < 8:
            raise FormatError("no lossless WebP file")
        past = at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        if past > len(media):
            raise FormatError("the file ends early")
        pixels = decode(media[at:past])
        parts.append((pixels >> 8 & 255).astype(np.uint8).reshape(-1))
        height += pixels.shape[0]
        widths.add(pixels.shape[1])
        at = past
    if len(widths) > 1:
        raise FormatError("images of several widths")
    return (np.concatenate(parts) if len(parts) > 1 else parts[0]), widths.pop(), height


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's bytes, padded with 255, as WebP files of ROW samples a row.

    A null text counts as empty, which still fills one row of samples.  Equal
    texts get equal files.  Texts of more than IMAGE bytes are several files in
    a row, each encoded by itself.  An empty table gives an empty result; further
    columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_blocks(offsets, 1 << 21):
                media = [pack(data[offsets[i] : offsets[i + 1]]) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return in_batches(rows).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def describe(samples: np.ndarray, width: int, height: int) -> str:
    """Size, mean, spread, entropy and colours of the samples, and the mean step between neighbours."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    spread = float(counts @ (np.arange(256) - mean) ** 2) / len(samples)
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean()) if len(samples) > 1 else 0.0
    return f"{width}x{height} mean={mean:.4f} sd={spread**0.5:.4f} entropy={abs(float(-(p * np.log2(p)).sum())):.4f} colours={len(p)} step={step:.4f}"


def read(media: DataFrame) -> DataFrame:
    """All columns of ``media`` with width, height, samples (the green channel's bytes) and feature.

    Files one after the other give their samples in that order.  A null or damaged
    file gives nulls; columns of these four names are replaced.
    """
    media = media.drop("width", "height", "samples", "feature")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("media"))
            at = 0
            while at < batch.num_rows:
                out, size, first = [], 0, at
                while at < batch.num_rows and size < 1 << 22:
                    try:
                        samples, width, height = unpack(column[at].as_py() or b"")
                        out.append((width, height, samples.tobytes(), describe(samples, width, height)))
                        size += len(samples)
                    except FormatError:
                        out.append((None, None, None, None))
                    at += 1
                more = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([c.slice(first, at - first) for c in batch.columns] + more, [*batch.schema.names, "width", "height", "samples", "feature"])

    return in_batches(media).mapInArrow(run, f"{schema}, width int, height int, samples binary, feature string")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the stored files and the samples read back: one row per input row.

    Null and empty texts are one row of padding; texts of any length are taken whole;
    repeated rows and equal texts get equal values; an empty table gives an empty
    result; further columns are ignored.
    """
    r = read(store(docs))
    return r.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
