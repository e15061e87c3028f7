"""Reproducible draws: a hash of (draw, index) instead of a generator's state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws by arithmetic are whole numbers below this prime, so products stay within 64 bits.
PRIME = 2147483647
#: Multipliers of the two steps (known multiplicative generators for this prime).
FIRST, SECOND = 48271, 69621


def draw_hash(*parts: Column) -> Column:
    """A 48-bit integer from the md5 of the parts joined with ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def scrambled(x, key):
    """A number below PRIME from a nonnegative one and a key below PRIME: two keyed steps, each squared.

    Plain arithmetic, so it is the same for long columns, for numpy's int64 arrays and, by ``scrambled_sql``, in SQL.
    """
    t = (x % PRIME * FIRST + key) % PRIME
    t = (t * t % PRIME * SECOND + key) % PRIME
    return t * t % PRIME


def scrambled_sql(x: str, key: str) -> str:
    inner = f"list_transform([(({x}) % {PRIME} * {FIRST} + ({key})) % {PRIME}], lambda t: (t * t % {PRIME} * {SECOND} + ({key})) % {PRIME})[1]"
    return f"list_transform([{inner}], lambda t: t * t % {PRIME})[1]"


#: Rounds of the bijection, and the least width of its places: halves of one or two bits would mix badly.
ROUNDS, LEAST_BITS = 6, 6


def round_tables(n: int, draws, seed: int):
    """For each round the values (draws x halves) that it gives to every possible half of a place of 0 .. n - 1."""
    import numpy as np

    width = max((n - 1).bit_length(), LEAST_BITS)
    low = (width + 1) // 2
    bits = (width - low, low)
    draws = np.asarray(draws, np.int64)[:, None]
    return [scrambled(np.arange(1 << bits[1 - r % 2], dtype=np.int64)[None, :], scrambled(draws * ROUNDS + r + 1, seed)) & ((1 << bits[r % 2]) - 1) for r in range(ROUNDS)]


def partners(i, n: int, draws, seed: int, tables=None):
    """For each draw (rows) the places 0 .. n - 1 that ``i`` (columns) are sent to: a keyed bijection of 0 .. n - 1.

    A Feistel network mixes the upper with the lower bits of a place; a result
    beyond n - 1 is sent on (it walks its cycle) until it is one of the n.  A round's
    values are looked up in ``round_tables``, since halves are few.
    """
    import numpy as np

    i, draws = np.asarray(i, np.int64), np.asarray(draws, np.int64)
    low = (max((n - 1).bit_length(), LEAST_BITS) + 1) // 2
    mask, tables = (1 << low) - 1, round_tables(n, draws, seed) if tables is None else tables
    out = np.empty((len(draws), len(i)), np.int64)
    for d in range(len(draws)):
        rounds = [t[d] for t in tables]
        x, open_ = i, None
        while open_ is None or len(open_):
            half = [x >> low, x & mask]
            for r, values in enumerate(rounds):
                half[r % 2] = half[r % 2] ^ values.take(half[1 - r % 2])
            x = (half[0] << low) | half[1]
            if open_ is None:
                out[d] = x
                open_ = np.flatnonzero(x >= n)
            else:
                out[d, open_] = x
                open_ = open_[x >= n]
            x = out[d, open_]
    return out


def partners_sql(rows: str, draws: int, by: str) -> str:
    """CTEs ``walk`` and ``partner`` (draw, ``by``, i, j) over ``rows`` (``by``, i, n, seed): the same bijection; needs WITH RECURSIVE."""
    x = "x"
    width = f"greatest(length(ltrim(bin(n - 1), '0')), {LEAST_BITS})"
    steps = f"low AS (SELECT draw, {by}, i, n, seed, ({width} + 1) // 2 AS low, {width} - ({width} + 1) // 2 AS high FROM {rows}, range(0, {draws}) t(draw)),\n"
    step = "x0 AS (SELECT *, x >> low AS a, x & ((1::BIGINT << low) - 1) AS b FROM w)"
    for r in range(ROUNDS):
        mix = scrambled_sql("b" if r % 2 == 0 else "a", scrambled_sql(f"draw * {ROUNDS} + {r + 1}", "seed"))
        new = f"xor(a, {mix} & ((1::BIGINT << high) - 1)) AS a" if r % 2 == 0 else f"xor(b, {mix} & ((1::BIGINT << low) - 1)) AS b"
        step += f", x{r + 1} AS (SELECT * REPLACE ({new}) FROM x{r})"
    one = f"SELECT draw, {by}, i, n, seed, low, high, (a << low) | b AS {x} FROM (WITH {step.replace('FROM w)', 'FROM {src})')} SELECT * FROM x{ROUNDS})"
    first = one.replace("{src}", "(SELECT *, i::BIGINT AS x FROM low)")
    more = one.replace("{src}", "(SELECT * FROM walk WHERE x >= n)")
    return f"{steps}walk AS ({first} UNION ALL {more}), partner AS (SELECT draw, {by}, i, x AS j FROM walk WHERE x < n)"
