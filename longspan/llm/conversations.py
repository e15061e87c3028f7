"""Conversation structure repair by signature deduplication.

A conversation's rows are ordered once, by a range partitioning and a sort within
partitions, so that a long conversation may lie in many partitions.  Each run of at
most CHUNK neighbouring rows becomes a compact signature, one character a row (role
and fault).  Every distinct signature is solved once: memoised recursion over its
suffixes gives, for each pair of states before and after it (nothing said yet,
after system, after user, after assistant), the least cost and the audit that is
least in ASCII order among the cheapest.  Edits of one position have different
letters, so the first difference of two audits decides, and neighbouring chunks
combine like products of 4 x 4 matrices: first the chunks of a partition, then the
partitions of a conversation.  Audits are joined back to the chunks and the edits
are replayed row by row.  The digest of a conversation is a running one over its
sorted rows; it holds one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, in_bounded_batches, materialize

#: Rows of a signature at most, as a power of two.
CHUNK_BITS = 8
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

#: States: 0 nothing said, 1 after system, 2 after user, 3 after assistant.
#: What user and assistant lead to; nothing else can be said there but system at the start.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
#: Cost and inserts that end a conversation well.
TAIL = {0: (0, ""), 1: (6, "ua"), 2: (3, "a"), 3: (0, "")}
#: Codes of edits: keep, delete, rerole to user or assistant, insert before the row; with the letters of the audit.
LETTER = {"K": "K", "D": "D", "U": "R", "A": "R", "u": "I", "a": "I"}
NONE = 1 << 40

_memo: dict[str, tuple] = {}


def suffix(signature: str) -> tuple:
    """For each state before and after: (cost, code of the first edit, state after that edit, whether it takes a row)."""
    known = _memo.get(signature)
    if known is None:
        known = _memo[signature] = tuple(_first_edits(signature))
    return known


def _first_edits(signature: str) -> Iterator[tuple]:
    if not signature:
        yield from ((0 if a == b else NONE, "", b, True) for a, b in product(range(4), repeat=2))
        return
    row, rest = signature[0], suffix(signature[1:])
    best = {}
    for a, b in product(range(4), repeat=2):
        options = []
        role, late = row.lower(), TRUNCATED * row.isupper()
        said, after = NEXT[a]
        options.append((DELETE + rest[4 * a + b][0], "D", "D", a, True))
        if row != "d":
            options.append((REROLE + late + rest[4 * after + b][0], "R", said.upper(), after, True))
            if role == said:
                options.append((late + rest[4 * after + b][0], "K", "K", after, True))
            if role == "s" and a == 0:
                options.append((late + rest[4 + b][0], "K", "K", 1, True))
        best[a, b] = min(options)
    for _ in range(3):  # an insert leads to another state of the same place; no cheapest way has more than two of them there
        for a, b in product(range(4), repeat=2):
            said, after = NEXT[a]
            best[a, b] = min(best[a, b], (INSERT + best[after, b][0], "I", said, after, False))
    for a, b in product(range(4), repeat=2):
        cost, _, code, after, takes = best[a, b]
        yield min(cost, NONE), code, after, takes


def edits(signature: str, a: int, b: int) -> list[str]:
    """Codes of each row's edits (inserts before it first) on the best way from state ``a`` to ``b``."""
    out, now, at = [], "", 0
    while at < len(signature):
        _, code, a, takes = suffix(signature[at:])[4 * a + b]
        now += code
        if takes:
            out.append(now)
            now, at = "", at + 1
    return out


def solve(signature: str) -> tuple[list[int], list[int], list[str | None]]:
    """Costs, ranks of the audits among those from the same state, and edits joined by commas, for the 16 pairs of states."""
    for at in range(len(signature), 0, -64):  # shorter suffixes first, so the recursion stays shallow
        suffix(signature[at:])
    found = suffix(signature)
    rows = [edits(signature, a, b) if found[4 * a + b][0] < NONE else None for a, b in product(range(4), repeat=2)]
    audits = ["".join(map(LETTER.get, "".join(r))) if r is not None else "~" for r in rows]
    ranks = [sorted(audits[4 * a : 4 * a + 4]).index(audits[4 * a + b]) for a, b in product(range(4), repeat=2)]
    return [x[0] for x in found], ranks, [",".join(r) if r is not None else None for r in rows]


def solved(signatures: DataFrame) -> DataFrame:
    """signature, cost, rank, edits (arrays of 16) of distinct signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("signature").to_pylist()
            found = []
            for name in names:
                found.append(solve(name))
                if len(_memo) > 50_000:
                    _memo.clear()
            cost, rank, edit = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(cost, pa.list_(pa.int64())), pa.array(rank, pa.list_(pa.int32())), pa.array(edit, pa.list_(pa.string()))], ["signature", "cost", "rank", "edits"])

    return signatures.mapInArrow(run, "signature string, cost array<long>, rank array<int>, edits array<string>")


def combine(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost and rank (4 x 4) of neighbouring pieces (n x 4 x 4) as one, and the state after each piece for every pair."""
    n = len(cost)
    total, order = cost[0], rank[0]
    ways = [np.tile(np.arange(4), (4, 1))]  # states after each piece so far, by (before, after)
    back = []
    for i in range(1, n):
        through = np.minimum(total[:, :, None] + cost[i][None], NONE)  # before, middle, after
        key = through * 4 + order[:, :, None]
        middle = key.argmin(1)
        new = np.take_along_axis(through, middle[:, None], 1)[:, 0]
        place = np.take_along_axis(order, middle, 1) * 4 + rank[i][middle, np.arange(4)]
        order = place.argsort(1, kind="stable").argsort(1, kind="stable")
        back.append(middle)
        total = new
    states = np.zeros((n, 4, 4), np.int64)
    states[-1] = np.arange(4)[None]
    for i in range(n - 2, -1, -1):  # what lies before a middle state is on the best way to it
        states[i] = np.take_along_axis(back[i], states[i + 1], 1)
    return total, order, states


def folded(pieces: DataFrame, by: list[str], order: str) -> DataFrame:
    """Neighbouring pieces of each group as one: ``by``, cost, rank, first, last, illegal, and per piece its place and the states after it."""
    names = pieces.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        shape = (len(rows), 4, 4)
        cost, rank = np.stack(rows["cost"]).reshape(shape), np.stack(rows["rank"]).reshape(shape)
        total, ranked, states = combine(cost, rank)
        first, last = rows["first"].tolist(), rows["last"].tolist()
        meets = sum(a + b not in ("su", "ua", "au") for a, b in zip(last, first[1:]))
        one = {k: [rows[k].iloc[0]] for k in by}
        one |= {"cost": [total.ravel()], "rank": [ranked.ravel()], "first": [first[0]], "last": [last[-1]], "illegal": [int(rows["illegal"].sum()) + meets]}
        return pd.DataFrame(one | {"places": [rows[order].to_numpy()], "states": [states.reshape(len(rows), 16).tolist()]})

    keys = ", ".join(f"{k} {names[k].dataType.simpleString()}" for k in by)
    return pieces.groupBy(*by).applyInPandas(run, f"{keys}, cost array<long>, rank array<int>, first string, last string, illegal long, places array<long>, states array<array<long>>")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copy``: rows after the damage that their number decides; nulls are one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))), F.lit(20))
    role, text = F.when(F.col("kind") == 4, "user").otherwise(known("role")), known("text")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``place``, which grows along conversations and their turns, and the digest of role and text; written once.

    Its upper bits number the partition, so the rows of one conversation and partition are neighbours in the lower bits.
    """
    content = F.sha2(F.to_json(F.struct("role", "text")), 256)
    rows = rows.withColumn("content", content).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "content", "copy", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.select("conv_id", "turn", "role", "text", "content", F.monotonically_increasing_id().alias("place")), "placed")


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` (blank, duplicate, truncated or null) and ``kind``, the row's character in a signature."""
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    more = rows.where(~blank).groupBy(F.col("conv_id").alias("c"), F.col("content").alias("x")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    more = broadcast_if_small(materialize(more.drop("n"), "repeated"))
    rows = rows.join(more, _same("conv_id", "c") & (F.col("content") == F.col("x")), "left")
    fault = F.when(blank, "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    rows = rows.withColumn("fault", fault).withColumn("initial", role).drop("c", "x", "first", "content")
    must = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    return rows.withColumn("kind", F.when(must, "d").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Null roles and texts are one space; a null turn comes first and does not count
    for gaps; a null conv_id is a conversation.  Rows of one turn are in the order
    of role and of their content's digest; equal rows are copies, of which the first
    is none.  A conversation of which no row is left has zeros, an empty audit and
    the digest of nothing.  An empty table gives an empty result, further columns
    are ignored.  A conversation of any length is cut into signatures of bounded
    length; its audit is one value, and its digest is taken in one task, row by row.
    """
    key = conversations.schema["conv_id"].dataType.simpleString()
    rows = materialize(faults(placed(damaged(conversations))), "faulty")
    part, chunk = F.shiftright("place", 33).alias("part"), F.shiftright("place", CHUNK_BITS).alias("chunk")

    # signatures of chunks; a chunk's rows are neighbours
    listed = F.sort_array(F.collect_list(F.struct("place", "kind", "initial")))
    chunks = rows.groupBy("conv_id", part, chunk).agg(listed.alias("l"), F.min("place").alias("start"))
    joined = lambda c: F.array_join(F.transform("l", lambda x: x[c]), "")
    roles = F.col("roles")
    meets = F.size(F.filter(F.sequence(F.lit(1), F.length(roles)), lambda i: (i < F.length(roles)) & ~F.substring(roles, i, F.lit(2)).isin("su", "ua", "au")))
    chunks = chunks.select("conv_id", "part", "chunk", "start", joined("kind").alias("signature"), joined("initial").alias("roles")).select(
        "conv_id", "part", "chunk", "start", "signature", F.substring(roles, 1, 1).alias("first"), F.substring(roles, -1, 1).alias("last"), meets.cast("long").alias("illegal")
    )
    chunks = materialize(chunks, "chunks")
    answers = materialize(solved(in_bounded_batches(chunks.select("signature").distinct())), "solved")
    size = answers.agg(F.sum(F.length("signature"))).first()[0] or 0
    if size <= 1 << 20:  # a signature's 16 ways take some thirty times its length
        answers = F.broadcast(answers)
    pieces = materialize(chunks.join(answers, "signature"), "pieces")

    # long conversations: chunks of a partition, then partitions of a conversation, as one
    once = materialize(pieces.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n_chunks")), "chunk-counts")
    long = pieces.join(broadcast_if_small(once.where("n_chunks > 1")), _same("conv_id", "c"), "left_semi")
    inside = materialize(folded(long.drop("edits", "signature", "start"), ["conv_id", "part"], "chunk"), "folded-parts")
    whole = materialize(folded(inside.drop("places", "states"), ["conv_id"], "part"), "folded-whole")

    # the last state of each conversation, and from it the states around every chunk
    alone = pieces.join(broadcast_if_small(once.where("n_chunks = 1")), _same("conv_id", "c"), "left_semi") if not whole.isEmpty() else pieces
    ends = F.array(*[F.struct((F.col("cost")[b] + TAIL[b][0]).alias("cost"), F.col("rank")[b].alias("rank"), F.lit(b).alias("state")) for b in range(4)])
    chosen = F.array_min(ends)
    tail = lambda state: F.element_at(F.array(*[F.lit(TAIL[b][1]) for b in range(4)]), state + 1)
    top = alone.select("conv_id", "illegal", chosen.alias("e")).unionByName(whole.select("conv_id", "illegal", chosen.alias("e")))
    top = materialize(top.select("conv_id", "illegal", "e.cost", F.col("e.state").alias("final")), "ends")

    def opened(level: DataFrame, before: Column, after: Column) -> DataFrame:
        """For each piece of a folded group entered in state ``before`` and left in ``after``: its place and its own two states."""
        way = F.transform("states", lambda s: F.get(s, (4 * before + after).cast("int")))
        pairs = F.arrays_zip(F.col("places").alias("place"), way.alias("out"), F.concat(F.array(before.cast("long")), F.slice(way, 1, F.size(way) - 1)).alias("in"))
        return level.select(*[c for c in ("conv_id", "part") if c in level.columns], F.inline(pairs))

    last = broadcast_if_small(top.select(F.col("conv_id").alias("c"), "final"))
    parts = opened(whole.join(last, _same("conv_id", "c")), F.lit(0), F.col("final")).select(F.col("conv_id").alias("c"), F.col("place").alias("p"), "in", "out")
    spread = opened(inside.join(parts, _same("conv_id", "c") & (F.col("part") == F.col("p"))), F.col("in"), F.col("out"))
    states = spread.select(F.col("conv_id").alias("c"), F.col("place").alias("k"), "in", "out")
    ways = alone.join(last, _same("conv_id", "c")).select("conv_id", "chunk", "start", F.col("edits")[F.col("final")].alias("codes"))
    ways = ways.unionByName(long.join(states, _same("conv_id", "c") & (F.col("chunk") == F.col("k"))).select("conv_id", "chunk", "start", F.col("edits")[(4 * F.col("in") + F.col("out")).cast("int")].alias("codes")))
    ways = materialize(ways, "ways")

    # replay
    own = F.element_at(F.split("codes", ","), (F.col("place") - F.col("start") + 1).cast("int"))
    steps = rows.join(ways.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "start", "codes"), _same("conv_id", "c") & (F.shiftright("place", CHUNK_BITS) == F.col("k")))
    steps = steps.select("conv_id", "place", own.alias("code"), F.col("role").alias("own_role"), "text")
    tails = top.where("final IN (1, 2)").select("conv_id", F.lit((1 << 63) - 1).alias("place"), tail(F.col("final")).alias("code"), F.lit("").alias("own_role"), F.lit("").alias("text"))
    said = F.concat(F.lit(":"), F.col("text"))
    line = lambda x: F.when(x == "u", "user:").when(x == "a", "assistant:").when(x == "U", F.concat(F.lit("user"), said)).when(x == "A", F.concat(F.lit("assistant"), said)).when(x == "K", F.concat("own_role", said))
    lines = F.filter(F.transform(F.split("code", ""), line), lambda x: x.isNotNull())
    lines = steps.unionByName(tails).select("conv_id", "place", F.array_join(lines, "\n").alias("lines"), F.size(lines).alias("n")).where("n > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, ids, out = None, None, [], []
        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        ids.append(now)
                        out.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out, pa.string())], ["c", "repaired_sha256"])
                ids, out = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], ["c", "repaired_sha256"])

    ordered = in_bounded_batches(lines.select("conv_id", "place", "lines")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    digests = ordered.mapInArrow(run, f"c {key}, repaired_sha256 string")

    # conversation by conversation
    of = lambda f: F.count_if(F.col("fault") == f).alias(f)
    turns = rows.groupBy("conv_id", "turn").agg(of("blank"), of("duplicate"), of("truncated"))
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")]
    ).withColumnRenamed("conv_id", "c")
    letters = F.translate("codes", "UAua,", "RRII")
    audits = ways.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", letters.alias("x")))), lambda p: p["x"]), "").alias("audit"))
    audits = audits.withColumnRenamed("conv_id", "c")
    ended = top.select(F.col("conv_id").alias("c"), "illegal", "cost", F.repeat(F.lit("I"), F.length(tail(F.col("final")))).alias("tail"))
    out = conversations.select("conv_id").distinct()
    for table in (counts, audits, ended, digests):
        out = out.join(table, _same("conv_id", "c"), "left").drop("c")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zero, F.coalesce(F.concat("audit", "tail"), F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
