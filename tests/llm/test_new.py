"""Vector codes, token counts and conversation repair against SQL and brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from longspan.llm import conversations, token_counts, vector_codes

from tests.llm.fixtures import clashing, empty_docs, odd_docs, odd_rows

ROLE = {"u": "user", "a": "assistant"}


def brute_repair(rows):
    """By the contract, with the whole list of cheapest edits of each prefix (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n, seen, faults = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            if fault:
                n[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        # best (cost, audit, lines) of every state, where a state is the initials said so far shortened to what matters
        best = {"": (0, "", [])}

        def inserted(best):
            for _ in range(3):
                for state, (cost, audit, lines) in list(best.items()):
                    said = "a" if state == "u" else "u"
                    new = (cost + 3, audit + "I", [*lines, ROLE[said] + ":"])
                    best[said] = min(best.get(said, new), new)
            return best

        for (_, role, text), fault in zip(mine, faults):
            new = {}

            def put(state, *way):
                new[state] = min(new.get(state, way), way)

            for state, (cost, audit, lines) in inserted(best).items():
                put(state, cost + 4, audit + "D", lines)
                if fault in ("blank", "duplicate"):
                    continue
                late = 3 * (fault == "truncated")
                said = "a" if state == "u" else "u"
                put(said, cost + 3 + late, audit + "R", [*lines, f"{ROLE[said]}:{text}"])
                if role[:1] == said or (role[:1] == "s" and state == ""):
                    put(role[0], cost + late, audit + "K", [*lines, f"{role}:{text}"])
            best = new
        cost, audit, lines = min(v for k, v in inserted(best).items() if k in ("", "a"))
        out[conv] = (gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversations.repair(clashing(df)).collect()}


def random_rows(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] if rng.random() < 0.5 else ["system", "user", "assistant", "tool", "", "Ümlaut", None])
            text = rng.choice(["Yes.", "no", " \t", "", None, f"word {turn}!", f"word {turn}", "Ende? \n", "ünï 🙂.", "a "])
            rows.append((conv if conv else None, turn + rng.randint(0, 1) * 50 if rng.random() < 0.97 else None, role, text))
    seen, out = set(), []
    for r in rows:  # the order of different rows of one turn is ours to state
        if (r[0], r[1]) not in seen:
            out.append(r)
        seen.add((r[0], r[1]))
    return out


def test_repair_equals_brute_force(spark, sf_dir):
    rows = random_rows(1, 150, 9)
    assert repaired(spark, rows) == brute_repair(rows)
    whole = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(spark, whole) == brute_repair(whole)


def test_repair_over_many_signatures(spark, monkeypatch):
    """Conversations that are cut into several chunks and partitions."""
    monkeypatch.setattr(conversations, "CHUNK_BITS", 2)
    rows = random_rows(2, 12, 60) + [(99, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 7}.") for t in range(700)]
    assert repaired(spark, rows) == brute_repair(rows)


def test_repair_odd_cases(spark):
    assert repaired(spark, [(1, 1, "user", "a.")] * 3 + [(1, 2, "assistant", "b.")]) == brute_repair([(1, 1, "user", "a.")] * 3 + [(1, 2, "assistant", "b.")])
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "a.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(spark, []) == {}
    long = [(5, 0, "user", "x " * 400_000 + "."), (5, 1, "assistant", "y")]
    assert repaired(spark, long) == brute_repair(long)


def test_signature_of_any_length():
    signature = "".join(random.Random(3).choice("suaxSUAXd") for _ in range(3000))
    cost, rank, codes = conversations.solve(signature)
    assert len(codes[3].split(",")) == 3000 and cost[3] < 4 * 3000 + 7


def brute_codes(vectors, entries=64, rounds=2, parts=16):
    x = np.floor(np.array(vectors, np.float64) * 256).astype(np.int64).reshape(len(vectors), parts, -1)
    books = x[:entries].swapaxes(0, 1).copy()
    near = lambda: [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
    for _ in range(rounds):
        best = [d.argmin(1) for d in near()]
        for p in range(parts):
            for e in range(len(books[p])):
                if (best[p] == e).any():
                    books[p][e] = x[best[p] == e, p].sum(0) // (best[p] == e).sum()
    d = near()
    best = [y.argmin(1) for y in d]
    return ["".join(f"{best[p][i]:02x}" for p in range(parts)) for i in range(len(x))], sum(y.min(1) for y in d).tolist(), books


def test_tree_equals_brute_force_with_ties():
    rng = np.random.default_rng(1)
    for size, width, high in ((1, 3, 5), (64, 4, 3), (64, 4, 200), (50, 1, 4), (64, 4, 1)):
        entries, queries = rng.integers(-high, high + 1, (size, width)), rng.integers(-high, high + 1, (500, width))
        index, distance = vector_codes.Tree(entries).nearest(queries)
        want = ((queries[:, None] - entries[None]) ** 2).sum(2)
        assert (index == want.argmin(1)).all() and (distance == want.min(1)).all()


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_odd_cases(spark):
    rng = np.random.default_rng(2)
    good = [(i * 3, [round(float(v), 2) for v in rng.normal(0, 1, 32)], (None, 1, 2)[i % 3]) for i in range(200)]
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (4, [], 1), (7, [nan] + [0.0] * 31, 1), (10, [None] + [0.0] * 31, 1), (13, [0.0] * 31 + [-inf], 2), (None, None, None), (16, [1e30] * 32, 2), (19, [0.5] * 16, 2)]
    got = {r["vec_id"]: r for r in vector_codes.compress(clashing(spark.createDataFrame(good + bad, VECTORS))).collect()}
    codes, errors, books = brute_codes([v for _, v, _ in good])
    assert {k: (r["code"], r["error"]) for k, r in got.items()} == {g[0]: (c, e) for g, c, e in zip(good, codes, errors)}
    assert {r["codebooks_sha256"] for r in got.values()} == {vector_codes.digest(books)}
    for label in (None, 1, 2):
        assert {got[g[0]]["label_error"] for g in good if g[2] == label} == {sum(e for g, e in zip(good, errors) if g[2] == label)}
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    few = vector_codes.compress(spark.createDataFrame([(1, [0.1] * 20, 1), (1, [0.1] * 20, 1), (None, [0.3] * 20, None)], VECTORS)).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"]) for r in few) == [(0, "02" * 10 + "00" * 6, 0), (1, "00" * 16, 0), (1, "00" * 16, 0)]


def library_count(text):
    tokenizer = token_counts.lengths(token_counts.default_path()).tokenizer
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_token_counts_equal_the_library(spark, monkeypatch, block):
    rng = random.Random(5)
    signs = [*"abC.,!?:;aΣς's 1²½٣ \t\n\x0b\x0c\r\x85 　​́̈ͅᅡ가é🙂", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'re", "'LL", "İ", "ﬁ", "Å"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["a" * 70_000, "1" * 3000 + ". " + "é" * 3000, "x y. " * 40_000, "<|endoftext|>" * 300]
    table = token_counts.Lengths(token_counts.default_path())
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", block)
    total = [0] * len(texts)
    for part in token_counts.blocks([memoryview(t.encode()) for t in texts]):
        table.count(part, total)
    assert total == [library_count(t) for t in texts]


def test_token_counts_odd_cases(spark):
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(clashing(odd_docs(spark))).collect()]
    want = [(r[0], len((r[1] or "").encode()), n := library_count(r[1]), n > 2048) for r in odd_rows()]
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert token_counts.token_counts(empty_docs(spark)).count() == 0


def test_one_doc_id_on_many_rows_is_bounded(spark):
    """Samples that come to the driver, and the partitions of a mix, do not follow the rows of one doc_id."""
    from longspan.llm import langid, mixing, toxicity
    from pyspark.sql import functions as F

    docs = spark.range(0, 100_000, 1, 8).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id") % 50_000).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    assert 100 < len(langid.training_sample(docs, F.lit(True), 200)) <= 600
    labels = spark.createDataFrame([(5, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, labels, train_rows=50) is not None
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in mixing.mix(docs).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)
