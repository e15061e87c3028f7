"""Near-dedup, line dedup and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from longspan.llm import line_dedup, near_dedup
from longspan.llm.shared import text_bytes

from tests.llm.fixtures import clashing, empty_docs, ids, odd_docs, odd_rows, text


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(rows, percent=75):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posted = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is None:
            continue
        shared = Counter(j for x in s for j in posted[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            posted[x].append(i)
    out = [(d, len(s), find(d) if d is not None else None, d is None or d == find(d)) for d, s in sets]
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


def near(df, **settings):
    return ids(near_dedup.near_dedup(df, near_dedup.Settings(**settings)), "doc_id", "n_shingles", "component_id", "kept")


def test_near_dedup_odd_cases(spark):
    assert near(clashing(odd_docs(spark))) == brute_near([(r[0], r[1]) for r in odd_rows()])
    assert near_dedup.near_dedup(empty_docs(spark)).count() == 0


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = rng.choice(["zub", "zal", "zen", "zor"])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [48, 16])
def test_near_dedup_of_groups_near_the_limit(spark, k):
    rng = random.Random(11)
    base, other, passage = text(rng, 14), text(rng, 6), text(rng, 5)
    texts = copies(rng, base, 120, 9) + copies(rng, other, 60, 4) + [passage + " " + text(rng, rng.randrange(1, 9)) for _ in range(60)] + [text(rng, 1) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near(df, k=k) == brute_near(rows)


def test_texts_of_one_doc_id_link_each_for_itself(spark):
    rng = random.Random(8)
    a, b = text(rng, 12), text(rng, 12)
    rows = [(1, a), (1, b), (2, a + " kaban"), (3, b + " kaban"), (7, text(rng, 12)), (9, b), (9, text(rng, 12))]
    got = near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_near(rows) and {c for d, _, c, _ in got if d in (1, 2, 3, 9)} == {1}


def candidates(spark, monkeypatch, rows):
    """Pairs whose whole texts were compared, and the result."""
    pairs, compared = [], near_dedup.compared

    def counted(found, *args, **kwargs):
        found = near_dedup.materialize(found, "counted")
        pairs.append(found.count())
        return compared(found, *args, **kwargs)

    monkeypatch.setattr(near_dedup, "compared", counted)
    out = near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    monkeypatch.undo()
    return sum(pairs), out


def test_candidates_of_a_common_passage_grow_in_proportion(spark, monkeypatch):
    counts = []
    for n in (100, 200, 400):
        rng = random.Random(17)
        passage = text(rng, 8)
        rows = [(i, passage + " " + text(rng, 8)) for i in range(n)]
        number, got = candidates(spark, monkeypatch, rows)
        assert all(kept for *_, kept in got)
        counts.append(number)
    assert counts[2] <= 2.6 * counts[1] and counts[1] <= 2.6 * counts[0] and counts[2] <= 12 * 400


def test_large_clusters_that_share_a_passage(spark, monkeypatch):
    rng = random.Random(19)
    passage = text(rng, 8)
    texts = [t for _ in range(2) for t in copies(rng, passage + " " + text(rng, 9), 80, 2)]
    texts += [passage + " " + text(rng, 7) for _ in range(60)] + copies(rng, passage + " " + text(rng, 2), 80, 1)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    number, got = candidates(spark, monkeypatch, rows)
    assert got == brute_near(rows) and number <= 12 * len(rows)


def test_binomial_bound():
    s = near_dedup.Settings()
    assert s.need == 19 and near_dedup.Settings(k=64).need == 29


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(40, 50), (50, 60), (60, 40), (70, 70)]
    got = dict(ids(near_dedup.components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 60: 40}


def runs_of(texts, k):
    seen, repeated = {}, set()
    for d in sorted(texts):
        w = (texts[d] or "").split()
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if seen.setdefault(key, d) != d:
                repeated.add((seen[key], d))
    return repeated


def test_passages_go_and_nothing_is_lost(spark):
    rng = random.Random(21)
    passages = [text(rng, 9) for _ in range(6)]
    rows = {}
    for i in range(60):
        parts = [text(rng, rng.randrange(2, 6)) for _ in range(3)]
        if i % 2 == 0:
            parts.insert(rng.randrange(3), passages[rng.randrange(6)])
        rows[i] = rng.choice([" ", "\n"]).join(parts)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert not runs_of(got, 51)
    assert all(got[i] == rows[i] for i in range(1, 60, 2))  # documents without a passage stay as they are
    for p in passages:
        holders = [i for i in rows if p in rows[i]]
        if holders:
            assert p in got[holders[0]] and not any(p in got[i] for i in holders[1:])


def test_every_removed_line_is_kept_earlier(spark):
    rng = random.Random(5)
    base = text(rng, 30)
    rows = list(enumerate([base, *copies(rng, base, 12, 3), base, text(rng, 5) + "\n" + base]))
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = "\n".join(got[d] for d in sorted(got))
    for _, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        lines = line_dedup.Lines(raw, np.array([0, len(raw)]))
        assert all(t.encode()[a:b].decode() in whole for a, b in zip(lines.starts, lines.ends))
    assert got[0] == base and got[13].strip() == ""


def test_line_dedup_odd_cases(spark):
    docs = odd_docs(spark)
    got = line_dedup.line_dedup(clashing(docs)).collect()
    assert len(got) == len(odd_rows()) and all(r["value"] == "clash" for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] == odd_rows()[0][1] and by[2]["text"].strip() == "" and by[5]["text"] is None and by[10]["n_spans"] == 0
    assert by[8]["text"] == "Ein Wort" and by[2]["n_chars_removed"] > 0
    assert sorted(r["text"] for r in got if r["doc_id"] is None and r["text"]) == ["no id here"]
    assert line_dedup.line_dedup(empty_docs(spark)).count() == 0


def test_each_text_of_a_doc_id_is_cleaned(spark):
    rng = random.Random(6)
    a, b = text(rng, 12), text(rng, 12)
    rows = [(1, a), (1, b), (2, a + " kaban"), (3, b + " kaban"), (3, text(rng, 12))]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = {(r["doc_id"], r["text"]) for r in got}
    assert len(got) == 5 and {(1, a), (1, b), rows[4]} <= left and {(2, "kaban"), (3, "kaban")} <= {(d, t.strip()) for d, t in left}


def test_boundaries_survive_a_shift():
    import pyarrow as pa

    rng = random.Random(2)
    body = text(rng, 20)
    data, offsets = text_bytes(pa.array([body, "Shifted by this. " + body]))
    row, _, _, _, key, _ = line_dedup.Lines(data, offsets).chunks()
    first, second = set(key[row == 0].tolist()), set(key[row == 1].tolist())
    assert len(first & second) >= 0.7 * len(first)


def planted(rng, sizes):
    """Pairs of texts (2 i, 2 i + 1) that share a passage of so many words, which starts and stands anywhere."""
    rows = []
    for i, size in enumerate(sizes):
        source, at = text(rng, 12).split(), rng.randrange(16)
        for d in (2 * i, 2 * i + 1):
            around = text(rng, 8).split()
            place = rng.randrange(len(around))
            rows.append((d, " ".join(around[:place] + source[at : at + size] + around[place:])))
    return rows


def test_every_planted_passage_is_a_candidate(spark):
    rows = planted(random.Random(31), [n for n in range(51, 71) for _ in range(8)])
    found = line_dedup.regions(spark.createDataFrame(rows, "doc_id long, text string")).select("place", "first_place").collect()
    assert {(r["place"]["doc_id"], r["first_place"]["doc_id"]) for r in found} == {(d, d - 1) for d, _ in rows if d % 2}


@pytest.mark.parametrize("punctuation", [True, False])
def test_passages_at_any_word_go(spark, punctuation):
    rows = dict(planted(random.Random(32), [n for n in range(51, 71) for _ in range(8)]))
    if not punctuation:
        rows = {d: t.replace(".", "").lower() for d, t in rows.items()}
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert len(runs_of(rows, 51)) == 160 and not runs_of(got, 40)
    assert all(got[d] == rows[d] for d in rows if d % 2 == 0)  # first copies stay
    assert all(len(rows[d].split()) - len(got[d].split()) >= 25 for d in rows if d % 2)


# ------------------------------------------------------------------ the pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS
        rows = [(r["doc_id"], r["text"]) for r in out.collect()]
        given = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "near_dedup":
            want = [d for d, _, _, kept in brute_near(sorted(given.items())) if kept]
            assert sorted(d for d, _ in rows) == want
        if name in ("toxicity", "near_dedup", "mixing"):
            assert all(given[d] == t for d, t in rows)
        if name == "line_dedup":
            assert all(texts[d] == t or len(t) < len(texts[d]) for d, t in rows)
        docs = out
    tokens = corpus_pipeline.run(spark, sf_dir)
    assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    rows = tokens.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    final = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(final[r["doc_id"]].encode()).hexdigest()


def test_pipeline_odd_cases(spark, sf_dir):
    for docs in (odd_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()
