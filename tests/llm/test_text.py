"""Tokens, media, language, toxicity and language-model scores against brute force and round trips."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from longspan.llm import bpe, langid, lm_score, toxicity, webp
from longspan.llm.shared import SpanHash, text_bytes, word_spans
from pyspark.sql import functions as F

from tests.llm.fixtures import clashing, empty_docs, ids, odd_docs, odd_rows

RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BITS = ["'", "s", "t", "re", "ve", "m", "ll", "d", "r", "l", "v", "e", " ", "  ", "\n", "\t", "a", "Z", "1", "²", "é", "!", " ", "　", "\x1c", "\x85", "中", "😀", "'s", " '", "́", "…"]


def batch(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(b) for b in raw])


def encode(texts):
    code = bpe.codec(bpe.default_path())
    data, offsets = batch(texts)
    tokens, place, first = code.encode(data, offsets)
    back, at = code.decode(tokens, place, first)
    assert back.tobytes() == data.tobytes() and (at == offsets).all()
    return [tokens[a:b].tolist() for a, b in zip(first, first[1:])]


@given(st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), max_size=6))
@settings(max_examples=300, deadline=None)
def test_tokens_of_tricky_texts(texts):
    assert encode(texts) == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_tokens_of_every_code_point():
    texts = [f"a{c}1 {c} {c}b" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000][::7]
    for i in range(0, len(texts), 20000):
        part = texts[i : i + 20000]
        assert encode(part) == [TIKTOKEN.encode_ordinary(t) for t in part]


def test_long_pieces():
    texts = ["a" * 5000, "!" * 3000 + " " * 700, "ab" * 2000, ""]
    assert encode(texts) == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_token_digests_of_odd_rows(spark):
    want = []
    for d, t, *_ in odd_rows():
        x = TIKTOKEN.encode_ordinary(t or "")
        want.append((d, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    want.sort(key=lambda r: tuple((x is not None, x) for x in r))
    assert ids(bpe.digest(clashing(odd_docs(spark))), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.digest(empty_docs(spark)).count() == 0
    back = bpe.decode(bpe.encode(odd_docs(spark)))
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in odd_rows())


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    rng = random.Random(1)
    for _ in range(5):
        t = ["".join(rng.choice(BITS) for _ in range(40))]
        assert encode(t) == [TIKTOKEN.encode_ordinary(t[0])]


# ------------------------------------------------------------------ media


def test_known_files():
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[0]]
    assert webp.decode(base64.b64decode("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=")).tolist() == [[0xFFFFFFFF]]
    for bad in (b"", b"RIFF", b"x" * 40, webp.encode_samples(np.zeros(576, np.uint8), 576)[:22]):
        with pytest.raises(webp.FormatError):
            webp.decode(bad)


@pytest.mark.parametrize("seed", range(24))
def test_transforms_and_cache(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 20, 2)
    colours = rng.integers(0, 1 << 32, 5, dtype=np.uint64).astype(np.uint32)
    pixels = rng.choice(colours, (h, w)) if seed % 2 else rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)
    transforms = tuple(rng.permutation(3)[: rng.integers(0, 4)].tolist())
    media = webp.encode_pixels(pixels, transforms, int(rng.integers(2, 5)), (), int(rng.integers(0, 7)), seed)
    assert (webp.decode(media) == pixels).all()


def test_every_distance_code():
    rng = np.random.default_rng(5)
    flat = np.tile(rng.integers(0, 1 << 32, 7, dtype=np.uint64).astype(np.uint32), 30)
    near = [(c, max(1, dx + dy * 21)) for c, (dx, dy) in enumerate(webp.near_offsets(), 1)]
    assert len(near) == 120
    for code, d in near + [(120 + d, d) for d in (1, 5, 100)]:
        if d < 100 or code > 120:
            image = flat.copy()
            for i in range(110, 160):
                image[i] = image[i - d]
            for cache in (0, 4):
                assert (webp.decode(webp.encode_pixels(image.reshape(10, 21), (), 2, [(110, 50, code)], cache)).reshape(-1) == image).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 16, 17, 60, 256])
def test_palettes_of_every_width(n):
    s = np.random.default_rng(n).integers(0, n, 576 * 3).astype(np.uint8)
    s[-300:] = s[-1]
    assert ((webp.decode(webp.encode_samples(s, 576)) >> 8 & 255).reshape(-1) == s).all()


def test_code_lengths_are_bounded():
    counts = np.array([int(1.7**i) + 1 for i in range(40)])
    lengths = webp.code_lengths(counts)
    assert lengths.max() <= 15 and sum(2.0 ** -int(x) for x in lengths) == 1


def test_media_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in webp.digest(clashing(odd_docs(spark))).collect()}
    for d, t, *_ in odd_rows():
        if d is None or d == 13:
            continue
        raw = (t or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert got[1]["media_sha256"] == got[2]["media_sha256"] and got[1]["feature"] == got[2]["feature"]
    assert webp.digest(empty_docs(spark)).count() == 0
    files = webp.store(odd_docs(spark)).where("doc_id = 1").collect()
    assert (webp.decode(bytes(files[0]["media"])) >> 8 & 255).astype(np.uint8).tobytes().startswith(odd_rows()[0][1].encode())


def test_long_payload_is_several_images(spark):
    """One byte beyond an image needs one more row of the next one, not wider rows."""
    rng = np.random.default_rng(5)
    raw = rng.choice(np.frombuffer(b"abc ", np.uint8), webp.IMAGE + 1).tobytes()
    r = webp.digest(spark.createDataFrame([(1, raw.decode())], "doc_id long, text string")).first()
    padded = raw + b"\xff" * 575
    assert (r["n_bytes"], r["payload_bytes"]) == (9_437_185, 9_437_760) and r["feature"].startswith("576x16385 ")
    assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 1151, 1152, 1153, 1728, 3000])
def test_payloads_around_the_limit_of_an_image(monkeypatch, size):
    monkeypatch.setattr(webp, "IMAGE", 2 * webp.ROW)
    raw = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
    samples, width, height = webp.unpack(webp.pack(raw))
    rows = max(1, -(-size // 576))
    assert (width, height) == (576, rows) and samples.tobytes() == raw.tobytes() + b"\xff" * (rows * 576 - size)
    for broken in (webp.pack(raw)[:-1], webp.pack(raw) + b"RIFF", webp.pack(raw) + webp.encode_samples(samples[:64], 32)):
        with pytest.raises(webp.FormatError):
            webp.unpack(broken)


def test_damaged_media_is_null(spark):
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert [r["feature"] for r in webp.read(df).collect()] == [None, None]


# ------------------------------------------------------------------ classifiers and scores


def test_language_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    odd = {r["doc_id"]: r for r in langid.identify(clashing(odd_docs(spark))).collect()}
    assert {odd[i]["lang_pred"] for i in (5, 6, 7, 15)} == {"und"} and odd[10]["lang_pred"] in ("en", "fr", "de", "es")
    assert len(langid.identify(odd_docs(spark)).collect()) == len(odd_rows()) and langid.identify(empty_docs(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}


def brute_language(net, raw):
    """Likeliest language and its probability: every filter at every place of every window, one at a time."""
    total = np.zeros(len(net.classes))
    for at in range(0, len(raw), langid.WINDOW):
        part = raw[at : at + langid.WINDOW]
        window = part + bytes(langid.WINDOW - len(part))
        hidden = []
        for table in net.tables:
            w = len(table)
            sums = [sum(table[k, window[p + k]].astype(float) for k in range(w)) for p in range(langid.WINDOW - w + 1)]
            hidden += np.maximum(np.max(sums, axis=0), 0).tolist()
        z = np.array(hidden) @ net.weights.astype(float) + net.bias
        p = np.exp(z - z.max())
        total += p / p.sum() * len(part) / len(raw)
    best = int(total.argmax())
    return net.classes[best], float(total[best])


def test_language_equals_brute_force(spark):
    docs = odd_docs(spark)
    net = langid.fit(langid.training_sample(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 != 2))
    texts = dict((d, t) for d, t, *_ in odd_rows() if d is not None and d != 13)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).where("doc_id IS NOT NULL AND doc_id <> 13").collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        lang, score = brute_language(net, t.encode()) if re.search(r"[^\W\d_]", t or "") else ("und", 0.0)
        assert got[d][0] == lang and abs(got[d][1] - score) < 1e-4, d


def test_window_cutting_keeps_every_byte():
    data, offsets = batch(["", "a" * 256, "b" * 600, "ü"])
    windows, row, used = langid.windows_of(data, offsets)
    assert row.tolist() == [1, 2, 2, 2, 3] and used.tolist() == [256, 256, 256, 88, 2]
    assert b"".join(w[:u].tobytes() for w, u in zip(windows, used)) == data.tobytes()


def test_threshold_weighs_rows_back_to_the_table():
    y = np.arange(400) < 200
    marked = np.flatnonzero(np.arange(400) < 210)  # all with the category, and ten without
    row, feature = np.concatenate([np.arange(400), marked]), np.concatenate([np.full(400, 5), np.full(210, 7)])
    fit = lambda w: toxicity.fit_chain(["a"], row, feature, y[:, None], np.arange(400), w).threshold
    assert fit(None) < 1 and fit(np.ones(400)) == fit(None)  # 200 of 210 are right
    assert fit(np.where(y, 1.0, 20.0)) > 1  # 200 of 400 are


def test_toxic_words_are_found(spark):
    rng = random.Random(8)
    from tests.llm.fixtures import text

    rows, labels = [], []
    for i in range(500):
        bad = i % 3 == 0
        t = text(rng, 6)
        if bad:
            words = t.split()
            words.insert(rng.randrange(len(words)), rng.choice(["idiot,", "Moron", "scum!"]))
            t = " ".join(words)
        rows.append((i, t))
        if i < 400:
            labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["rejected"] for r in toxicity.toxicity(docs, lab).collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(400, 500))
    odd = toxicity.toxicity(clashing(odd_docs(spark)), lab).collect()
    assert len(odd) == len(odd_rows()) and not any(r["rejected"] for r in odd)
    assert toxicity.toxicity(empty_docs(spark), lab).count() == 0
    assert not any(r["rejected"] for r in toxicity.toxicity(docs, lab.limit(0)).collect())


def brute_chain(chain, text):
    """Probabilities of the chain's categories, feature by feature from a pattern's runs."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())

    def hashed(token, kind):
        data = np.frombuffer(token, np.uint8)
        return int(SpanHash(data)(np.array([0]), np.array([len(token)]), kind)[0] >> np.uint64(64 - toxicity.BITS))

    found = set()
    for run in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff \t\n\x0b\x0c\r]+", raw):
        found.add(hashed(run, 1))
        found |= {hashed(run[:n], 2) for n in toxicity.PREFIXES if len(run) > n}
    out = []
    for model in chain.models:
        z = sum(w for f, w in zip(model.chosen.tolist(), model.weights) if f in found) + float(np.dot(out, model.earlier)) + model.bias
        out.append(1 / (1 + math.exp(-min(40, max(-40, z)))))
    return out


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(18)
    from tests.llm.fixtures import text

    rows = [(i, text(rng, 5) + (" Idiot! scum??" if i % 3 == 0 else "") + (" kaban12 @@" if i % 5 == 0 else "")) for i in range(1000, 1240)]
    rows += [(d, t) for d, t, *_ in odd_rows() if d is not None and d != 13]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 3 == 0)) for i in range(1000, 1200)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.learn(docs, labels)
    assert len(chain.models) == 2 and all(len(m.chosen) for m in chain.models) and chain.threshold < 1
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for d, t in rows:
        want = brute_chain(chain, t)
        assert all(abs(got[d][f"p_{c}"] - p) < 1e-5 for c, p in zip(("low_quality", "toxic"), want)), d
        assert got[d]["rejected"] == (bool(t) and want[-1] >= chain.threshold), d
    assert sum(r["rejected"] for r in got.values()) == 80


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    y0 = rng.random(300) < 0.5
    y = np.column_stack([y0, y0])
    row = np.repeat(np.arange(300), 2)
    feature = np.where(np.tile([True, False], 300), np.repeat(np.where(y0, 5, 6), 2), rng.integers(10, 400, 600))
    chain = toxicity.fit_chain(["a", "b"], row, feature, y, np.arange(300))
    assert len(chain.models[1].earlier) == 1 and chain.models[1].earlier[0] > 0
    assert ((chain.out_of_fold[:, 1] > chain.threshold) == y0).mean() > 0.98


def brute_base(rows):
    tok = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for d, t in rows]
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    c = Counter(x for d, t in tok if crc(d) != 2 for x in t)
    n, v = sum(c.values()), len(c)
    return [(d, crc(d) == 2, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for d, t in tok]


def test_base_scores_of_odd_rows(spark):
    got = lm_score.lm_score(clashing(odd_docs(spark))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    want = sorted(brute_base([(r[0], r[1]) for r in odd_rows()]), key=key)
    have = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], key=key)
    assert [r[:5] for r in want] == [r[:5] for r in have] and np.allclose([r[5] for r in want], [r[5] for r in have])
    assert all(r["score"] < 0 for r in got)
    assert lm_score.lm_score(empty_docs(spark)).count() == 0


def test_rare_words_join_gives_the_same(spark, monkeypatch):
    docs = odd_docs(spark)
    want = ids(lm_score.lm_score(docs), "doc_id", "n_known", "n_tokens")
    base = sorted(r["base_score"] for r in lm_score.lm_score(docs).collect())
    monkeypatch.setattr(lm_score, "COMMON", 10)
    out = lm_score.lm_score(docs)
    assert ids(out, "doc_id", "n_known", "n_tokens") == want and np.allclose(sorted(r["base_score"] for r in out.collect()), base)


def test_model_beats_the_base_on_held_out_texts(spark):
    out = lm_score.lm_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_state_is_carried_over_windows():
    net, rng = lm_score.Gru(), np.random.default_rng(0)
    ids_ = rng.integers(2, 900, 300)
    ids_[-1] = 1
    whole = lm_score.score_block(net, ids_, np.array([0, 300]))
    state, logs = np.zeros((1, lm_score.HIDDEN), np.float32), []
    for t in range(300):
        states = net.run(np.array([[ids_[t - 1] if t else 1]]), state)
        state = states[-1]
        logs.append(net.outputs(states[0], ids_[t : t + 1])[0][0] / np.log(10))
    assert np.allclose(whole, logs, atol=1e-4)
    two = lm_score.score_block(net, np.concatenate([ids_, ids_]), np.array([0, 300, 600]))
    assert np.allclose(two[:300], two[300:], atol=1e-4)


def test_probabilities_sum_to_one():
    net = lm_score.Gru()
    hidden = np.random.default_rng(1).normal(size=(1, lm_score.HIDDEN)).astype(np.float32)
    n = lm_score.CLASSES * lm_score.PER_CLASS
    logs, _ = net.outputs(np.repeat(hidden, n, axis=0), np.arange(n))
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_gradient_of_the_network():
    net, rng = lm_score.Gru(), np.random.default_rng(2)
    net.p = [a.astype(np.float64) for a in net.p]
    x, y = rng.integers(2, 40, (4, 3)), rng.integers(2, 40, 12)

    def loss():
        return -net.outputs(net.run(x, np.zeros((3, lm_score.HIDDEN))).reshape(-1, lm_score.HIDDEN).astype(np.float64), y)[0].mean()

    before = [a.copy() for a in net.p]
    net.m, net.v = [np.zeros_like(a) for a in net.p], [np.zeros_like(a) for a in net.p]
    _, first = net.learn(x, y.reshape(4, 3), np.ones((4, 3), bool), np.zeros((3, lm_score.HIDDEN)), 1e-3)
    moved = [m / 0.1 for m in net.m]  # the gradient, scaled to norm one at most
    net.p = [a.copy() for a in before]
    scale = None
    for k, at in ((1, (3, 5)), (1, (7, 2 * lm_score.HIDDEN + 6)), (2, (1, 0)), (0, (int(x[0, 0]), lm_score.HIDDEN + 8))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        slope = (up - down) / 2e-2
        if abs(slope) > 1e-4:
            ratio = moved[k][at] / slope
            scale = scale or ratio
            assert abs(ratio / scale - 1) < 0.2
    assert abs(first - loss()) < 1e-3


def test_span_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"hello world hello", np.uint8)
    h = SpanHash(data)(np.array([0, 12, 6]), np.array([5, 17, 11]))
    assert h[0] == h[1] != h[2]
    starts, ends, first = word_spans(*batch(["a b", "", "c\td e "]))
    assert first.tolist() == [0, 2, 2, 4] and len(starts) == len(ends) == 4


def test_second_fit_learns_first_words_and_ends(spark):
    rows = [(i, "opening " + " ".join(["kaban lodor mifil"] * 6) + " closing") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    table = lm_score.count_words(docs).orderBy(F.desc("n"), "word").toArrow()
    counts = lm_score.Counts(sum(table.column("n").to_pylist()), table.num_rows, table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy())
    counts.build()
    words, first = lm_score.tokens(*text_bytes(pa.array([rows[0][1]])))
    token_ids = counts.look_up(words)[0]
    before, after = (lm_score.score_block(net, token_ids, first) for net in (lm_score.Gru(), lm_score.spread_fit(docs, counts, lm_score.Gru())))
    assert all(after[i] > before[i] + 0.2 for i in (0, -2, -1)), (before, after)
