"""Exact dedup, mixing and URL filters against plain Python and SQL."""

import hashlib
import math
import random
import re
from itertools import combinations

import pytest
from longspan.llm import exact_dedup, mixing, queries, url_filter
from pyspark.sql import functions as F

from tests.compare import assert_same
from tests.llm.fixtures import clashing, empty_docs, ids, odd_docs, odd_rows

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


def brute_exact(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


@pytest.mark.parametrize("support", [0.5, 0.001])
def test_exact_dedup_odd_cases(spark, support):
    assert ids(exact_dedup.exact_dedup(clashing(odd_docs(spark)), support), *COLUMNS) == brute_exact(odd_rows())
    assert exact_dedup.exact_dedup(empty_docs(spark)).count() == 0


def test_mixing_odd_cases(spark):
    docs = clashing(odd_docs(spark))
    out = mixing.mix(docs).collect()
    by_id = {}
    for r in out:
        by_id.setdefault((r["doc_id"], r["text"]), []).append(r["copy_no"])
        assert r["n_copies"] >= 1 and r["value"] == "clash" and isinstance(r["copy_no"], int)
    for copies in by_id.values():
        assert sorted(set(copies)) == list(range(1, max(copies) + 1))
    assert mixing.mix(empty_docs(spark)).count() == 0
    assert {r["source"] for r in mixing.mix(docs, {"b": 1.0}, default_weight=0.0, total=50).collect()} == {"b"}


def test_mixing_meets_its_targets(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 40) END AS source", "'t' AS text")
    out = mixing.mix(docs, {"hot": 3.0}, 1.0).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    total = sum(n.values())
    assert abs(total - 20000) < 5 * math.sqrt(20000)
    want = 20000 * 3 / (len(n) + 2)
    assert abs(n["hot"] - want) < 5 * math.sqrt(want)


def test_large_rates_are_poisson(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'s' AS source", "'t' AS text")
    k = [r["n_copies"] for r in mixing.mix(docs, total=400 * 50).select("doc_id", "n_copies").distinct().collect()]
    mean = sum(k) / 400
    var = sum((x - mean) ** 2 for x in k) / 400
    assert abs(mean - 50) < 2 and 35 < var < 65


def test_many_sources_take_the_salted_way(spark, monkeypatch):
    docs = odd_docs(spark)
    want = ids(mixing.mix(docs), "shuffle_key", "doc_id")
    monkeypatch.setattr(mixing, "SOURCES_BROADCAST", 1)
    assert ids(mixing.mix(docs), "shuffle_key", "doc_id") == want


def brute_judge(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for r in url_filter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best.text if best else None, best.verdict if best else None


URLS = [
    None, "", "nothing", "http://ORG/", "http://a.org", "https://a.ORG/x", "http://example.org/es/1", "http://m.example.org/es", "http://x.example.org/en/12", "http://notexample.org/es/1", "http://é.com/fr/", "ftp://u.com/de/a?b#c",
    "http://u.com?x=/de/", "http://u.com#/de/", "//u.com/de/", "a://b://c.org/d", "http://xcom/de/", "http://com/de/\nnext", "http://ÀB.org/",
]


def test_urls_and_rules(spark):
    pages = clashing(spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, html string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_judge(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), u
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_block(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        host = "win.cheap-pills.net" if bad and i % 8 else f"site{i % 5}.net"
        part = "casino" if bad and i % 8 == 0 else "news"
        rows.append((i, f"http://{host}/{part}/{i}"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, "http://other.cheap-pills.net/a/7000"), (1001, "http://new.net/casino/7001"), (1002, "http://new.net/news/7002")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    lab = spark.createDataFrame(labels + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["verdict"], r["confidence"]) for r in url_filter.judge(pages, lab, min_support=0.01).collect()}
    assert len(got) == 403
    assert got[1000][0] == "block" and got[1001][0] == "block" and got[1002] == ("allow", None)
    assert all((got[i][0] == "block") == (i % 4 == 0) for i in range(400))
    # every match has all tokens of its rule, as a plain search over the rules finds
    index = [(r["classes"], r["confidence"]) for r in url_filter.mine(url_filter.labelled(pages, lab), min_support=0.01).collect()]
    for r in pages.select("page_id", url_filter.tokens(F.col("url")).alias("t")).collect():
        hits = [c for classes, c in index if all(set(r["t"]) & set(tokens) for tokens in classes)]
        assert (got[r["page_id"]][1] is None) == (not hits) and (not hits or abs(max(hits) - got[r["page_id"]][1]) < 1e-6)


def token_sets(spark, pages):
    return {r["page_id"]: frozenset(r["t"]) for r in pages.select("page_id", url_filter.tokens(F.col("url")).alias("t")).collect()}


def test_classes_match_as_single_tokens_do(spark):
    rng = random.Random(3)
    words = ["casino", "poker", "news", "sport", "deep", "wide", "odds"]
    rows = [(i, f"http://{rng.choice(['win.bet', 'a.site', 'b.site', 'c.page'])}.net/{'/'.join(rng.sample(words, rng.randint(1, 4)))}/{i}") for i in range(240)]
    labels = [(i, 0 if "casino" in u and ("odds" in u or "bet" in u) or i % 17 == 0 else 1, 0) for i, u in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r["confidence"] for r in url_filter.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), min_confidence=0.5).collect()}
    sets, bad = token_sets(spark, pages), {i for i, q, _ in labels if q == 0}
    # every set of tokens, counted by plain search
    found = {}
    for size in range(1, 8):
        for combination in {frozenset(c) for i in bad for c in combinations(sorted(sets[i]), size)}:
            on = [i for i in sets if combination <= sets[i]]
            k, m = sum(i in bad for i in on), len(on)
            share, z = k / m, 3.5
            low = (share + z * z / (2 * m) - z * math.sqrt(share * (1 - share) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            if k >= 5 and share >= 0.5 and share >= 1.5 * len(bad) / 240 and low > len(bad) / 240:
                found[combination] = share
    assert found
    for i, tokens in sets.items():
        best = max((c for items, c in found.items() if items <= tokens), default=None)
        assert (got[i] is None) == (best is None) and (best is None or abs(got[i] - best) < 1e-6), rows[i]


def test_deep_url_on_a_thousand_pages(spark):
    deep = "/".join("".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7)) for i in range(1, 31))
    rows = [(i, f"http://bad.net/{deep}/{i % 500}") for i in range(1000)] + [(2000 + i, f"http://good{i % 9}.net/x/{2000 + i}") for i in range(1500)]
    labels = [(i, 0, 0) for i in range(500)] + [(2000 + i, 1, 0) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r["page_id"] for r in got.collect() if r["verdict"] == "block"} == set(range(1000))


def test_rules_are_labels(spark):
    rows = [(i, f"http://{'x' if i % 2 else 'y'}.example.com/{'de' if i % 3 == 0 else 'fr'}/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://z.example.com/old/de/{i}") for i in range(3)] + [(2000, "http://z.example.com/old/it/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert all(got[1000 + i]["verdict"] == "block" and got[1000 + i]["rule"] is None for i in range(3)) and got[2000]["verdict"] == "allow"
