"""URL filters: explicit host and path rules, and mined association rules for the rest.

A URL becomes a set of tokens (host, its labels and words, path words, file
ending, query keys; numbers are left out).  URLs that an explicit rule
decides are labelled by it, others by their documents.  Spark's FP-growth mines
token combinations of labelled URLs together with the label itself; rules that
conclude ``block`` are pruned by support (a share and a least number of pages),
confidence, lift, a lower bound of the confidence against the base rate, and
redundancy; so labels that have nothing to do with the URLs give next to no rules.
Tokens too rare on blocked pages are left out and tokens on the same pages are one
item before mining, so a deep URL on many pages does not give all its subsets.
Rules match through an inverted index: each rule is posted under its rarest
item only, and a posting counts if all items of the rule are there.  Mining and
matching run once per distinct token set, of which there are far fewer than URLs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialize

BLOCK = "label=block"

#: Pages of one token set that a row stands for on its way to the miner, and pages a task of the miner reads.
PORTION, TASK_PAGES = 1_000, 100_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines like ``block example.org/es/``."""
    out = []
    for line in lines:
        verdict, _, place = line.partition(" ")
        host, slash, path = place.partition("/")
        out.append(Rule(verdict, host, slash + path))
    return out


#: The rules of the query.
RULES = parse_rules(["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"])

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The fitting rule with the longest text as struct(rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The token set of a URL, sorted; empty for a null or bare text."""
    u, h, p = F.coalesce(url, F.lit("")), host(url), path(url)
    tag = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(name + "="), x))
    labels = F.split(h, r"\.")
    words = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "[-_]"))), lambda x: F.length(x) > 2)
    segments = F.filter(F.split(F.lower(p), "[/._-]"), lambda x: x.rlike("^[a-z]{2,24}$"))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "[&;]"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    site = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")
    some = lambda c: F.filter(F.array(c), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(tag("host", some(h)), tag("site", some(site)), tag("word", words), tag("path", segments), tag("key", keys))))


def labelled(pages: DataFrame, labels: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """page_id, url, bad: pages that an explicit rule decides, and others whose document (the last number of the path) has a label."""
    known = pages.select("page_id", "url", longest_rule(rules, host(F.col("url")), path(F.col("url")))["verdict"].alias("verdict"))
    number = F.regexp_extract(path(F.col("url")), r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    docs = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    by_document = known.where("verdict IS NULL").withColumn("doc_id", number.try_cast("long")).join(docs, "doc_id")
    return known.where("verdict IS NOT NULL").select("page_id", "url", (F.col("verdict") == "block").alias("bad")).unionByName(by_document.select("page_id", "url", "bad"))


def lower_bound(share: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share seen in ``n`` cases."""
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - half) / (1 + z * z / n)


def token_classes(sets: DataFrame, least: int) -> DataFrame:
    """item, tokens, freq: tokens of at least ``least`` blocked pages, put together where they stand on the same pages.

    ``sets``: token_key, bad, n, one row each.  Page lists are told apart by their
    counts and 128 bits of hashes.  A class fits into one URL, so it is small.
    """
    posts = sets.select("n", "bad", F.explode(F.split("token_key", "\n")).alias("token"), F.xxhash64("token_key", "bad").alias("a"), F.xxhash64("bad", "token_key", F.lit(1)).alias("b"))
    lists = posts.groupBy("token").agg(F.sum("n").alias("freq"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("blocked"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    classes = lists.where(F.col("blocked") >= least).groupBy("freq", "blocked", "a", "b").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return classes.select(F.col("tokens")[0].alias("item"), "tokens", "freq")


def transactions(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """items, n: each set of ``sets`` by its classes, with the label; sets without either are left out."""
    tokens = classes.select("item", F.explode("tokens").alias("token"))
    posts = sets.select("token_key", "bad", "n", F.explode(F.split("token_key", "\n")).alias("token")).join(broadcast_if_small(tokens, 200_000), "token")
    merged = posts.select("token_key", "bad", "n", "item").unionByName(sets.where("bad").select("token_key", "bad", "n", F.lit(BLOCK).alias("item")))
    return merged.groupBy("token_key", "bad", "n").agg(F.collect_set("item").alias("items")).groupBy(F.array_sort("items").alias("items")).agg(F.sum("n").alias("n"))


def mine(train: DataFrame, min_support: float = 0.0005, min_confidence: float = 0.9, min_lift: float = 1.5, min_pages: int = 5, z: float = 3.5) -> DataFrame | None:
    """Rules (items, classes, anchor, confidence, support) that conclude ``block``; None where nothing can be mined.

    A rule holds on at least ``min_pages`` blocked pages and ``min_support`` of all
    labelled ones, and Wilson's lower bound of its confidence (``z`` deviations)
    lies above the share of blocked pages.  Tokens on the same labelled pages are
    one item; any token of an item's class stands for it, so the matches are those
    of all rules over single tokens.  A long URL on many pages is thus one item.
    """
    sets = train.select(F.array_join(tokens(F.col("url")), "\n").alias("token_key"), "bad").where(F.col("token_key") != "")
    sets = materialize(sets.groupBy("token_key", "bad").agg(F.count(F.lit(1)).alias("n")), "url-sets")
    n, bad = sets.agg(F.sum("n"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0))).first()
    if not bad:
        return None
    least = max(math.ceil(min_support * n), min_pages)
    classes = materialize(token_classes(sets, least), "url-classes")
    weighted = materialize(transactions(sets, classes), "url-transactions")
    mined = weighted.agg(F.sum("n")).first()[0]
    # a weight is dealt out in portions, so that no task repeats a frequent set alone
    portions = weighted.select("items", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PORTION))).alias("k"))
    portions = portions.select("items", F.least(F.lit(PORTION), F.col("n") - F.col("k") * PORTION).cast("int").alias("n")).repartition(math.ceil(mined / TASK_PAGES))
    rows = portions.select("items", F.explode(F.sequence(F.lit(1), F.col("n")))).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / mined), minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.col("confidence") * n >= min_lift * bad))
    rules = rules.withColumn("blocked", F.round(F.col("support") * mined))
    # with the rule's tokens, blocked or not
    rules = rules.where((F.col("blocked") >= min_pages) & (lower_bound(F.col("confidence"), F.col("blocked") / F.col("confidence"), z) > bad / n))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("items"), "confidence", (F.col("blocked") / n).alias("support")), "url-rules")
    # a rule is redundant beside one with fewer tokens that is as sure: post subsets under each of their tokens
    posted = rules.select("items", "confidence", F.explode("items").alias("item"))
    fewer = rules.select(F.col("items").alias("sub"), F.col("confidence").alias("sub_confidence"), F.col("items")[0].alias("item"))
    redundant = posted.join(fewer, "item").where((F.size("sub") < F.size("items")) & (F.col("sub_confidence") >= F.col("confidence")) & (F.size(F.array_except("sub", "items")) == 0))
    rules = rules.join(redundant.select("items").distinct(), "items", "left_anti")
    anchors = rules.select("items", F.explode("items").alias("item")).join(classes, "item").groupBy("items").agg(F.collect_list("tokens").alias("classes"), F.min_by("tokens", F.struct("freq", "item")).alias("anchor"))
    return materialize(rules.join(anchors, "items"), "url-index")


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule] = RULES, **mining: float) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence: one row per input row.

    An explicit rule decides; else a page is blocked if a mined rule matches,
    with the confidence of the surest one, and allowed otherwise.  A null url or
    one without ``://`` has an empty host and path and is allowed.  Labels of a
    null doc_id, or null labels, are not used; without a blocked page nothing is mined.
    Very long URLs are read whole; equal URLs are one token set with a weight.
    Further columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.array_join(tokens(F.col("url")), "\n").alias("token_key"))
    rows = rows.withColumn("fits", longest_rule(rules, F.col("host"), F.col("path")))
    index = mine(labelled(pages, labels, rules), **mining)
    if index is None:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    else:
        sets = rows.where(F.col("fits").isNull()).select("token_key").distinct().withColumn("tokens", F.split("token_key", "\n"))
        posted = index.select("classes", "confidence", F.explode("anchor").alias("anchor"))
        hits = sets.withColumn("anchor", F.explode("tokens")).join(posted, "anchor").where(F.forall("classes", lambda c: F.arrays_overlap(c, "tokens")))
        hits = materialize(hits.groupBy("token_key").agg(F.max("confidence").alias("confidence")), "url-hits")
        rows = rows.join(broadcast_if_small(hits, 200_000), "token_key", "left")
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", mined).alias("verdict"), F.when(F.col("fits").isNull(), F.round("confidence", 6)).alias("confidence"))
