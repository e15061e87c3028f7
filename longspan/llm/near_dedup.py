"""MinHash near-dedup with bottom-k sketches of one hash function.

1. Every whole text becomes its set of distinct word shingles; the sketch keeps
   the ``k`` smallest hash values.  Texts with one and the same set are a class,
   which goes on as one node with a number of its own.
2. Inverted lists of retained values generate candidates.  Two sets with the
   wanted similarity share at least ``need`` retained values (all but one pair in
   ten million by the binomial bound, all pairs of sets no larger than a sketch),
   so each sketch posts only its rarest ``size - need + 1`` values.  Values that
   very many texts retain (a common passage) come last in that order and are
   posted only by texts that consist of little else.
3. Candidates never are all pairs of a list, linked or not.  First every member
   is compared with the member of most weight of its lists (the one most of whose
   values are frequent), which joins most near copies in linear work.  The lists
   are then split by size of the sets.  Those of up to LIST members give their
   pairs of different components.  A longer list gets a centre,
   again a member of most weight.  Every member is compared
   with the centre and keeps what it lacks of it and has beyond it.  For members
   x and m with centre c ``|x & m| <= min(|x & c|, |m & c|) + |(x - c) & (m - c)|``,
   so only texts that share enough beyond the centre are candidates, found by
   inverted lists and sieved by bitmaps, and what they lack in common tells the exact size of ``x & m``
   without another look at the texts.  Pairs within a component need no
   comparison, so no link between different components is lost.
4. For all other pairs the sketch of the union estimates the similarity and
   discards what cannot pass; the exact similarity of the full sets, taken from
   both texts, decides.
   Texts of a pair are joined by salted keys, so a centre with very many members
   is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, in_batches, lower_table, materialize, mix64, row_blocks, SpanHash, text_bytes, with_texts, word_spans

#: Chance that a pair of large sets at the limit is missed, and members up to which all pairs of a list are candidates.
LOSS, LIST = 1e-7, 32


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75
    k: int = 48

    @property
    def need(self) -> int:
        """Retained values that two similar sets share but for a chance of LOSS."""
        p, total = self.percent / 100, 0.0
        for c in range(self.k):
            total += comb(self.k, c) * p**c * (1 - p) ** (self.k - c)
            if total > LOSS:
                return max(1, c)
        return self.k


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin (one more at the end)."""
    data = lower_table()[data]
    starts, ends, first = word_spans(data, offsets)
    h = SpanHash(data)(starts, ends, 3)
    counts = np.diff(first)
    full = np.maximum(counts - words + 1, 0)
    total = int(full.sum())
    begin = np.repeat(first[:-1] - (np.cumsum(full) - full), full) + np.arange(total)
    s = np.zeros(total, np.uint64)
    for j in range(words):
        s = mix64(s + h[begin + j])
    row = np.repeat(np.arange(len(counts)), full)
    few = np.flatnonzero((counts > 0) & (counts < words))
    short = []
    for i in few.tolist():
        x = np.zeros(1, np.uint64)
        for v in h[first[i] : first[i + 1]]:
            x = mix64(x + v)
        short.append(mix64(x + np.uint64(counts[i]))[0])
    row, s = np.append(row, few), np.append(s, np.array(short, np.uint64))
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    row, s = row[new], s[new]
    return s, np.searchsorted(row, np.arange(len(counts) + 1))


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (a digest of the whole set), sketch (ascending)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    k, words = settings.k, settings.words

    def run(batches):
        from hashlib import blake2b

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_blocks(offsets, 1 << 18):
                s, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                n = np.diff(first)
                keys = [blake2b(s[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first, first[1:])]
                kept = np.minimum(n, k)
                at = np.cumsum(kept) - kept
                values = s[np.repeat(first[:-1] - at, kept) + np.arange(int(kept.sum()))]
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, kept.sum()).astype(np.int32)), pa.array((values ^ np.uint64(1 << 63)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), lists], ["doc_id", "text_hash", "n_shingles", "set_key", "sketch"])

    return in_batches(rows).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, sketch array<long>")


def postings(classes: DataFrame, settings: Settings) -> DataFrame:
    """node, n, weight, value: the rarest values of each sketch among those that two sketches retain.

    The weight is high for a text most of whose values very many sketches retain,
    such as the one that other texts are copies of.
    """
    every = classes.select("node", F.explode("sketch").alias("value"))
    shared = every.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = every.join(shared, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))  # at most k of a node
    n, k = F.col("n"), settings.k
    size = F.least(n, F.lit(k))
    need = F.when(n * 100 <= k * settings.percent, F.ceil(n * settings.percent / 100)).otherwise(settings.need)
    take = (size - need + 1) - (size - F.size("values"))  # values of one sketch only come first and link nothing
    weight = F.aggregate("values", F.lit(0).cast("long"), lambda total, v: total + v["df"]) / size
    rows = classes.select("node", "n").join(lists, "node").withColumn("take", take.cast("int")).where("take > 0").withColumn("weight", weight)
    return rows.select("node", "n", "weight", F.explode(F.slice("values", F.lit(1), F.col("take"))).alias("v")).select("node", "n", "weight", F.col("v.value").alias("value"))


def could_match(n_a: Column, n_b: Column, percent: int) -> Column:
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)


def estimated(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """a, b, estimate of the pairs that the union's sketch cannot rule out."""
    k = settings.k
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = F.array_intersect("s_a", "s_b")
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    exact = F.size("both") / (F.col("n_a") + F.col("n_b") - F.size("both"))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    hits = F.size(F.filter("both", lambda x: x <= F.element_at("union", -1)))
    e = pairs.join(a, "a").join(b, "b").withColumn("both", both).where(whole | (F.size("both") >= settings.need)).withColumn("union", union)
    e = e.withColumn("estimate", F.when(whole, exact).otherwise(hits / F.size("union")))
    least = F.when(whole, settings.percent / 100 - 1e-9).otherwise(settings.need / k)
    return e.where(F.col("estimate") >= least).select("a", "b", "estimate")


def compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, settings: Settings, beyond: bool = False) -> DataFrame:
    """a, b, n_a, n_b, both (size of the intersection) from both whole texts; with ``beyond``, also what b has beyond a, and lacks of it."""
    pairs = materialize(pairs.select("a", "b"), "near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places = materialize(classes.join(broadcast_if_small(wanted), "node", "left_semi").select("node", "rep.doc_id", "rep.text_hash"), "near-places")
    ours = docs.select("doc_id", "text").join(broadcast_if_small(places), "doc_id").where(F.xxhash64("text") == F.col("text_hash"))
    texts = materialize(ours.dropDuplicates(["node"]).select("node", "text"), "near-texts")  # repeated rows are equal
    rows = with_texts(pairs, texts, {"a": "text_a", "b": "text_b"})
    words = settings.words

    def run(batches):
        for batch in batches:
            (da, oa), (db, ob) = text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b"))
            for lo, hi in row_blocks(oa + ob, 1 << 18):
                x, fx = shingle_sets(da[oa[lo] : oa[hi]], oa[lo : hi + 1] - oa[lo], words)
                y, fy = shingle_sets(db[ob[lo] : ob[hi]], ob[lo : hi + 1] - ob[lo], words)
                both, rest, gone = np.zeros(hi - lo, np.int64), [], []
                for i in range(hi - lo):
                    p, q = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
                    inside = p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q if len(p) else np.zeros(len(q), bool)
                    both[i] = inside.sum()
                    if beyond:
                        rest.append(q[~inside])
                        gone.append(np.setdiff1d(p, q, assume_unique=True))
                out = [batch.column(c).slice(lo, hi - lo) for c in ("a", "b")] + [pa.array(np.diff(fx).astype(np.int64)), pa.array(np.diff(fy).astype(np.int64)), pa.array(both)]
                names = ["a", "b", "n_a", "n_b", "both"]
                for name, parts in (("beyond", rest), ("missing", gone)) if beyond else ():
                    edges = np.concatenate([[0], np.cumsum([len(r) for r in parts])]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts).view(np.int64))))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(out, names)

    return in_batches(rows.select("a", "b", "text_a", "text_b")).mapInArrow(run, "a long, b long, n_a long, n_b long, both long" + ", beyond array<long>, missing array<long>" * beyond)


def similar(settings: Settings) -> Column:
    return (F.col("both") > 0) & (F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * settings.percent)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, written once."""
    return materialize(compared(pairs, classes, docs, settings).where(similar(settings)).select("a", "b"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of undirected links (a, b).

    Alternates large-star and small-star steps: every node links its larger, then
    its smaller neighbours to the smallest one.  Each step is two shuffles of the
    links with map-side minima, and a logarithmic number of steps suffices.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = materialize(edges, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


#: Sets under this size may be compared after meeting in one list; larger ones must meet in two.
SMALL_SET = 12


def met_twice(pairs: DataFrame, *columns: str) -> DataFrame:
    """Distinct pairs that met in two lists, or in one with a small set (``n``).

    Only steps that later ones make up for may use this: texts that share one rare
    value alone are seldom alike, and what is left out here is compared directly.
    """
    return pairs.groupBy(*columns).agg(F.count(F.lit(1)).alias("lists"), F.min("n").alias("n")).where(f"lists > 1 OR n < {SMALL_SET}").select(*columns)


def star_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of lists with the list's member of most weight."""
    first = posted.groupBy("value").agg(F.max(F.struct("weight", "node", "n")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pairs = posted.join(first, "value").where((F.col("node") != F.col("first.node")) & could_match(F.col("n"), F.col("first.n"), percent))
    return met_twice(pairs.select(F.col("first.node").alias("a"), F.col("node").alias("b"), "n"), "a", "b")


def by_size(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with lists split by size: each member is in two, and any two similar ones meet in one."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100.5 / percent))).cast("int")
    return rows.withColumn("value", F.explode(F.array(F.xxhash64("value", step), F.xxhash64("value", step + 1))))


def short_pairs(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components in lists of up to LIST members."""
    lists = rows.join(sizes.where(F.col("size").between(2, LIST) & (F.col("low") < F.col("high"))).select("value"), "value")
    left = lists.select("value", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    right = lists.select("value", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    other = (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & could_match(F.col("n_a"), F.col("n_b"), percent)
    return left.join(right, "value").where(other).select("a", "b").distinct()


def centred(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """centre, node of each member of a list with more than LIST members and several components.

    The centre is the member of most weight, of the list's largest component where
    that is a quarter of the list.
    """
    long = rows.join(sizes.where((F.col("size") > LIST) & (F.col("low") < F.col("high"))).select("value", "size"), "value")
    long = materialize(long.select("value", "size", "node", "component", "weight"), "near-long")
    parts = long.groupBy("value", "size", "component").agg(F.count(F.lit(1)).alias("part"), F.max(F.struct("weight", "node")).alias("best"))
    main = parts.groupBy("value").agg(F.max(F.struct("part", "best")).alias("main"), F.max("best").alias("best"), F.max("size").alias("size"))
    centre = F.when((F.col("main.part") > 1) & (F.col("main.part") * 4 >= F.col("size")), F.col("main.best.node")).otherwise(F.col("best.node"))
    return long.select("value", "node").join(materialize(main.select("value", centre.alias("centre")), "near-centres"), "value").where("node <> centre").select("centre", "node").distinct()


#: 64-bit words of a bitmap of differences from a centre.
BIT_WORDS = 8


def bitmap(values: Column) -> Column:
    """Which of 64 * BIT_WORDS remainders occur among the values."""
    word = lambda w: F.aggregate(
        F.filter(values, lambda v: F.pmod(F.shiftright(v, 6), F.lit(BIT_WORDS)) == w),
        F.lit(0).cast("long"),
        lambda bits, v: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(64)).cast("int"))),
    )
    return F.array(*[word(w) for w in range(BIT_WORDS)])


def bits_set(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda n, word: n + F.bit_count(word))


def bounded_links(members: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) of members of one centre and different components.

    ``members``: centre, node, n, n_c (of the centre), both (shared with the
    centre), beyond, missing, component, inside (in the centre's own component).
    """
    # |x & m| >= wanted(n_x + n_m)
    wanted = lambda n: n * percent / (100 + percent) - 1e-9
    members = members.withColumn("bits", bitmap(F.concat("beyond", "missing")))
    members = materialize(members.withColumn("excess", F.size("beyond") + F.size("missing") - bits_set(F.col("bits"))), "near-members")
    light = members.select("centre", "node", "n", "n_c", "both", "component", "inside", "bits", "excess", F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(1.05))).alias("scale"))
    least = light.groupBy("centre").agg(F.min("n").alias("least"))
    scales = light.groupBy("centre", F.col("scale")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x = lambda rows: rows.select(*[c for c in rows.columns if c in ("centre", "value", "scale", "main")], F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("both").alias("both_x"), F.col("component").alias("c_x"), F.col("bits").alias("bits_x"), F.col("excess").alias("excess_x"))
    # pairs whose shares of the centre may be enough: x is not inside
    limit = F.floor(F.col("both_x") * (100 + percent) / percent + 1e-9) - F.col("n_x")
    sized = x(light.where("NOT inside").drop("scale")).join(least, "centre").withColumn("limit", limit).where("limit >= least")
    sized = sized.withColumn("n", F.explode(F.sequence("least", F.least("limit", F.floor(F.col("n_x") * 100 / percent)))))
    enough = sized.join(light.drop("inside", "scale", "bits", "excess"), ["centre", "n"]).where((F.col("c_x") != F.col("component")) & (F.col("both") >= wanted(F.col("n_x") + F.col("n")))).select("centre", "x", "node")
    # others share values beyond the centre: the one with the lesser share of the centre probes with its rarest, as it needs
    # so many in common with a text of some size
    # (values that the same texts hold count as one, with a weight)
    every = members.select("centre", "node", "component", F.explode("beyond").alias("value"))
    holders = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"holders_{i}") for i in (1, 2)]
    shared = every.groupBy("centre", "value").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high"), *holders).where("low < high")
    kinds = shared.groupBy("centre", "holders_1", "holders_2").agg(F.min("value").alias("value"), F.min("df").alias("df"), F.count(F.lit(1)).alias("weight"))
    held = materialize(every.join(kinds.select("centre", "value", "df", "weight"), ["centre", "value"]), "near-held")
    parts = held.groupBy("centre", "value", "component").agg(F.count(F.lit(1)).alias("part"))
    mains = parts.groupBy("centre", "value").agg(F.max(F.struct("part", "component")).alias("main")).select("centre", "value", F.col("main.component").alias("main"))
    after = Window.partitionBy("centre", "node").orderBy(F.desc("df"), F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)  # of a text's own values, the frequent first
    index = held.withColumn("rest", F.sum("weight").over(after)).drop("component", "df", "weight").join(light.drop("inside"), ["centre", "node"])
    index = materialize(index.join(mains, ["centre", "value"]), "near-index")
    need = F.greatest(F.lit(1), F.ceil(wanted(F.col("n") + F.greatest("least", F.ceil(F.col("n") * percent / 100 - 1e-9))) - F.col("both")))
    probes = x(index.drop("scale").join(scales, "centre").where((F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent) & (F.col("rest") >= need)))
    more = (F.col("both") > F.col("both_x")) | ((F.col("both") == F.col("both_x")) & (F.col("node") > F.col("x")))
    other = (F.col("c_x") != F.col("component")) & could_match(F.col("n_x"), F.col("n"), percent) & more
    # two texts have |x & m| = |x & c| + |m & c| - |c| + (differences in common), and the bitmaps bound the last
    common = bits_set(F.zip_with("bits_x", "bits", lambda a, b: a.bitwiseAND(b))) + F.least("excess_x", "excess")
    other &= common >= wanted(F.col("n_x") + F.col("n")) + F.col("n_c") - F.col("both_x") - F.col("both")
    met = lambda left, right: left.join(right.drop("main", "rest"), ["centre", "value", "scale"]).where(other).select("centre", "x", "node")  # noqa: E731  never the main component with itself
    found = met(probes.where("c_x <> main"), index).unionByName(met(probes.where("c_x = main"), index.where("component <> main")))
    pairs = materialize(enough.unionByName(found).distinct(), "near-bounded")
    whole = members.select("centre", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("both").alias("both_x"), F.col("beyond").alias("beyond_x"), F.col("missing").alias("missing_x"))
    rows = pairs.join(whole, ["centre", "x"]).join(members.select("centre", "node", "n", "n_c", "both", "beyond", "missing"), ["centre", "node"])
    common = F.col("both_x") + F.col("both") - F.col("n_c") + F.size(F.array_intersect("missing_x", "missing")) + F.size(F.array_intersect("beyond_x", "beyond"))
    return rows.where(common * 100 >= (F.col("n_x") + F.col("n") - common) * percent).select(F.col("x").alias("a"), F.col("node").alias("b")).distinct()


def links_of(classes: DataFrame, given: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all links, with the ``given`` ones among them."""
    posted = materialize(postings(classes, settings), "postings")
    star = estimated(star_pairs(posted, settings.percent), classes, settings)
    best = star.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a"))
    links = materialize(confirmed(best, classes, docs, settings).unionByName(given), "near-links")

    parted = materialize(by_size(posted, settings.percent), "near-parted")

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        labels = materialize(components(links), "near-labels")
        rows = materialize(parted.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-lists")
        sizes = rows.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        return labels, rows, materialize(sizes.where("size > 1 AND low < high"), "near-sizes")

    _, rows, sizes = labelled(links)
    to_centre = materialize(compared(centred(rows, sizes).select(F.col("centre").alias("a"), F.col("node").alias("b")), classes, docs, settings, beyond=True), "near-beyond")
    links = materialize(links.unionByName(to_centre.where(similar(settings)).select("a", "b")), "near-links")
    labels, rows, sizes = labelled(links)
    members = to_centre.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.col("n_a").alias("n_c"), F.col("n_b").alias("n"), "both", "beyond", "missing").join(labels, "node", "left")
    members = members.join(labels.withColumnsRenamed({"node": "centre", "component": "main"}), "centre", "left").withColumn("component", F.coalesce("component", "node"))
    members = materialize(members.withColumn("inside", F.col("component") == F.coalesce("main", "centre")).drop("main"), "near-members")
    short = estimated(short_pairs(rows, sizes, settings.percent), classes, settings)
    return links.unionByName(bounded_links(members, settings.percent)).unionByName(confirmed(short, classes, docs, settings))


def near_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    A-Z are lower-cased and words are runs of other than the six ASCII white
    space characters.  A text with fewer words than a shingle has one shingle;
    null, empty and white-space texts have none, are linked with nothing and
    kept.  Texts of any length are taken whole; a task holds a block of them.
    Repeated rows of one doc_id are one document: they share its component and
    the links of each of its texts' classes.  A null doc_id is never linked and is
    kept.  An empty table gives an empty result; further columns are ignored.

    Shingles are told apart by 64-bit values, sets by 128-bit digests of these: of
    two sets with n shingles together, some two different shingles are taken for
    one with a chance of about n * n / 2**65, except in texts made to collide.
    """
    sets = materialize(sketches(docs, settings), "sketches")
    known = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("set_key", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    known = materialize(known.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "node"), "set_key").drop("set_key"), "near-nodes")
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    given = known.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a < b").distinct()
    labels = materialize(components(links_of(classes, given, docs, settings)), "near-components")
    ids = classes.select("node", F.col("rep.doc_id").alias("doc_id")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = materialize(ids.select("node", "component").join(least, "component").select("node", "component_id"), "near-members")
    known = known.join(member, "node")
    rest = sets.where("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    out = known.select(*columns).unionByName(rest.select(*columns))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
