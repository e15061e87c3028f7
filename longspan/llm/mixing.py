"""Mixing sources to target weights by Poisson replication.

A source with ``n`` rows and share ``w`` of the target gets the mean repetition
rate ``total * w / n``.  Each row draws its number of copies by inverting the
Poisson distribution at a value hashed from seed and doc_id, so the draw is the
same on every attempt of a task.  Rates above ``PART_MEAN`` are drawn as a sum
of equal parts (a sum of Poisson variables is Poisson), which keeps the table of
the distribution short and exact for any rate.  The only shuffle of texts is the
global one at the end; its key is a hash of (seed, doc_id, copy), so no source
or group of copies gathers in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, unit_hash

SEED = 20
PART_MEAN = 8.0
#: At mean 8 the tail beyond 64 is below 1e-30, far under the 2**-48 steps of the hash.
PART_MAX = 64
SOURCES_BROADCAST = 10_000
SALTS = 64


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, total: int | None = None) -> DataFrame:
    """source_key, repetition_rate, parts, cdf: one row per source (a null source is one too)."""
    counts = docs.groupBy(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default_weight))
    if weights:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.when(F.col("source_key.none"), weight).otherwise(F.coalesce(F.create_map(*pairs)[F.col("source_key.name")], weight))
    counts = counts.withColumn("weight", weight)
    whole = counts.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    target = float((whole["n"] if total is None else total) or 0)
    per_weight = target / whole["weight"] if whole["weight"] else 0.0
    counts = counts.select("source_key", (F.lit(per_weight) * F.col("weight") / F.col("n")).alias("repetition_rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("repetition_rate") / PART_MEAN).cast("int"))
    mean = F.col("repetition_rate") / F.col("parts")
    first = F.exp(-mean)
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(PART_MAX)),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / k)).alias("c")),
        lambda acc: acc["c"],
    )
    return counts.withColumn("parts", parts).withColumn("cdf", cdf)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Every row as often as its draw says, in a global pseudo-random order.

    Adds repetition_rate, n_copies, copy_no and shuffle_key; columns of these
    names in the input are replaced.  ``weights`` maps a source to its share,
    other sources (a null source counts as one more) have ``default_weight``; a
    weight of 0 drops a source.  ``total`` is the expected number of rows, by
    default that of the input.  Repeated rows of one doc_id draw the same number;
    a null doc_id draws as the empty text does; null or empty texts are rows like
    others; an empty table gives an empty result.
    """
    docs = docs.drop("repetition_rate", "n_copies", "copy_no", "shuffle_key")
    kept = docs.columns
    r = rates(docs, weights, default_weight, total).select("source_key", F.struct("repetition_rate", "parts", "cdf").alias("mix_rate"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("mix_row"),
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("source_key"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix_id"),
    )
    if small(r.select("source_key"), SOURCES_BROADCAST):
        rows = rows.join(F.broadcast(r), "source_key")
    else:  # more sources than may be broadcast: each source's rows are dealt over salts
        salt = (F.crc32("mix_id") % SALTS).cast("int")
        rows = rows.withColumn("salt", salt).join(r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["source_key", "salt"])
    rate = F.col("mix_rate")
    n = F.aggregate(
        F.sequence(F.lit(0), rate["parts"] - 1),
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter(rate["cdf"], lambda c: c <= unit_hash(F.lit(seed), F.col("mix_id"), j))),
    )
    copies = (
        rows.withColumn("n_copies", n)
        .where("n_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .select(*[F.col("mix_row")[c].alias(c) for c in kept], F.round(rate["repetition_rate"], 9).alias("repetition_rate"), "n_copies", "copy_no", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "mix_id", "copy_no")).alias("shuffle_key"))
    )
    # rows of one doc_id share their keys, so a seeded draw deals them over several tasks
    salted = copies.withColumn("mix_salt", (F.rand(seed) * SALTS).cast("int")).repartition("shuffle_key", "mix_salt")
    return salted.sortWithinPartitions("shuffle_key").drop("mix_salt")


#: Equal shares for all sources, as the query uses.
ORACLE = """
WITH c AS (SELECT coalesce(source, '') AS name, source IS NULL AS none, count(*) AS n FROM documents GROUP BY ALL),
r AS (SELECT name, none, (SELECT sum(n) FROM c)::DOUBLE * 1e0 / (SELECT count(*) FROM c)::DOUBLE / n::DOUBLE AS rate FROM c),
p AS (SELECT *, greatest(1, ceil(rate / 8e0)::INT) AS parts FROM r),
k AS (SELECT name, none, rate, parts, i, exp(-rate / parts + sum(CASE WHEN i = 0 THEN 0e0 ELSE ln(rate / parts / i) END) OVER (PARTITION BY name, none ORDER BY i)) AS pmf
      FROM p, range(0, 65) t(i)),
cdf AS (SELECT name, none, rate, parts, sum(pmf) OVER (PARTITION BY name, none ORDER BY i) AS c FROM k),
q AS (SELECT name, none, any_value(rate) AS rate, any_value(parts) AS parts, list(c ORDER BY c) AS cs FROM cdf GROUP BY ALL),
d AS (SELECT doc_id, text, lang, source, n_chars, rate, parts, cs
      FROM documents JOIN q ON q.name = coalesce(source, '') AND q.none = (source IS NULL)),
u AS (SELECT d.*, list_sum(list_transform(range(0, parts), lambda j: len(list_filter(cs, lambda x:
        x <= ('0x' || substr(md5('20|' || coalesce(doc_id::VARCHAR, '') || '|' || j), 1, 12))::BIGINT / 281474976710656e0))))::INT AS n_copies FROM d)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS repetition_rate, n_copies, copy_no::INT AS copy_no,
       md5('order20|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no) AS shuffle_key
FROM u, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy_no)
"""
