"""Exact dedup by a heavy-hitter split.

Digests of the normalised texts are written once (a digest is 64 characters,
so the table is a small share of the texts).  A Misra-Gries pass
(``freqItems``) keeps at most ``1 / support`` counters and yields every digest
that covers more than ``support`` of the rows, with false positives.  Those
candidates are verified by exact counts and winners; the verified winners, a
table of bounded size, are broadcast, so rows of hot groups are settled where
they are and never shuffled.  All other groups hold at most ``support`` of the
rows and go through one ordinary shuffle of (digest, id, length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Share of all rows above which a digest is sure to be found by the first pass.
SUPPORT = 0.001


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text, digest of the text without ASCII white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.length(text).alias("n_points"),
        F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""), 256).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest doc_id,
    stays.  A null text counts as empty; empty and all-white-space texts form one
    group.  A null doc_id loses every tie.  Repeated rows of the winner's doc_id
    are all marked as kept, since the id is the identity.  An empty table gives
    an empty result; further columns are ignored.
    """
    d = materialize(digests(docs), "digests")
    frequent = d.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    best = [
        F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    ]
    chosen = lambda rows: rows.groupBy("text_sha256").agg(*best).select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    winners = materialize(chosen(d.join(F.broadcast(frequent), "text_sha256")), "winners")
    hot = d.join(F.broadcast(winners), "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    # groups are reduced before the shuffle, and the join back may be split by size: no group has to fit in one task
    others = d.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    rest = others.join(chosen(others), "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    return hot.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST)
"""
