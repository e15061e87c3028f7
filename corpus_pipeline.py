"""A training-data pipeline over ``documents``: toxicity, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; ``run`` writes every stage's result to the shared folder and reads it back
as the next one's input.

All stages take rows as they are: a null text is an empty one, repeated rows are
rows like others, texts of any length are taken whole, an empty table gives an
empty one, and columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from longspan.llm.shared import broadcast_if_small, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ``ids``; a null doc_id stays."""
    return docs.join(broadcast_if_small(ids), "doc_id", "left_anti").select(*COLUMNS)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go, all rows of such a doc_id; null texts and null doc_ids stay."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, materialize(scored.where("rejected").select("doc_id").distinct(), "toxic"))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; a text of which nothing is left goes with them.

    A text that was empty or null before stays.  Repeated rows of one doc_id and
    text are one place, so both stay or go.
    """
    out = line_dedup.line_dedup(docs).where("n_spans = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, with all its rows; texts without words are copies of none."""
    groups = near_dedup.near_dedup(docs)
    return _without(docs, materialize(groups.where("NOT kept").select("doc_id").distinct(), "near-copies"))


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have equal shares, and shuffled; a null source is one of them."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, their number and the digests of ids and decoded bytes."""
    return bpe.digest(docs, with_ids=True)


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_out),
    ("near_dedup", near_copies_out),
    ("mixing", sources_mixed),
    ("byte_bpe", tokens),
]

#: Classifiers, chunk matching and sketches have no SQL form; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
