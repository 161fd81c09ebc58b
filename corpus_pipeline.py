"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor
kept; its result is written as Parquet and reread for the next one.  All but the last
return the columns of ``documents``.  Language ID rejects what has no letters or is far
from every language, so SQL can't express the whole (ORACLE_SQL is None); the tests
compare the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, linededup, minhash
from tessera.llm.common import materialize, table
from tessera.llm.queries import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, by centroids learned from the labelled ones that are not held out."""
    learn = F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))
    return langid.keep_known(docs, langid.fit(docs, learn))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those of which nothing is left go."""
    return linededup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.without(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the token ids, and of the text they decode to."""
    return bpe.digests(bpe.round_trip(docs, VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenize", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
