"""A corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it back as the next one's
docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratograph.llm import near_dedup, packing, privacy, quality, queries, toxicity
from stratograph.llm.common import checkpoint, read


def _without(docs: DataFrame, rejected: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` but for the keys in ``rejected``. Texts are shuffled only if the keys are too many to broadcast."""
    keys = checkpoint(rejected.filter(F.col(key).isNotNull()).select(key).distinct())
    return near_dedup.semi_or_anti(docs, keys, keys.count(), key, "left_anti").select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row, so that a verdict on a row is on no other, whatever its key. Rows must come in the
    same order whenever ``docs`` is read, as those of Parquet files do."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Each row is judged by itself, also with a null key or one that comes again."""
    rows = _numbered(docs)
    return _without(rows, quality.quality_rules(rows, key="_row").filter("NOT kept"), "_row").drop("_row")


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Each row is judged by itself, also with a null key or one that comes again."""
    rows = _numbered(docs)
    scores = toxicity.score(rows, toxicity.learn(docs, read(spark, sf_dir, "labels")), key="_row")
    return _without(rows, scores.filter("score >= 0.5"), "_row").drop("_row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. A key that comes again is the same document and stays as
    often; rows with a null key are linked with nothing and stay."""
    return _without(docs, near_dedup.near_duplicates(docs, size=5, percent=75).filter("NOT kept"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return privacy.pseudonymize(docs, queries.PSEUDONYM_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens: a row for each piece."""
    return packing.pack_documents(docs, queries.vocabulary(), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", non_toxic),
    ("near_dedup", near_duplicates),
    ("pii", pseudonyms),
    ("packing", pack),
]
#: No stage but the fourth has rows that SQL can express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``. Between stages, tables are written to the folder in spark.checkpoint.dir."""
    docs = read(spark, sf_dir, "documents")
    checkpoint(spark.range(1))  # sets a folder where the session names none
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
