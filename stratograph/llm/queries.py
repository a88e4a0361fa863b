"""The corpus operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lm_score, manifest, middle, near_dedup, packing, privacy, quality, search, secrets, sharding, toxicity, urlfilter
from .common import read

#: The key of pseudonyms in the registered queries; a deployment passes its own secret to ``privacy.pseudonymize``.
PSEUDONYM_KEY = "registered-queries"


def vocabulary() -> str:
    """Path of the public byte-level BPE vocabulary on this machine; executors find it at the same path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), n_shards=40)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=2)
    return packed.withColumn("piece", F.col("piece").cast("int"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what is labelled of good quality, but for a fifth of all labels, which are held out to measure scores by; the
    background is every document."""
    docs = lm_score.with_label(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", "quality", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return lm_score.cross_entropy_difference(docs, (F.col("_label") == 1) & ~held_out).withColumn("held_out", held_out)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), size=5, percent=75)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read(spark, sf_dir, "documents"), vocabulary())


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document as a query, its whole text, against all documents."""
    docs = read(spark, sf_dir, "documents")
    return search.top_k(docs, docs.filter("doc_id % 100 = 0"), k=10)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymize(read(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "text")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_pages(read(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.middle_digest(read(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf; every seventh, by a hash of its key, is tampered with."""
    return manifest.audit(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_near_dedup": op5_near_dedup,
    "op6_bpe": op6_bpe,
    "op7_search": op7_search,
    "op8_pii": op8_pii,
    "op9_url_filters": op9_url_filters,
    "op10_quality_rules": op10_quality_rules,
    "op11_secret_scan": op11_secret_scan,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_manifest": op13_manifest,
}
ORACLE_SQL: dict[str, str] = {"op9_url_filters": urlfilter.ORACLE_SQL, "op11_secret_scan": secrets.ORACLE_SQL, "op12_fill_in_middle": middle.ORACLE_SQL, "op13_manifest": manifest.ORACLE_SQL}
