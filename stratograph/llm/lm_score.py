"""Cross-entropy difference: how much better a text fits a target model than a background model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .word_lm import Model

#: Labels up to this many (some 30 MB in a hash table) are sent to all executors; more are joined by shuffling.
BROADCAST_LABELS = 1_000_000


def cross_entropy_difference(docs: DataFrame, in_target: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, target_loss, background_loss (minus log probability a token) and score, their difference: the lower, the
    more a text is like the target.

    Two matched models: same vocabulary, order and smoothing. The background is counted over all documents, the target over those
    of ``in_target``; a caller that wants to know how well scores tell documents apart keeps some of the target out of it. Tokens
    are words (see ``word_lm.words``). A null or empty text has no tokens, losses of 0 and score 0. Without target documents, the
    target model is uniform. Null keys and repeated rows are scored like any other; an empty table gives an empty table; other
    columns are dropped.
    """
    sums = Model(docs, text, flag=in_target).losses(docs, key)
    mean = lambda c: F.col(c) / F.greatest(F.col("n_tokens"), F.lit(1))
    return sums.select(key, "n_tokens", mean("loss_t").alias("target_loss"), mean("loss_n").alias("background_loss"), (mean("loss_t") - mean("loss_n")).alias("score"))


def with_label(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """key, text and the label of each document (null without one, or without a key). Of several labels of a key the greatest
    holds."""
    own = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    few = labels.count() <= BROADCAST_LABELS
    return docs.select(key, text).join(F.broadcast(own) if few else own, key, "left")
