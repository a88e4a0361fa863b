"""Quality rules: fixed counts on words and lines, and bands on the perplexity under a model of each language."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, slices
from .word_lm import Model
from .words import Words

#: Half the width of a language's band, in loss a word: so many times its usual deviation (which falls with the square root of
#: the number of words), and this much at least above and below the median. Copies of a text lower each other's loss.
DEVIATIONS, ABOVE, BELOW = 5.0, 1.0, 3.0
#: A document fails the base rules with fewer words, or with more of them (in percent) in repeated windows of REPEAT_WINDOW words.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8

#: Documents with more symbols than this (in percent of the characters in words) don't shape the language models.
MOST_SYMBOLS = 2

#: Languages up to this many are sent to all executors with their bands; more are joined by shuffling.
BROADCAST_LANGUAGES = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def base_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """The base counts of each text (see ``quality_rules``)."""
    words = Words(texts, lower=False)
    counts = {"n_words": np.diff(words.first)}
    starts = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])  # code points begun before each byte
    counts["word_chars"] = np.bincount(words.doc, starts[words.end] - starts[words.begin], words.n)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])
    counts["n_symbols"] = symbols[words.doc_begin[1:]] - symbols[words.doc_begin[:-1]]
    counts["n_dup_lines"] = np.array([_repeated_lines(t) if "\n" in t else 0 for t in texts])
    found, at = words.windows(REPEAT_WINDOW)
    doc = words.doc[at]
    order = np.lexsort((found, doc))
    same = (found[order][1:] == found[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(found), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(words.hash) + 1, np.int64)
    begun = at[order][twice]
    np.add.at(cover, begun, 1)
    np.add.at(cover, begun + REPEAT_WINDOW, -1)
    counts["n_repeat_words"] = np.bincount(words.doc, np.cumsum(cover)[:-1] > 0, words.n)
    return {k: v.astype(np.int64) for k, v in counts.items()}


def fails_base(counts: dict) -> np.ndarray | Column:
    """Whether base counts (arrays or columns) fail the base rules."""
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def prose(texts: list[str]) -> np.ndarray:
    """Which texts shape the language models: those that pass the base rules and have few symbols."""
    out = np.zeros(len(texts), bool)
    for a, b in slices(texts):
        counts = base_counts(texts[a:b])
        out[a:b] = ~fails_base(counts) & (100 * counts["n_symbols"] <= MOST_SYMBOLS * counts["word_chars"])
    return out


def _middle(rows: DataFrame, value: Column, shares: list[float], step: float) -> DataFrame:
    """Quantiles of ``value`` by group, to ``step``: exact counts of a fine histogram, which no order of rows changes. Of its
    places, those of no value left out, the first with a share of the rows up to it."""
    places = rows.select("group", F.round(value / step).cast("long").alias("place")).groupBy("group", "place").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("group").orderBy("place"))
    whole = F.sum("n").over(Window.partitionBy("group"))
    return places.select("group", "place", (upto / whole).alias("share")).groupBy("group").agg(*(F.min(F.when(F.col("share") >= q, F.col("place") * step)).alias(f"q{k}") for k, q in enumerate(shares)))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base rules and perplexity bands for every document.

    Spark counts the pairs of words of all prose (documents that pass the base rules and have few symbols) by language; a modified
    Kneser-Ney model of each language scores each document's perplexity (see ``word_lm``: pairs are stored as sorted arrays of
    hashed codes and meet documents in a shuffle). A language's band lies about the median of its documents' losses a word: its
    halves are DEVIATIONS usual deviations, plus ABOVE or BELOW, where the usual deviation of a text of n words is the language's
    interquartile deviation of sqrt(n) * (loss - median), divided by sqrt(n): short texts vary more.

    Returns key, n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_dup_lines (lines with a word, equal to
    an earlier one), n_repeat_words (words in 8-word windows that occur twice or more in the text), base_failed, kept, and the
    verdict's perplexity, perplexity_low and perplexity_high. A null text counts as empty: without words, it fails. A null or
    empty language is a language of its own; beyond the 65,535 languages of most documents, all others are one. A text without
    a word that the models know of has a perplexity of 1. Null keys and repeated rows are judged as any other row; an empty table
    gives an empty table; other columns are dropped.
    """
    model = Model(docs, text, group=F.col(lang), among=prose)
    scored = checkpoint(model.losses(docs, key, base_counts, _BASE).withColumnRenamed(key, "_key"))
    rate = F.round(F.col("loss_n") / F.greatest(F.col("n_tokens"), F.lit(1)), 9)
    worded = scored.filter("n_tokens > 0").withColumn("rate", rate)
    middle = checkpoint(_middle(worded, F.col("rate"), [0.5], 0.001).withColumnRenamed("q0", "middle"))
    small = (lambda df: F.broadcast(df)) if middle.count() <= BROADCAST_LANGUAGES else (lambda df: df)
    off = worded.join(small(middle), "group")
    spread = _middle(off, (F.col("rate") - F.col("middle")) * F.sqrt("n_tokens"), [0.25, 0.75], 0.01)
    bands = middle.join(spread, "group").select("group", "middle", ((F.col("q1") - F.col("q0")) / 1.349).alias("usual"))
    usual = F.lit(DEVIATIONS) * F.col("usual") / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))
    failed = fails_base({k: F.col(k) for k in _BASE})
    judged = scored.join(small(bands), "group", "left").select(
        F.col("_key").alias(key), *_BASE, failed.alias("base_failed"),
        F.exp(rate).alias("perplexity"), F.exp(F.col("middle") - usual - BELOW).alias("perplexity_low"), F.exp(F.col("middle") + usual + ABOVE).alias("perplexity_high"),
    )
    within = F.coalesce(F.col("perplexity").between(F.col("perplexity_low"), F.col("perplexity_high")), F.lit(False))
    return judged.select(key, *_BASE, "base_failed", (~F.col("base_failed") & within).alias("kept"), "perplexity", "perplexity_low", "perplexity_high")
