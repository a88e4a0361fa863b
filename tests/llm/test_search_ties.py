"""Ties of a search: a shard sends k rows, however many documents have one score."""

import numpy as np
import pyarrow as pa

from stratograph.llm import search


def test_equal_documents(spark):
    docs = spark.range(2000).selectExpr("1999 - id AS doc_id", "'one two three' AS text").coalesce(1)
    queries = spark.createDataFrame([(7, "two")], "doc_id long, text string")
    assert [(r["rank"], r["doc_id"]) for r in search.top_k(docs, queries, 3).orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]


def test_cut_is_by_score_and_key():
    place = search._order_of(pa.array([5, None, 3, 4]))
    assert place.tolist() == [2, 3, 0, 1]
    doc, score = search._cut(np.arange(4), np.array([1.0, 1.0 + 1e-12, 1.0 - 1e-12, 2.0]), place, 3)
    assert doc.tolist() == [3, 2, 0] and score.tolist() == [2.0, 1.0, 1.0]
    assert search._order_of(pa.array(["b", "a", None, "ä"])).tolist() == [1, 0, 3, 2]
