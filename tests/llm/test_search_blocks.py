"""Blocks of queries: an index is built once for several of them, and what the best so far rule out is left out."""

import numpy as np

from stratograph.llm import search


def _texts(n):
    rng = np.random.default_rng(3)
    return [" ".join(f"{'ab'[i % 2]}{int(x)}" for x in rng.zipf(1.3, 60) if x < 2000) for i in range(n)]


def test_several_blocks_take_one_pass(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(_texts(120))), "doc_id long, text string").repartition(3)
    queries = docs.filter("doc_id % 3 = 0")
    whole = {tuple(r) for r in search.top_k(docs, queries, 4).collect()}
    monkeypatch.setattr(search, "QUERIES", 10)
    one = search.top_k(docs, queries, 4)
    assert "Union" not in one._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in one.collect()} == whole and len(whole) == 160
    monkeypatch.setattr(search, "AT_ONCE", 2)
    assert {tuple(r) for r in search.top_k(docs, queries, 4).collect()} == whole


def test_scores_by_force(monkeypatch):
    """With and without a floor, few and many documents wanted, frequent terms in the matrix or not."""
    texts = _texts(400)
    for cells in (0, 1 << 23):
        monkeypatch.setattr(search, "CELLS", cells)
        shard = search.Shard(texts, 40.0)
        asked = [(q, shard.terms[q::5], np.linspace(0.1, 3, len(shard.terms[q::5]))) for q in range(5)]
        doc, term, times, length = search._counts(texts)
        weight = times * (search.K1 + 1) / (times + search.K1 * (1 - search.B + search.B * length[doc] / 40.0))
        for k in (1, 7, 300, 1000):
            for found, (_, terms, factors) in zip(shard.answers(asked, k), asked):
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                score = np.bincount(doc, np.where(terms[at] == term, weight * factors[at], 0), len(texts))
                best = np.sort(score[score > 0])[::-1][:k]
                assert np.allclose(np.sort(found[2])[::-1][: len(best)], best) and np.allclose(score[found[1]], found[2]) and len(found[1]) >= len(best)
                floor = float(best[len(best) // 2])
                some = next(shard.answers([(0, terms, factors)], k, np.array([floor])))
                assert set(some[1].tolist()) == {d for d, s in zip(found[1].tolist(), found[2]) if s >= floor * (1 - 1e-9)}
