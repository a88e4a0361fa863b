"""Bounds on a task's memory change no result."""

import numpy as np
import pyarrow as pa

from stratograph.llm import bpe, queries, search, word_lm
from stratograph.llm.common import frugal, texts_of


def test_texts_of_covers_every_row_once():
    texts = ["ab", None, "", "слово", "x" * 50, "y", None]
    column = pa.array(["before", *texts]).slice(1)
    for limit in (1, 4, 1000):
        parts = list(texts_of(column, limit))
        assert [t for _, _, own in parts for t in own] == [t or "" for t in texts]
        assert [i for i, _, _ in parts] == [0, *(j for _, j, _ in parts[:-1])] and parts[-1][1] == len(texts)
    assert list(texts_of(pa.array([], pa.string()))) == []


def test_frugal_changes_nothing():
    assert list(frugal(lambda xs: (x + 1 for x in xs))(iter([1, 2, 3]))) == [2, 3, 4]


def test_word_buckets_follow_the_corpus():
    assert word_lm.word_bits(0) == word_lm.word_bits(10**9) == word_lm.WORD_BITS
    assert word_lm.word_bits(10**14) == 18


def test_a_small_matrix_gives_the_same_answers(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 40) if x < 500) for _ in range(300)]

    def answers():
        shard = search.Shard(texts, 30.0)
        asked = [(q, shard.terms[q::7], np.linspace(0.1, 3, len(shard.terms[q::7]))) for q in range(7)]
        return len(shard.matrix), [sorted(zip(d.tolist(), s.round(9).tolist())) for _, d, s in shard.answers(asked, 5)]

    rows, whole = answers()
    for cells in (0, 3 * 320):
        monkeypatch.setattr(search, "CELLS", cells)
        fewer, same = answers()
        assert fewer == cells // 320 < rows and same == whole


def test_encode_decode_is_a_round_trip(spark):
    rows = [(1, "Some words,  and\nmore"), (2, ""), (3, None), (None, "слова 漢字 🙂")]
    out = {r["doc_id"]: r for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), queries.vocabulary()).collect()}
    assert {d: r["decoded"] for d, r in out.items()} == {d: t or "" for d, t in rows}
    assert out[2]["ids"] == out[3]["ids"] == [] and len(out[1]["ids"]) > 3
