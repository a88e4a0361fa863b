"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stratograph.llm import bpe, lm_score, near_dedup, packing, privacy, quality, search, sharding, toxicity, urlfilter

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, label int, score string, _bytes int, piece int, length string, signature int, query int"
LONG = "the quick brown fox number {} jumps over lazy dogs. "
TEXTS = [None, "", " \n\t ", "word", "a b c d", "same text here for all of them", "same text here for all of them", "".join(LONG.format(i) for i in range(4000)), "é\u0000 \U0001f600 ｗide", "x" * 50_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", None, 0, i, "n", 1, "s", 1, 1, "l", 1, 1) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "a row without a key and with some words", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "sharding": lambda s, d: sharding.assign_shards(d, n_shards=4),
    "lm": lambda s, d: lm_score.cross_entropy_difference(d, F.col("lang") == "en"),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "bpe": lambda s, d: bpe.encode_digest(d, VOCABULARY),
    "pii": lambda s, d: privacy.pseudonymize(d, "k"),
    "quality": lambda s, d: quality.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each(spark, docs, name):
    out = OPERATORS[name](spark, docs).toPandas()
    assert len(out) == docs.count()
    assert out["doc_id"].isna().sum() == 1
    assert (out["doc_id"] == 5).sum() == 3


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_empty_tables_of_the_rest(spark, docs):
    none = docs.limit(0)
    assert packing.pack_documents(none, VOCABULARY).count() == 0
    assert search.top_k(none, none).count() == 0
    assert search.top_k(docs, none).count() == 0


def test_packing_keeps_all_tokens(spark, docs):
    out = packing.pack_documents(docs, VOCABULARY, capacity=64).toPandas()
    per_doc = out.groupby("doc_id")["length"].sum()
    assert per_doc[0] == per_doc[1] == 1 and per_doc[5] == 3 * per_doc[6]
    assert out["doc_id"].isna().sum() == 1
    assert (out.groupby("sequence_id")["length"].sum() <= 64).all()


def test_near_duplicates_defined_cases(spark, docs):
    out = near_dedup.near_duplicates(docs).toPandas()
    one = out.drop_duplicates("doc_id").set_index("doc_id")
    assert one.loc[0, "n_shingles"] == one.loc[1, "n_shingles"] == one.loc[2, "n_shingles"] == 0
    assert one.loc[3, "n_shingles"] == one.loc[4, "n_shingles"] == 1
    assert one.loc[6, "component_id"] == 5 and not one.loc[6, "kept"]
    lost = out[out["doc_id"].isna()]
    assert lost["component_id"].isna().all() and lost["kept"].all()


def test_search_defined_cases(spark, docs):
    out = search.top_k(docs, docs, k=3).toPandas()
    assert not set(out["query"]) & {0, 1, 2}
    first = out[(out["query"] == 6) & (out["rank"] == 1)]
    assert first["doc_id"].tolist() == [5]  # ties go to the smaller key
    assert out.groupby("query")["rank"].max().max() <= 3


def test_quality_defined_cases(spark, docs):
    out = quality.quality_rules(docs).toPandas().drop_duplicates("doc_id").set_index("doc_id")
    assert out.loc[0, "n_words"] == 0 and out.loc[0, "base_failed"] and not out.loc[0, "kept"]


def test_url_filter_edges(spark):
    pages = spark.createDataFrame([(None, None, None), (0, None, ""), (5, "not a url", None), (10, "http://X.Example.com:80/a", None), (10, "http://X.Example.com:80/a", None), (12, "HTTPS://www.x.example.com", None)], "page_id long, url string, html string")
    out = urlfilter.filter_pages(pages)
    assert out.count() == 6
    assert {r["domain"] for r in out.collect()} == {None, "x.example.com", "www.x.example.com"}
    assert urlfilter.filter_pages(pages.limit(0)).count() == 0
