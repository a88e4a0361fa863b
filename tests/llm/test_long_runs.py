"""Texts of millions of equal characters, which a recursive matcher cannot take."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratograph.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.mark.parametrize("run", [" ", "\t", "x"])
def test_ids_of_long_runs(library, run):
    text = f"some {run * 2_000_000}a"
    assert list(packing._encoder(VOCABULARY)(text)) == library.encode(text, add_special_tokens=False).ids


def test_long_white_space_packs(spark):
    docs = spark.createDataFrame([(1, " " * 1_200_000 + "a"), (2, "\n" * 120_000), (3, "plain text")], "doc_id long, text string")
    out = packing.pack_documents(docs, VOCABULARY).toPandas()
    assert set(out["doc_id"]) == {1, 2, 3}
    assert (out.groupby("sequence_id")["length"].sum() <= 1024).all()
