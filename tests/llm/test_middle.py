"""Fill-in-the-middle: against slices of strings, against SQL, and there and back."""

import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratograph.llm import middle

ODD = "ab<PSM>é\U0001f600\n"


def expected(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@settings(deadline=None, max_examples=400)
@given(st.integers(), st.text(alphabet=ODD, max_size=60))
def test_kernel(key, text):
    n, form, _, _, output = expected(key, text)
    raw = text.encode()
    assert middle.characters(raw) == n
    how = middle.plan(str(key), raw, n)
    assert how.form == form
    assert middle.transform(raw, how).decode() == output
    assert middle.restore(output.encode(), form) == raw


@pytest.mark.parametrize("text", ["a" * 300_000, "é" * 200_000, "\U0001f600a" * 70_000, "a" * 65_535 + "é" * 10 + "b" * 65_536])
def test_cuts_of_long_texts(text):
    raw = text.encode()
    for first, more in ((0, 0), (1, 65_535), (65_535, 1), (65_536, 70_000 - 65_536), (len(text), 0), (len(text) // 3, len(text) // 3)):
        for form in ("psm", "spm"):
            how = middle.Plan(form, first, more)
            pre, mid, suf = text[:first], text[first : first + more], text[first + more :]
            out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
            assert middle.transform(raw, how).decode() == out
            assert middle.restore(out.encode(), form) == raw


@given(st.binary(max_size=50), st.data())
def test_rotation(block, data):
    b = data.draw(st.integers(0, len(block)))
    a = data.draw(st.integers(0, b))
    buffer = bytearray(block)
    middle.rotate(buffer, a, b, len(block))
    assert bytes(buffer) == block[:a] + block[b:] + block[a:b]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [None, "", "x", "a<P>b", "<M>", "<", "é", "\U0001f600" * 3, "x" * 2_000_000] + ["".join(rng.choices(ODD, k=rng.randint(1, 200))).replace("<P>", "") for _ in range(300)]
    rows = [(i, t, 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[12], (None, "no key", None, None), (None, None, None, None)], "doc_id long, text string, n int, form string")


def test_against_plain_reading_and_sql(docs):
    given_ = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((k, *expected(k, t)[:4], sha(expected(k, t)[4]), sha(t or "")) for k, t in given_), key=str)
    got = sorted(map(tuple, middle.middle_digest(docs).collect()), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    columns = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    assert sorted(db.sql(f"SELECT {columns} FROM ({middle.ORACLE_SQL})").fetchall(), key=str) == want


def test_texts_come_back(docs):
    out = middle.restored(middle.fill_in_middle(docs))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert sorted((r.doc_id or -1, r.restored) for r in out.collect()) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())


def test_empty_table_and_odd_names(spark, docs):
    assert middle.middle_digest(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([("k.1", "some words", "x")], "`my.key` string, `the text` string, output string")
    assert middle.restored(middle.fill_in_middle(odd, "my.key", "the text")).first()["restored"] == "some words"
