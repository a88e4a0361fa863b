"""Merkle manifests against whole levels built in plain Python, and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from stratograph.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank long, tree string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def expected(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for g in names:
        trees[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[g] = levels_of([leaf(r) for r in trees[g]])
    top = levels_of([own[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(trees[g]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            folded, siblings = leaf((*row[:3], row[3] + 1, row[4])) if hit else leaf(row), []
            for place, levels in ((i, own[g]), (k, top)):
                for level in levels[:-1]:
                    other = level[place ^ 1] if place ^ 1 < len(level) else None
                    siblings += [other] * (other is not None)
                    folded = h(folded) if other is None else h(other, folded) if place & 1 else h(folded, other)
                    place >>= 1
            out.append((row[0], leaf(row), own[g][-1][0], top[-1][0], h(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows(n, seed=5):
    rng = random.Random(seed)
    langs = [None, "", "de", "en", "en", "en", "é", "z"]
    made = [(i * 3, rng.choice([None, "web"]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "é" * (i % 5), f"text {i}"])) for i in range(n)]
    rng.shuffle(made)
    return made


def audited(spark, given):
    docs = spark.createDataFrame([(*r, 1, "clash", None) for r in given], SCHEMA)
    return sorted(map(tuple, manifest.audit(docs).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 5, 300])
def test_against_whole_levels(spark, n):
    given = rows(n)
    got = audited(spark, given)
    assert got == expected(given)
    if n == 300:
        assert {r[-1] for r in got} == {True, False}


def test_repeated_rows_null_keys_and_one_tree(spark):
    given = [(1, "a", "en", 3, "x")] * 9 + [(None, None, "en", None, None)] * 3 + [(1, "a", "en", 4, "y"), (2, "s", "en", None, "tampering leaves a null")]
    assert audited(spark, given) == expected(given)


def test_a_lone_leaf(spark):
    ((_, own, subroot, root, proof, folded, verified),) = audited(spark, [(5, None, None, None, None)])
    assert own == subroot == root == folded and proof == h() and verified


def test_empty_table(spark):
    assert manifest.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segments_records_and_proofs(spark):
    """More leaves than a segment has, so that paths go through two."""
    given = [(i, None, "en", i, "t") for i in range(9000)]
    assert audited(spark, given) == expected(given)
    nodes = spark.createDataFrame([("t", i, 5, h(str(i))) for i in range(5)], "tree string, rank long, n long, digest string")
    made = manifest.build(nodes)
    want = levels_of([h(str(i)) for i in range(5)])
    kept = {r.digest: list(r.children) for r in manifest.records(made).collect()}
    assert kept == {d: below[2 * i : 2 * i + 2] for below, level in zip(want, want[1:]) for i, d in enumerate(level)}


def test_a_wrong_record_is_noticed(spark):
    import pyarrow as pa

    node = pa.table({"tree": ["t"] * 2, "rank": pa.array([0, 1], pa.int64()), "n": pa.array([2, 2], pa.int64()), "digest": ["a", "b"]})
    segment = manifest._segment(node).append_column("path", pa.array([[]], pa.list_(pa.string())))
    assert manifest._descent(node, segment).column("path").to_pylist() == [[">b"], ["<a"]]
    with pytest.raises(ValueError):
        manifest._descent(node.set_column(3, "digest", pa.array(["a", "c"])), segment)


def test_against_sql(spark):
    given = rows(200, seed=6)
    db = duckdb.connect()
    docs = spark.createDataFrame([(*r, 1, "clash", None) for r in given], SCHEMA)
    db.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert sorted(db.sql(f"SELECT {columns} FROM ({manifest.ORACLE_SQL})").fetchall(), key=str) == expected(given)
