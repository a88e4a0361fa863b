"""A Merkle manifest of a dataset: rows as leaves of binary trees, one tree to a group, and a tree of the groups' roots.

Inner nodes are records, digest to children, kept by segments of at most ``2 ** LEVELS`` leaves, so a task holds a segment and never
a tree. A proof is found by descent: a request follows the digits of its leaf's rank from the root down, record by record, and
takes the children it doesn't follow along. Requests of one segment share what was taken above it, so the upper segments
are walked once for each segment below, not once for each leaf. What a segment gave is turned round, and segments follow each
other from the leaf up to the root.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

#: Levels of a segment: it has at most 4,096 leaves, and as many records.
LEVELS = 12
#: Columns of a document's leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "tree string, block long, n long, digest string, records array<struct<digest: string, children: array<string>>>"


class Manifest(NamedTuple):
    """Ranked leaves (tree, rank, n, digest, and what came with them), segments by level, and roots of the trees (tree, root)."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def h(*inputs: Column) -> Column:
    """Lowercase hexadecimal sha256 of strings, one behind the other."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: of each value its length in UTF-8 bytes, a colon, and itself as a string; a null is a dash."""
    texts = [v.cast("string") for v in values]
    return h(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add rank (from 0, gapless within ``tree``, in the order of ``order``, nulls first) and n (the tree's size) to materialized rows.

    Rows are dealt by ranges of tree and order, so no task has a whole tree; equal rows are told apart by their place, so not
    even they meet in one. Partitions are counted, and running totals become offsets. A tree has one total for each partition.
    """
    by = [F.col(f"`{c}`").asc_nulls_first() for c in (*order, "_place")]
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(F.col("tree"), *by)
    dealt = checkpoint(dealt.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.select("tree", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("n"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*by)) - 1)
    return own.join(totals, ["tree", "_part"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_part", "_place", "_own", "_before")


def height(n: int) -> int:
    """Levels of inner nodes over n nodes."""
    return max(n - 1, 0).bit_length()


def _segment(table: pa.Table) -> pa.Table:
    """One segment's records and root, from its nodes."""
    order = table.sort_by("rank")
    tree, n, nodes = order.column("tree")[0].as_py(), order.column("n")[0].as_py(), order.column("digest").to_pylist()
    digests, children = [], []
    for _ in range(min(LEVELS, height(n))):
        above = []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            above.append(hashlib.sha256("".join(pair).encode()).hexdigest())
            digests.append(above[-1])
            children.append(pair)
        nodes = above
    block = order.column("rank")[0].as_py() >> LEVELS
    records = pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(children, pa.list_(pa.string()))], ["digest", "children"])
    whole = pa.ListArray.from_arrays(pa.array([0, len(records)], pa.int32()), records)
    return pa.table({"tree": [tree], "block": pa.array([block], pa.int64()), "n": pa.array([((n - 1) >> LEVELS) + 1], pa.int64()), "digest": nodes, "records": whole})


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ranked leaves (tree, rank, n, digest). Each level of segments is written once; there is one level for every
    ``LEVELS`` levels of the largest tree."""
    nodes, levels, roots = leaves.select("tree", "rank", "n", "digest"), [], []
    while True:
        blocks = nodes.withColumn("block", F.shiftright("rank", LEVELS)).groupBy("tree", "block")
        level = checkpoint(blocks.applyInArrow(_segment, SEGMENT))
        levels.append(level)
        roots.append(level.filter("n = 1").select("tree", F.col("digest").alias("root")))
        nodes = level.filter("n > 1").select("tree", F.col("block").alias("rank"), "n", "digest")
        if nodes.isEmpty():
            break
    every = roots[0]
    for more in roots[1:]:
        every = every.union(more)
    return Manifest(leaves, levels, every)


def records(manifest: Manifest) -> DataFrame:
    """All records of a manifest: digest and children. Equal subtrees are one record."""
    every = manifest.levels[0]
    for level in manifest.levels[1:]:
        every = every.union(level)
    return every.select(F.explode("records").alias("r")).select("r.*").dropDuplicates(["digest"])


def _descent(requests: pa.Table, segments: pa.Table) -> pa.Table:
    """Requests of one segment with their paths: what they didn't follow in it, turned round, then what lies above."""
    children = {r["digest"]: r["children"] for r in segments.column("records")[0].as_py()}
    root, above, levels = segments.column("digest")[0].as_py(), segments.column("path")[0].as_py(), min(LEVELS, height(requests.column("n")[0].as_py()))
    paths = []
    for rank, digest in zip(requests.column("rank").to_pylist(), requests.column("digest").to_pylist()):
        node, taken = root, []
        for level in range(levels - 1, -1, -1):
            below, digit = children[node], rank >> level & 1
            taken.append("-" if len(below) == 1 else "<" + below[0] if digit else ">" + below[1])
            node = below[digit]
        if node != digest:
            raise ValueError(f"the record of rank {rank} leads to another node")
        paths.append(taken[::-1] + above)
    return requests.append_column("path", pa.array(paths, pa.list_(pa.string())))


def proofs(manifest: Manifest, tops: DataFrame) -> DataFrame:
    """The leaves of a manifest with ``path``, an entry for each level from the leaf up: ``<`` and the digest of the sibling on the
    left, ``>`` and that of one on the right, or ``-`` without one. ``tops`` has tree and path, what lies above its root."""
    frontier = None
    for at in range(len(manifest.levels) - 1, -1, -1):
        level = manifest.levels[at]
        own = level.filter("n = 1").join(tops, "tree")
        segments = own if frontier is None else own.unionByName(level.drop("digest").join(frontier, ["tree", "block"]))
        below = manifest.leaves if not at else manifest.levels[at - 1].filter("n > 1").select("tree", F.col("block").alias("rank"), "n", "digest")
        requests = below.withColumn("block", F.shiftright("rank", LEVELS))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
        found = requests.groupBy("tree", "block").cogroup(segments.groupBy("tree", "block")).applyInArrow(_descent, f"{fields}, path array<string>")
        frontier = found.select("tree", F.col("rank").alias("block"), "digest", "path") if at else found.drop("block")
    return frontier


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and a path lead to."""
    side, other = (lambda s: F.left(s, F.lit(1))), (lambda s: F.substr(s, F.lit(2)))
    step = lambda own, s: F.when(side(s) == "<", h(other(s), own)).when(side(s) == ">", h(own, other(s))).otherwise(h(own))
    return F.aggregate(path, digest, step)


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings on a path, from the leaf up."""
    return h(F.array_join(F.transform(F.filter(path, lambda s: s != "-"), lambda s: F.substr(s, F.lit(2))), ""))


def audit(docs: DataFrame, key: str = "doc_id", group: str = "lang", changed: str = "n_chars", columns: tuple[str, ...] = LEAF_COLUMNS) -> DataFrame:
    """Build the manifest of a table, tamper with some rows, and hold every row's proof against the root.

    A tree for each value of ``group``, its leaves by key; the trees' roots, by group, form the tree of the dataset. Where 7 divides the
    unsigned crc32 of the key in decimal, the row to verify has one more in ``changed``. Returns a row for each input row: key, leaf,
    subroot, root, proof_sha256, folded_root, verified.

    Nulls: a null group is a tree of its own, the first; null keys come first in their tree and aren't tampered with; a null in ``changed``
    stays. Rows of one key are ordered by their digest; repeated rows are leaves of their own. An empty table gives an empty table;
    other columns are neither hashed nor returned. Only digests and keys are shuffled, no texts.
    """
    value = {c: F.col(f"`{c}`") for c in {*columns, key, group, changed}}
    tampered = (value[changed].cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    hit = F.coalesce(F.crc32(value[key].cast("string").cast("binary")) % 7 == 0, F.lit(False)) & value[changed].isNotNull()
    own = leaf(*(value[c] for c in columns))
    other = leaf(*(tampered if c == changed else value[c] for c in columns))
    # the tree's name sorts as the group does, a null first
    slim = docs.select(value[key].alias("key"), F.coalesce(F.concat(F.lit("+"), value[group].cast("string")), F.lit("")).alias("tree"), own.alias("digest"), F.when(hit, other).alias("tampered"))
    leaves = checkpoint(ranked(checkpoint(slim), ["key", "digest"]))
    trees = build(leaves)
    tops = checkpoint(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")))
    whole = build(checkpoint(ranked(tops, ["of"])))
    above = proofs(whole, whole.roots.select("tree", F.array().cast("array<string>").alias("path")))
    first = whole.roots.first()  # one digest
    root = F.lit(first["root"] if first else None).cast("string")
    found = proofs(trees, above.select(F.col("of").alias("tree"), "path"))
    folded = fold(F.coalesce("tampered", "digest"), F.col("path"))
    proved = found.join(trees.roots.withColumnRenamed("root", "subroot"), "tree").select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The same in the checking engine: whole levels by recursion, siblings by their place in a level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    joined = lambda change: " || ".join(field("(n_chars + 1)" if change and c == "n_chars" else c) for c in LEAF_COLUMNS)
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    bits = "flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce({bits}, lambda c, x: {step}, 4294967295::BIGINT), 4294967295)"
    tree = lambda nodes, name: f"""{name}(tree, level, i, n, d) AS (SELECT tree, 0, i, n, d FROM {nodes}
  UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2, n)"""  # noqa: E731
    sibling = lambda name: f"SELECT a.tree, a.i, b.level, CASE WHEN s.d IS NULL THEN '-' WHEN s.i < b.i THEN '<' || s.d ELSE '>' || s.d END AS s FROM {name} a JOIN {name} b ON a.level = 0 AND b.n > 1 AND b.tree = a.tree AND b.i = a.i >> b.level LEFT JOIN {name} s ON s.tree = b.tree AND s.level = b.level AND s.i = xor(b.i, 1)"
    up = "CASE s[1] WHEN '<' THEN sha256(s[2:] || a) WHEN '>' THEN sha256(a || s[2:]) ELSE sha256(a) END"
    return f"""WITH RECURSIVE rows_ AS MATERIALIZED (SELECT doc_id, coalesce('+' || lang, '') AS tree, sha256({joined(False)}) AS d, CASE WHEN n_chars IS NOT NULL AND {crc} % 7 = 0 THEN sha256({joined(True)}) END AS t FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
{tree("leaves", "nodes")},
subroots AS MATERIALIZED (SELECT tree AS of, d AS subroot FROM nodes WHERE n = 1),
ranked AS MATERIALIZED (SELECT '' AS tree, of, subroot AS d, row_number() OVER (ORDER BY of) - 1 AS i, count(*) OVER () AS n FROM subroots),
{tree("ranked", "tops")},
lower_ AS ({sibling("nodes")}), upper_ AS ({sibling("tops")}),
siblings AS (SELECT tree, i, level, s FROM lower_ UNION ALL SELECT l.tree, l.i, 1000 + u.level, u.s FROM leaves l JOIN ranked r ON r.of = l.tree JOIN upper_ u ON u.i = r.i),
paths AS (SELECT tree, i, list(s ORDER BY level) AS path, string_agg(s[2:], '' ORDER BY level) AS others FROM siblings GROUP BY tree, i)
SELECT doc_id, d AS leaf, subroot, root, sha256(coalesce(others, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM (
  SELECT l.doc_id, l.d, x.subroot, (SELECT d FROM tops WHERE n = 1) AS root, p.others, list_reduce(coalesce(p.path, []), lambda a, s: {up}, coalesce(l.t, l.d)) AS folded
  FROM leaves l JOIN subroots x ON x.of = l.tree LEFT JOIN paths p ON p.tree = l.tree AND p.i = l.i)"""


ORACLE_SQL = _sql()
