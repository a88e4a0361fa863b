"""Near-duplicate documents by a chosen-path set similarity join, confirmed on whole shingle sets.

Documents branch into the children of a tree node by selected minwise tokens: each root selects ``ROOT_BRANCH`` coordinates of
the signature, each inner node ``BRANCH`` paths of ``WIDTH`` coordinates, and a document goes to the children of the values it
has there. ``TREES`` independent trees are grown together, a level at a time; each tree has minwise values of its own at each
level. A node that is small is compared exhaustively and is done; a larger one branches again. Two documents of similarity 0.75
share at least one leaf of a tree with probability 0.79 at the last level (0.94 if the tree is one level deep), so the trees
together miss such a pair with a probability of 2e-3 at most (2e-5 if they are one level deep; sketches refuse another 2e-4),
and more similar ones less often (2e-4 at 0.8); documents that share only a passage, of similarity 0.3, lose nine tenths of their common
nodes with each level.

Three things keep large groups cheap. Equal shingle sets are one class from the start. Documents that links already join share
a label: nodes with a single label are done, and elsewhere only documents of different labels are compared, which loses no
component. And a pair is handed out by the first of the nodes that compare it only, if its sketches are alike.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import checkpoint, slices
from .words import Words, _mix_int

#: Trees, coordinates that a root selects, paths and their coordinates that an inner node selects, and the level at which
#: whatever is left is compared exhaustively.
TREES, ROOT_BRANCH, BRANCH, WIDTH, LEVELS = 4, 2, 4, 3, 5
#: Coordinates of a tree at each level below its root.
POOL = 16
#: A node is small if its pairs across labels are at most this many to a member: some 1,000 members if all are apart.
PAIRS_A_MEMBER = 512
#: Members of a node that one task compares with those outside its main label.
BLOCK = 512
#: Sketches have four bits of each of SKETCHED minwise values. Pairs that differ in more than MOST_UNEQUAL are no candidates: at
#: similarity 0.75 a pair differs in 120 on average, with a deviation of 9.6.
SKETCHED, MOST_UNEQUAL = 512, 154
LONGS = SKETCHED // 16
#: What is looked at first: so many numbers of a sketch, in which 15 coordinates differ on average, with a deviation of 3.4.
GLANCE, MOST_AT_A_GLANCE = 4, 30
#: Pairs whose sets are compared in one group.
CELL = 4096
#: Keys up to this many (some 30 MB in a hash table) are sent to all executors; more are joined by shuffling.
BROADCAST_KEYS = 1_000_000

_multipliers = lambda first, n: np.array([_mix_int(50_000 + first + k) | 1 for k in range(n)], np.uint64)
_ROOTS, _SKETCHES, _DEEP = _multipliers(0, TREES * ROOT_BRANCH), _multipliers(1000, SKETCHED), _multipliers(10_000, (LEVELS - 1) * TREES * POOL)
_SKETCH = [f"s{k}" for k in range(LONGS)]


def semi_or_anti(docs: DataFrame, keys: DataFrame, n_keys: int, key: str, how: str) -> DataFrame:
    """Rows of ``docs`` whose key is (left_semi) or isn't (left_anti) among ``n_keys`` keys. A broadcast spares the shuffle of the
    texts, but only up to BROADCAST_KEYS keys; beyond, it is a shuffle join."""
    return docs.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, key, how)


def _shingled(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, shingles, and where each row's begin (one more at the end), of some rows (key, text) at a time."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    for a, b in slices(texts):
        yield batch.column(0).slice(a, b - a), *Words(texts[a:b], lower=True).shingles(size)


def _least(found: np.ndarray, first: np.ndarray, full: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    """A minwise value of each of the rows ``full``, which have shingles."""
    return np.minimum.reduceat((found * multiplier) >> np.uint64(32), first[full])


def _integers(values: np.ndarray) -> pa.Array:
    """Rows of a matrix of 32 bits as lists."""
    return pa.FixedSizeListArray.from_arrays(pa.array(values.view(np.int32).ravel()), values.shape[1]).cast(pa.list_(pa.int32()))


def _signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id, n_shingles, digest (equal for equal sets), roots, sketch (LONGS numbers) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found, first in _shingled(batch, size):
                n, counts = len(ids), np.diff(first)
                full = np.flatnonzero(counts)
                roots, sketch = np.zeros((n, len(_ROOTS)), np.uint32), np.zeros((n, LONGS), np.uint64)
                if len(full):
                    for k, multiplier in enumerate(_ROOTS):
                        roots[full, k] = _least(found, first, full, multiplier)
                    for k, multiplier in enumerate(_SKETCHES):
                        # four bits that depend on the whole value, sixteen values to a long
                        nibble = (_least(found, first, full, multiplier) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
                        sketch[full, k // 16] |= nibble << np.uint64(4 * (k % 16))
                digest = [hashlib.md5(found[first[i] : first[i + 1]].tobytes()).digest() for i in range(n)]
                longs = [pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in range(LONGS)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts.astype(np.int64)), pa.array(digest, pa.binary()), _integers(roots), *longs],
                    names=["id", "n_shingles", "digest", "roots", *_SKETCH],
                )

    slim = docs.select(F.col(key), F.col(text))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_shingles long, digest binary, roots array<int>" + "".join(f", {c} long" for c in _SKETCH))


def _deep(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id and the minwise values that nodes below the roots select, of rows with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found, first in _shingled(batch, size):
                full = np.flatnonzero(np.diff(first))
                if len(full):
                    values = np.stack([_least(found, first, full, multiplier).astype(np.uint32) for multiplier in _DEEP], axis=1)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(full)), _integers(np.ascontiguousarray(values))], names=["id", "deep"])

    slim = docs.select(F.col(key), F.col(text))
    return slim.mapInArrow(run, f"id {slim.schema[0].dataType.simpleString()}, deep array<int>").dropDuplicates(["id"])


def _sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id and the whole shingle set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found, first in _shingled(batch, size):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, lists], names=["id", "shingles"])

    slim = docs.select(F.col(key), F.col(text))
    return slim.mapInArrow(run, f"id {slim.schema[0].dataType.simpleString()}, shingles array<long>").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole shingle sets have a similarity of ``percent`` or more.

    Pairs are dealt into cells by the blocks of both ids, and a crowded cell is dealt once more, so a cell has some CELL pairs,
    also if all pairs share one id. A set is sent to each cell that needs it once, not once for each pair.
    """
    pairs = checkpoint(pairs)
    n = pairs.count()
    ids = pairs.select(F.col("a").alias(key)).union(pairs.select(F.col("b").alias(key))).distinct()
    blocks = F.lit(max(1, math.isqrt(n // CELL)))
    dealt = pairs.withColumns({"i": F.pmod(F.xxhash64("a"), blocks), "j": F.pmod(F.xxhash64("b"), blocks)})
    crowded = dealt.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    placed = checkpoint(dealt.join(crowded, ["i", "j"]).select(F.xxhash64("i", "j", F.pmod(F.xxhash64("a", "b"), "parts")).alias("cell"), "a", "b"))
    needed = placed.select(F.col("cell").alias("into"), F.col("a").alias("id")).union(placed.select("cell", "b")).distinct()
    sets = _sets(semi_or_anti(docs.select(F.col(key), F.col(text)), ids, 2 * n, key, "left_semi"), key, text, size)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        place = {name: k for k, name in enumerate(right.column("id").to_pylist())}
        lists = [part for chunk in right.column("shingles").chunks for part in np.split(chunk.values.to_numpy(), chunk.offsets.to_numpy()[1:-1])] if place else []
        keep = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            x, y = lists[place[a]], lists[place[b]]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return placed.groupBy("cell").cogroup(needed.join(sets, "id").groupBy("into")).applyInArrow(compare, f"a {kind}, b {kind}")


def _unequal(longs: int = LONGS) -> Column:
    """In how many coordinates two sketches (columns s0 to ..., and the same with x_ before), or their first numbers, differ."""

    def one(name: str) -> Column:
        x = F.col(name).bitwiseXOR(F.col(f"x_{name}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(lambda x, y: x + y, map(one, _SKETCH[:longs]))


def _alike() -> Column:
    return (_unequal(GLANCE) <= MOST_AT_A_GLANCE) & (_unequal() <= MOST_UNEQUAL)


def _met(done: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) across labels with similar sketches among the members of the nodes ``done`` (node, id, label, main, blocks):
    documents outside a node's main label, each with all others. Of several nodes with one pair the least hands it out."""
    places = F.array_sort(F.collect_list(F.struct("node", "main", "blocks")))
    own = done.groupBy("id").agg(F.first("label").alias("label"), places.alias("own")).join(sketches, "id")
    each = own.withColumn("nodes", F.transform("own", lambda o: o["node"])).withColumn("at", F.explode("own")).drop("own").select("*", "at.*").drop("at")
    y = each.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks")
    x = each.filter("label != main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "main")
    x = x.select("node", "block", *(F.col(c).alias(f"x_{c}") for c in ("id", "label", "nodes", *_SKETCH)))
    once = F.expr("label != x_label AND (label = main OR x_id < id)") & _alike() & (F.array_min(F.array_intersect("nodes", "x_nodes")) == F.col("node"))
    return x.join(y, ["node", "block"]).filter(once).select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``percent`` / 100 of their sets of ``size``-word shingles.

    Returns a row per input row: key, n_shingles, component_id (least key that links reach, its own included), kept (whether
    that is its own). Null and empty texts and texts without words have no shingles and are linked with nothing. The key names
    a document: rows with equal keys are the same document and have the same component. A row with a null key is linked with
    nothing: its component is null and it is kept. An empty table gives an empty table; other columns are dropped.
    """
    rows = checkpoint(_signatures(docs, key, text, size))
    usable = rows.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = checkpoint(usable.groupBy("digest").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("roots", *_SKETCH))))
    sketches = classes.select("id", *_SKETCH)

    # the roots: each of the trees selects coordinates of its own
    roots = classes.select("id", F.posexplode("roots").alias("pos", "value"))
    roots = roots.select("id", F.floor(F.col("pos") / ROOT_BRANCH).cast("int").alias("tree"), F.xxhash64("pos", "value").alias("node"))
    shared = roots.groupBy("node").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = checkpoint(roots.join(shared, "node").select("node", "tree", "id", "pivot"))

    # first links: each document with the least of its node-mates, if they meet in two nodes at least
    met = members.filter("id != pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    star = met.groupBy("id").agg(F.max_by("pivot", "n").alias("pivot")).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    links = checkpoint(_confirmed(star, docs, key, text, size, percent))
    labels = checkpoint(connected(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    # nodes with several labels, and how their members are labelled
    def labelled(nodes: DataFrame) -> DataFrame:
        named = nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        counts = named.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
        mixed = counts.groupBy("node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count(F.lit(1)).alias("labels"), F.max_by("label", "c").alias("main"))
        small = F.expr(f"(n * n - q) / 2 <= {PAIRS_A_MEMBER} * n")
        mixed = mixed.filter("labels > 1").select("node", small.alias("small"), "main", F.ceil(F.col("n") / BLOCK).alias("blocks"))
        return checkpoint(named.join(mixed, "node"))

    # then whatever the trees bring together under different labels
    candidates: list[DataFrame] = []
    level, nodes, deep = 1, members.select("node", "tree", "id"), None
    while True:
        found = labelled(nodes)
        candidates.append(_met(found if level == LEVELS else found.filter("small"), sketches))
        large = found.filter(~F.col("small")).select("node", "tree", "id")
        if level == LEVELS or large.isEmpty():
            break
        level += 1
        if deep is None:
            ids = checkpoint(large.select(F.col("id").alias(key)).distinct())
            deep = checkpoint(_deep(semi_or_anti(docs.select(F.col(key), F.col(text)), ids, ids.count(), key, "left_semi"), key, text, size))
        pool = (F.lit((level - 2) * TREES) + F.col("tree")) * POOL
        at = lambda k, pool=pool: (pool + F.pmod(F.xxhash64("node", "path", F.lit(k)), F.lit(POOL))).cast("int") + 1
        chosen = large.join(deep, "id").withColumn("path", F.explode(F.array(*map(F.lit, range(BRANCH)))))
        children = chosen.select("id", "tree", F.xxhash64("node", "path", *(F.element_at("deep", at(k)) for k in range(WIDTH))).alias("node"))
        lone = children.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
        nodes = checkpoint(children.join(lone, "node", "left_semi").select("node", "tree", "id"))
    more = reduce(DataFrame.union, candidates).distinct()
    every = links.union(checkpoint(_confirmed(more, docs, key, text, size, percent)))
    component = connected(every.select(F.col("a").alias("u"), F.col("b").alias("v")))

    named = usable.groupBy("digest").agg(F.min("id").alias("id")).join(component, "id", "left")
    of_class = named.select("digest", F.coalesce("label", "id").alias("component_id"))
    out = rows.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    out = out.join(of_class, "digest", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
