"""Dealing documents into shards of nearly equal bytes by best-fit-decreasing, groups of equal texts kept whole."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, number_rows

#: Different sizes of groups up to this many are sent to all executors (some 60 MB); more are joined by shuffling.
BROADCAST_SIZES = 1_000_000


class Bins:
    """Open bins by remaining capacity in a balanced tree (a treap with fixed pseudo-random priorities)."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.seed = 1

    def add(self, remaining: int, bin_id: int) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        key, priority = (remaining, bin_id), self.seed >> 16
        link, parent, side = self.root, None, 0
        while link is not None and link[1] >= priority:
            side = 2 if key < link[0] else 3
            parent, link = link, link[side]
        node = [key, priority, *self._split(link, key)]
        if parent is None:
            self.root = node
        else:
            parent[side] = node

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _join(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that holds ``size``."""
        best, node = None, self.root
        while node is not None:
            if node[0][0] >= size:
                best, node = node, node[2]
            else:
                node = node[3]
        if best is None:
            return None
        self._remove(best[0])
        return best[0]

    def _remove(self, key: tuple) -> None:
        node, parent, side = self.root, None, 0
        while node[0] != key:
            parent, side = node, 2 if key < node[0] else 3
            node = node[side]
        joined = self._join(node[2], node[3])
        if parent is None:
            self.root = joined
        else:
            parent[side] = joined


def best_fit_decreasing(counts: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Put ``counts`` (size, number of items of that size), none over ``capacity``, into as few bins as best-fit-decreasing needs.

    Returns runs (size, first, n, bin): items number first to first + n - 1 of a size go to the bin; and the number of bins. A
    bin that has taken an item is still the tightest one for the next of the same size while it has room, since all others
    with room have more: so a run enters at once, with the result of one item at a time.
    """
    bins, runs, opened = Bins(), [], 0
    for size, count in sorted(counts, reverse=True):
        first = 0
        while first < count:
            found = bins.take_tightest(size)
            if found is None:
                found = (capacity, opened)
                opened += 1
            n = min(count - first, found[0] // size)
            runs.append((size, first, n, found[1]))
            bins.add(found[0] - n * size, found[1])
            first += n
    return runs, opened


def least_capacity(counts: dict[int, int], n_bins: int) -> list[tuple[int, int, int, int]]:
    """Runs, as of ``best_fit_decreasing``, of all items in bins 0 to n_bins - 1, with the least capacity found at which it needs
    no more bins. An item over the mean of what is left fills a bin of its own first."""
    own, taken, left = [], {}, n_bins
    total = sum(size * n for size, n in counts.items())
    for size in sorted(counts, reverse=True):
        used = 0
        while used < counts[size] and left > 1 and size * left > total:
            left -= 1
            own.append((size, used, 1, left))
            total -= size
            used += 1
        taken[size] = used
        if used < counts[size]:
            break
    rest = [(size, n - taken.get(size, 0)) for size, n in counts.items() if n > taken.get(size, 0)]
    if not rest:
        return own

    def fitted(capacity: int) -> list[tuple[int, int, int, int]] | None:
        runs, opened = best_fit_decreasing(rest, capacity)
        return runs if opened <= left else None

    # capacities further and further over the mean, and then between the last two; at twice the larger of mean and largest
    # item, all bins but one would be filled over the mean before one more is opened, so the search ends
    low = high = least = max(-(-total // left), max(rest)[0])
    slack, best = 1e-6, fitted(least)
    while best is None:
        low, high = high, int(least * (1 + slack)) + 1
        slack *= 3
        best = fitted(high)
    for _ in range(12):
        if high - low < 2:
            break
        between = (low + high) // 2
        found = fitted(between)
        if found is None:
            low = between
        else:
            best, high = found, between
    return own + [(size, first + taken.get(size, 0), n, b) for size, first, n, b in best]


def assign_shards(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal all documents into ``n_shards`` shards with nearly equal bytes; rows with equal texts share a shard.

    Each group of equal texts is an item of best-fit-decreasing, which needs the number of groups of each size only: that
    histogram comes to the driver, with at most sqrt(2 * all bytes) sizes, as different sizes add up. A group finds its
    shard by its number within its size.

    Returns key, size (UTF-8 bytes plus 16), text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard), grown_shard
    (null: that is for law 'key'). A null text counts as an empty one and shares its group; a null key is dealt as any other;
    repeated rows stay rows of one group; an empty table gives an empty table; other columns are dropped.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = checkpoint(
        docs.select(
            F.col(key).alias("_key"), (F.octet_length(value) + F.lit(16)).cast("long").alias("_bytes"), F.crc32(value.cast("binary")).alias("_crc"),
            F.unhex(F.sha2(value, 256)).alias("_text"), F.monotonically_increasing_id().alias("_at"),
        )
    )
    groups = checkpoint(rows.groupBy("_text").agg(F.sum("_bytes").alias("_group_bytes"), F.count(F.lit(1)).alias("_n")))
    sizes = checkpoint(groups.groupBy("_group_bytes").agg(F.count(F.lit(1)).alias("_size"), F.sum("_n").alias("_rows")))
    found = sizes.toArrow()
    counts = dict(zip(found.column("_group_bytes").to_pylist(), found.column("_size").to_pylist()))
    n_groups, n_rows = sum(counts.values()), sum(found.column("_rows").to_pylist())
    table = [pa.array(column, pa.int64()) for column in zip(*least_capacity(counts, n_shards))] or [pa.array([], pa.int64())] * 4
    runs = spark.createDataFrame(pa.Table.from_arrays(table, names=["_group_bytes", "_first", "_taken", "_shard"]))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if len(counts) <= BROADCAST_SIZES else df

    # a group's number within its size, and the shard whose run has it
    sized = groups.join(small(sizes.select("_group_bytes", "_size")), "_group_bytes")
    numbered = number_rows(sized, "_group_bytes", [F.col("_text")], "_number", F.xxhash64("_text"), F.lit(max(64, n_groups // 4096)), len(counts) <= BROADCAST_SIZES)
    within = F.expr("g._group_bytes = r._group_bytes AND _number >= _first AND _number < _first + _taken")
    placed = checkpoint(numbered.alias("g").join(small(runs).alias("r"), within).select("_text", "_n", F.col("_shard").cast("int").alias("shard")))
    # rows of frequent texts, of which there are at most 4096, find their shard without a shuffle
    often = F.col("_n") > F.lit(max(1, n_rows // 4096))
    frequent = F.broadcast(placed.filter(often).select("_text", "shard"))
    rare = rows.join(frequent.drop("shard"), "_text", "left_anti").join(placed.filter(~often).select("_text", "shard"), "_text")
    dealt = rows.join(frequent, "_text").select("_key", "_bytes", "_crc", "_at", "shard")
    dealt = checkpoint(dealt.union(rare.select("_key", "_bytes", "_crc", "_at", "shard")))
    of_shard = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("_size"))
    slots = number_rows(dealt.join(F.broadcast(of_shard), "shard"), "shard", [F.col("_at")], "slot", F.xxhash64("_at"), F.lit(max(64, n_rows // 4096)))
    return slots.select(
        F.col("_key").alias(key), F.col("_bytes").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
