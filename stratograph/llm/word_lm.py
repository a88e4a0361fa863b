"""Word bigram models of a whole corpus, of one or many groups of documents: counted by Spark, estimated by modified Kneser-Ney.

Words of all groups share one vocabulary, its size bounded by VOCABULARY; what is known of words fits an executor. Pairs of words
grow with the corpus and are gathered nowhere: each bucket of pairs is a sorted array of codes with counts, and documents meet
the buckets in a shuffle. What is shuffled are sorted arrays too, a row for what a slice of some documents has in one bucket.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, frugal, slices, texts_of
from .words import _BASE, _INVERSE, _powers, mix

#: The commonest words of all groups that have a number of their own; others are their group's unknown word.
VOCABULARY = 1 << 20
#: Groups with models of their own, those of most documents; others share one.
GROUPS = 1 << 16
#: Bits of a number: words, then for each group its unknown word and the start of a text.
BITS = 21
#: Words of the corpus to a bucket of pairs, and the commonest pairs, which are scored where they are met.
BUCKET, HOT_PAIRS = 1 << 21, 1 << 20
#: Leading bits of a word's hash that tell its bucket when words are counted, at least (see ``word_bits``), and distinct words
#: (or pairs) that a task gathers before it sends them.
WORD_BITS, GATHERED = 8, 1 << 20
#: Bytes of which pairs are put together, and characters of which words are found together (a longer text is taken whole).
SLICE, PIECE = 1 << 21, 1 << 19
#: Signs that part words and are no words themselves, and scripts of which each character is a word.
PARTING = ".,;:!?'\"()[]/-–—…’‘“”«»、。，"
_ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each character, its class (0: parts words, 1: letter, mark or digit, 2: a word of its own) and its small letter."""
    kind, small = np.full(0x110000, 2, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        c = chr(i)
        category = unicodedata.category(c)
        kind[i] = 1 if category[0] in "LMN" else 0 if category[0] == "Z" or c in "\t\n\v\f\r" or c in PARTING else 2
        lower = c.lower()
        if len(lower) == 1:
            small[i] = ord(lower)
    for a, b in _ALONE:
        kind[a : b + 1] = np.where(kind[a : b + 1] == 0, 0, 2)
    return kind, small


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and where each text's begin (one more at the end), found a piece at a time."""
    parts = [_words(texts[i:j]) for i, j in slices(texts, PIECE)]
    starts = np.cumsum([0, *(len(found) for found, _ in parts)])
    first = [at + of[:-1] for at, (_, of) in zip(starts, parts)]
    return np.concatenate([np.zeros(0, np.int64), *(found for found, _ in parts)]), np.concatenate([*first, starts[-1:]])


def _words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 63-bit hash of each word, and where each text's words begin (one more at the end). Words are runs of letters, marks and
    digits of any script, in small letters; signs but those in PARTING, and characters of scripts without spaces, are words of
    their own."""
    kind, small = _tables()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(lengths)])
    of = kind[points]
    cut = np.ones(len(points) + 1, bool)
    cut[1:-1] = (of[1:] != of[:-1]) | (of[1:] == 2)
    cut[first] = True
    edges = np.flatnonzero(cut)
    begin, end = edges[:-1], edges[1:]
    begin, end = begin[of[begin] > 0], end[of[begin] > 0]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((small[points].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * _powers(_BASE, len(points)), out=sums[1:])
    found = mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(points) + 1)[begin] ^ (end - begin).astype(np.uint64) << np.uint64(48))
    return (found >> np.uint64(1)).astype(np.int64), np.searchsorted(begin, first)


def _of_groups(found: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Hashes of words of groups: a word is another one in another group; in group 0 it keeps its hash."""
    return np.where(groups == 0, found, (mix(found.astype(np.uint64) ^ mix(groups.astype(np.uint64))) >> np.uint64(1)).astype(np.int64))


def word_bits(characters: int) -> int:
    """A bucket of words has what some 2^29 characters have, so its size does not grow with the corpus."""
    return max(WORD_BITS, (characters >> 29).bit_length())


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and which of them are there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


# arrays as compressed bytes


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def seal(x: np.ndarray) -> bytes:
    """Numbers from 0, by planes of their bytes."""
    used = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8).T[:used]
    return struct.pack("<IB", len(x), used) + _codec()[0].compress(planes.tobytes())


def unseal(data: bytes) -> np.ndarray:
    n, used = struct.unpack_from("<IB", data)
    out = np.zeros((n, 8), np.uint8)
    if n and used:
        out[:, :used] = np.frombuffer(_codec()[1].decompress(data[5:]), np.uint8).reshape(used, n).T
    return out.view(np.int64).ravel()


def _segments(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.concatenate([[0], 1 + np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]), [len(sorted_keys)]])
    return zip(edges[:-1].tolist(), edges[1:].tolist()) if len(sorted_keys) else iter(())


class Lexicon:
    """Numbers of words: 0 to size - 1 by hash, then an unknown word for each group, then the start of a text for each group. An
    unknown word stands for as many words as the group has without a number: ``rare``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, groups: np.ndarray, rare: np.ndarray, total: int) -> None:
        n_groups, self.log_rare = len(rare), np.log(np.maximum(rare, 1))
        self.hashes, self.size, self.n_groups = hashes, len(hashes), n_groups
        self.group = np.concatenate([groups, np.arange(n_groups), np.arange(n_groups)]).astype(np.int32)
        self.buckets = max(1, -(-total // BUCKET))
        #: Words whose pairs would crowd one bucket: their pairs are dealt by both words.
        self.crowded = np.concatenate([counts > BUCKET // 4, np.ones(2 * n_groups, bool)])

    def pairs(self, texts: Sequence[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each word and the one before it, and where each text's begin (one more at the end)."""
        found, first = words(texts)
        n = np.diff(first)
        of = np.repeat(groups, n)
        distinct, place = np.unique(_of_groups(found, of) if self.n_groups > 1 else found, return_inverse=True)
        at, known = _find(self.hashes, distinct)
        number = np.where(known, at, -1)[place]
        c = np.where(number >= 0, number, self.size + of)
        b = np.zeros_like(c)
        b[1:] = c[:-1]
        b[first[:-1][n > 0]] = self.size + self.n_groups + groups[n > 0]
        return b << BITS | c, first

    def bucket(self, code: np.ndarray) -> np.ndarray:
        b = code >> BITS
        return (mix(np.where(self.crowded[b], code, b).astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)


def _threshold(counted: DataFrame, most: int, least: int) -> int:
    """The least n, ``least`` or more, so that at most ``most`` rows have as much; of equal ones all or none are taken."""
    rows = counted.filter(F.col("n") >= least).groupBy("n").agg(F.sum("rows").alias("rows")).toArrow().to_pydict()
    left = most
    for n, k in sorted(zip(rows["n"], rows["rows"]), reverse=True):
        left -= k
        if left < 0:
            return n + 1
    return least


def _discounts(of: Sequence[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    if not all(of):
        return [0.0, 0.5, 0.75, 0.9]
    y = of[0] / (of[0] + 2 * of[1])
    return [0.0, *(min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.0), k - 0.05) for k in (1, 2, 3))]


class Values:
    """What a model knows of words, by number: the probability of a word after unknown ones, how often it stands before another,
    and the weight of what follows it being unknown; and discounts by group."""

    def __init__(self, lexicon: Lexicon, tally: dict[str, np.ndarray]) -> None:
        group, before = lexicon.group, tally["before"]
        by_group = lambda weights: np.bincount(group, weights, lexicon.n_groups)
        self.group, self.size, self.log_rare = group, lexicon.size, lexicon.log_rare
        self.discounts = np.array([_discounts(of) for of in np.stack([by_group(tally[f"of{k}"]) for k in (1, 2, 3, 4)], 1)])
        d1 = np.array([_discounts(of) for of in np.stack([by_group(before == k) for k in (1, 2, 3, 4)], 1)])
        taken = d1[group, np.minimum(before, 3)]
        whole, left, size = by_group(before), by_group(taken), np.bincount(group[: lexicon.size], minlength=lexicon.n_groups) + 1
        seen = np.maximum(whole, 1)[group]
        self.p = ((before - taken) / seen + np.where(whole > 0, left / np.maximum(whole, 1), 1.0)[group] / size[group]).astype(np.float32)
        self.total = tally["total"]
        weight = sum(tally[f"of{k}"] * self.discounts[group, k] for k in (1, 2)) + tally["more"] * self.discounts[group, 3]
        self.back = np.where(self.total > 0, weight / np.maximum(self.total, 1), 1.0).astype(np.float32)

    def losses(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Minus log probabilities of the pairs with these codes, which the model has counted so often."""
        b, c = code >> BITS, code & (1 << BITS) - 1
        seen = (n - self.discounts[self.group[b], np.minimum(n, 3)]) / np.maximum(self.total[b], 1)
        known = -np.log(np.maximum(seen, 0.0) + self.back[b] * self.p[c].astype(np.float64))
        return np.where(c < self.size, known, known + self.log_rare[self.group[c]])


class Model:
    """Matched models on one vocabulary: "n" is counted over all of ``docs`` (those texts that ``among`` tells, if given), "t" over
    those of them where ``flag`` holds. With ``group``, each group of documents has models of its own."""

    def __init__(self, docs: DataFrame, text: str, flag: Column | None = None, group: Column | None = None, among: Callable[[list[str]], np.ndarray] | None = None) -> None:
        spark = docs.sparkSession
        self.spark, self.text, self.kinds = spark, text, "n" if flag is None else "nt"
        self.name = F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit(""))
        self.groups: dict[str, int] = {}
        if group is not None:
            top = docs.groupBy(self.name.alias("g")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g").limit(GROUPS - 1)
            self.groups = {r["g"]: k for k, r in enumerate(top.collect(), 1)}
        self.lexicon = self._vocabulary(docs)
        checkpoint(spark.range(1))  # sets a folder where the session names none
        folder = f"{spark.sparkContext.getCheckpointDir()}/word-lm-{uuid.uuid4().hex}"
        self._count(docs, flag, among).write.option("compression", "uncompressed").parquet(folder)
        self.pairs = spark.read.parquet(folder)
        tally = self._tally()
        self.values = {x: Values(self.lexicon, tally[x]) for x in self.kinds}

    def _of(self) -> Callable[[list[str]], np.ndarray]:
        groups = self.groups
        return lambda names: np.fromiter((groups.get(x, 0) for x in names), np.int64, len(names))

    def _vocabulary(self, docs: DataFrame) -> Lexicon:
        of, many = self._of(), bool(self.groups)
        rest = 63 - word_bits(docs.agg(F.sum(F.length(self.text).cast("long"))).first()[0] or 0)

        def sealed(found: np.ndarray, g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            bucket = found >> rest
            rows = [(int(bucket[a]), *(seal(x) for x in (np.diff(found[a:b], prepend=bucket[a] << rest), g[a:b], n[a:b]))) for a, b in _segments(bucket)]
            return pa.RecordBatch.from_pylist([dict(zip(("bucket", "w", "g", "n"), r)) for r in rows], schema)

        def added(found: np.ndarray, g: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
            found, at, place = np.unique(found, return_index=True, return_inverse=True)
            return [found, g[at], np.bincount(place, n, len(found)).astype(np.int64)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros(0, np.int64)] * 3
            for batch in batches:
                groups = of(batch.column(1).to_pylist())
                for i, j, texts in texts_of(batch.column(0), SLICE):
                    found, first = words(texts)
                    own = np.repeat(groups[i:j], np.diff(first))
                    found, at, n = np.unique(_of_groups(found, own) if many else found, return_index=True, return_counts=True)
                    held = added(*(np.concatenate(x) for x in zip(held, (found, own[at], n))))
                    if len(held[0]) >= GATHERED:
                        yield sealed(*held)
                        held = [np.zeros(0, np.int64)] * 3
            if len(held[0]):
                yield sealed(*held)

        def opened(bucket: int, w: bytes, g: bytes, n: bytes) -> list[np.ndarray]:
            return [(bucket << rest) + np.cumsum(unseal(w)), unseal(g), unseal(n)]

        def merge(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([sealed(*added(*(np.concatenate(x) for x in zip(*(opened(*r.values()) for r in table.to_pylist())))))])

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    _, g, n = opened(*r.values())
                    both, rows = np.unique(np.stack([g, n]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(rows.astype(np.int64))], names=["g", "n", "rows"])

        def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    arrays = opened(*r.values())
                    yield pa.RecordBatch.from_arrays([pa.array(x[arrays[2] >= least]) for x in arrays], names=["w", "g", "n"])

        schema, ddl = pa.schema([("bucket", pa.int64()), ("w", pa.binary()), ("g", pa.binary()), ("n", pa.binary())]), "bucket long, w binary, g binary, n binary"
        counted = checkpoint(docs.select(F.col(self.text), self.name).mapInArrow(frugal(run), ddl).groupBy("bucket").applyInArrow(merge, ddl))
        places = checkpoint(counted.mapInArrow(numbers, "g long, n long, rows long").groupBy("g", "n").agg(F.sum("rows").alias("rows")))
        least = _threshold(places, VOCABULARY, 2)
        total = places.agg(F.sum(F.col("n") * F.col("rows"))).first()[0] or 0
        rare = np.zeros(len(self.groups) + 1, np.int64)
        for r in places.filter(F.col("n") < least).groupBy("g").agg(F.sum("rows").alias("rows")).collect():
            rare[r["g"]] = r["rows"]
        top = counted.mapInArrow(common, "w long, g long, n long").toArrow()
        order = np.argsort(top.column("w").to_numpy())
        hashes, groups, n = (top.column(c).to_numpy()[order] for c in ("w", "g", "n"))
        return Lexicon(hashes, n, groups, rare, total)

    def _count(self, docs: DataFrame, flag: Column | None, among: Callable | None) -> DataFrame:
        """bucket, codes (ascending), n and t of each bucket of pairs."""
        of, lexicon = self._of(), self.spark.sparkContext.broadcast(self.lexicon)

        def added(codes: np.ndarray, n: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
            codes, place = np.unique(codes, return_inverse=True)
            return [codes, *(np.bincount(place, x, len(codes)).astype(np.int64) for x in (n, t))]

        def sealed(codes: np.ndarray, n: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
            bucket = lexicon.value.bucket(codes)
            order = np.argsort(bucket, kind="stable")
            rows = [(bucket[order[a]], *(seal(x) for x in (np.diff(codes[order[a:b]], prepend=0), n[order[a:b]], t[order[a:b]]))) for a, b in _segments(bucket[order])]
            return pa.RecordBatch.from_pylist([dict(zip(("bucket", "codes", "n", "t"), r)) for r in rows], schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros(0, np.int64)] * 3
            for batch in batches:
                names, flagged = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for i, j, texts in texts_of(batch.column(0), SLICE):
                    chosen = np.flatnonzero(among(texts)) if among else np.arange(j - i)
                    code, first = lexicon.value.pairs([texts[k] for k in chosen], of(names[i:j])[chosen])
                    distinct, place, n = np.unique(code, return_inverse=True, return_counts=True)
                    t = np.bincount(place, np.repeat(flagged[i:j][chosen], np.diff(first)), len(distinct)).astype(np.int64)
                    held = added(*(np.concatenate(x) for x in zip(held, (distinct, n, t))))
                    if len(held[0]) >= GATHERED:
                        yield sealed(*held)
                        held = [np.zeros(0, np.int64)] * 3
            if len(held[0]):
                yield sealed(*held)

        def merge(table: pa.Table) -> pa.Table:
            parts = [[unseal(x) for x in table.column(c).to_pylist()] for c in ("codes", "n", "t")]
            codes, n, t = added(np.concatenate([np.cumsum(x) for x in parts[0]]), *map(np.concatenate, parts[1:]))
            return pa.table([table.column("bucket").slice(0, 1), *(pa.array([seal(x)], pa.binary()) for x in (np.diff(codes, prepend=0), n, t))], schema)

        schema = pa.schema([("bucket", pa.int64()), ("codes", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])
        ddl = "bucket long, codes binary, n binary, t binary"
        slim = docs.select(F.col(self.text), self.name, F.coalesce(F.lit(False) if flag is None else flag, F.lit(False)).cast("long"))
        return slim.mapInArrow(frugal(run), ddl).groupBy("bucket").applyInArrow(merge, ddl)

    def counts(self) -> DataFrame:
        """code, n and t of all pairs, a row for each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for codes, n, t in zip(*(batch.column(c).to_pylist() for c in ("codes", "n", "t"))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(unseal(codes))), pa.array(unseal(n)), pa.array(unseal(t))], names=["code", "n", "t"])

        return self.pairs.select("codes", "n", "t").mapInArrow(run, "code long, n long, t long")

    def _tally(self) -> dict[str, dict[str, np.ndarray]]:
        """Of each number: how often it stands before a word, how many words follow it so often, and how many precede it."""
        kinds = self.kinds
        names = [f"{x}_{c}" for x in kinds for c in ("total", "of1", "of2", "of3", "of4", "more", "before")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for sealed, *counts in zip(*(batch.column(c).to_pylist() for c in ("codes", *kinds))):
                    code = np.cumsum(unseal(sealed))
                    for word, after in ((code >> BITS, True), (code & (1 << BITS) - 1, False)):
                        word, place = np.unique(word, return_inverse=True)
                        columns = []
                        for x in map(unseal, counts):
                            add = lambda weights, place=place, n=len(word): np.bincount(place, weights, n).astype(np.int64)
                            zero = np.zeros(len(word), np.int64)
                            columns += [add(x), *(add(x == k) for k in (1, 2, 3, 4)), add(x >= 3), zero] if after else [zero] * 6 + [add(x > 0)]
                        yield pa.RecordBatch.from_arrays([pa.array(word), *map(pa.array, columns)], names=["w", *names])

        rows = self.pairs.select("codes", *kinds).mapInArrow(run, "w long" + "".join(f", {c} long" for c in names))
        small = lambda c: F.sum(c).alias(c) if c.endswith("total") else F.sum(c).cast("int").alias(c)
        table = rows.groupBy(F.col("w").cast("int").alias("w")).agg(*map(small, names)).toArrow()
        out: dict[str, dict[str, np.ndarray]] = {x: {} for x in kinds}
        for c in names:
            dense = np.zeros(len(self.lexicon.group), np.int64)
            dense[table.column("w").to_numpy()] = table.column(c).to_numpy()
            out[c[0]][c[2:]] = dense
        return out

    def _hot(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Codes of the commonest pairs, ascending, and their losses."""

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for sealed in batch.column(0).to_pylist():
                    n, rows = np.unique(unseal(sealed), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(rows.astype(np.int64))], names=["n", "rows"])

        least = _threshold(self.pairs.select("n").mapInArrow(tally, "n long, rows long"), HOT_PAIRS, 2)
        table = self.counts().filter(F.col("n") >= least).toArrow()
        code = table.column("code").to_numpy()
        order = np.argsort(code)
        return code[order], [self.values[x].losses(code[order], table.column(x).to_numpy()[order]).astype(np.float32) for x in self.kinds]

    def losses(self, docs: DataFrame, key: str, facts: Callable[[list[str]], dict[str, np.ndarray]] | None = None, fact_names: Sequence[str] = ()) -> DataFrame:
        """Of every row of ``docs``: key, group (its number), n_tokens, loss_n (and loss_t), the sums of minus log probabilities of its
        words, and the ``facts`` (integers) that are asked of its text along the way."""
        of, kinds, names = self._of(), self.kinds, ["group", *fact_names]
        shared = docs.sparkSession.sparkContext.broadcast((self.lexicon, [self.values[x] for x in kinds], *self._hot()))
        slim = docs.select(F.col(key).alias("key"), F.col(self.text), self.name, F.monotonically_increasing_id())
        kind = slim.schema[0].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon, _, hot, hot_losses = shared.value
            for batch in batches:
                groups, row = of(batch.column(2).to_pylist()), batch.column(3).to_numpy()
                for i, j, texts in texts_of(batch.column(1), SLICE):
                    code, first = lexicon.pairs(texts, groups[i:j])
                    doc = np.repeat(np.arange(j - i), np.diff(first))
                    distinct, place = np.unique(code, return_inverse=True)
                    at, hit = _find(hot, distinct)
                    met = hit[place]
                    sums = np.stack([np.bincount(doc[met], x[at[place[met]]], j - i) for x in hot_losses]) if len(hot) else np.zeros((len(kinds), j - i))
                    told = [facts(texts[a:b]) for a, b in slices(texts, PIECE)] if facts else []
                    columns = np.stack([groups[i:j], *(np.concatenate([x[c] for x in told]) for c in fact_names)])
                    rest = np.flatnonzero(~met)
                    bucket = lexicon.bucket(distinct)[place[rest]]
                    order = np.argsort(bucket * len(distinct) + place[rest], kind="stable")
                    rest, bucket = rest[order], bucket[order]
                    parts = [(int(bucket[a]), seal(np.diff(code[rest[a:b]], prepend=0)), seal(doc[rest[a:b]])) for a, b in _segments(bucket)]
                    n, none = 1 + len(parts), [None] * len(parts)
                    keys = batch.column(0).slice(i, j - i)
                    offsets = pa.array([0, *[j - i] * n], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row[i]] * n, pa.int64()),
                            pa.array([-1 - int(row[i]), *(p[0] for p in parts)], pa.int64()),  # no group of documents outgrows a slice
                            pa.ListArray.from_arrays(offsets, keys),
                            pa.array([np.diff(first).tolist(), *none], pa.list_(pa.int64())),
                            pa.array([columns.ravel().tolist(), *none], pa.list_(pa.int64())),
                            pa.array([None, *(p[1] for p in parts)], pa.binary()),
                            pa.array([None, *(p[2] for p in parts)], pa.binary()),
                            pa.array([sums.astype(np.float64).tobytes(), *none], pa.binary()),
                        ],
                        names=fields,
                    )

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows and left.column("bucket")[0].as_py() < 0:
                return left  # the documents themselves
            _, values, _, _ = shared.value
            counted = {c: unseal(right.column(c)[0].as_py()) if right.num_rows else np.zeros(0, np.int64) for c in ("codes", *kinds)}
            codes = np.cumsum(counted["codes"])
            tables = [v.losses(codes, counted[x]) for x, v in zip(kinds, values)]
            docs_of, sums_of = [], []
            for own, placed in zip(left.column("codes").to_pylist(), left.column("docs").to_pylist()):
                code, doc = np.cumsum(unseal(own)), unseal(placed)
                at, hit = _find(codes, code)
                found, place = np.unique(doc, return_inverse=True)
                none = np.zeros(np.count_nonzero(~hit), np.int64)
                sums = []
                for table, v in zip(tables, values):
                    each = np.zeros(len(code))
                    each[hit], each[~hit] = table[at[hit]], v.losses(code[~hit], none)
                    sums.append(np.bincount(place, each, len(found)))
                docs_of.append(seal(found))
                sums_of.append(np.stack(sums).astype(np.float32).tobytes())
            nothing = pa.nulls(left.num_rows, pa.binary())
            return left.set_column(5, "codes", nothing).set_column(6, "docs", pa.array(docs_of, pa.binary())).set_column(7, "sums", pa.array(sums_of, pa.binary()))

        def total(table: pa.Table) -> pa.Table:
            table = table.sort_by("bucket")  # the documents themselves come first
            keys, n, told = (table.column(c)[0].values for c in ("keys", "n", "facts"))
            size = len(keys)
            sums = np.frombuffer(table.column("sums")[0].as_py(), np.float64).reshape(len(kinds), size).copy()
            for placed, own in zip(table.column("docs").to_pylist()[1:], table.column("sums").to_pylist()[1:]):
                doc = unseal(placed)
                sums[:, doc] += np.frombuffer(own, np.float32).reshape(len(kinds), len(doc))
            told = told.to_numpy().reshape(len(names), size)
            return pa.table([keys, n, *map(pa.array, sums), *map(pa.array, told)], names=["key", "n_tokens", *(f"loss_{x}" for x in kinds), *names])

        fields = ["slice", "bucket", "keys", "n", "facts", "codes", "docs", "sums"]
        ddl = f"slice long, bucket long, keys array<{kind}>, n array<long>, facts array<long>, codes binary, docs binary, sums binary"
        parts = slim.mapInArrow(frugal(run), ddl)
        scored = parts.groupBy("bucket").cogroup(self.pairs.groupBy("bucket")).applyInArrow(score, ddl)
        out = scored.groupBy("slice").applyInArrow(total, f"key {kind}, n_tokens long" + "".join(f", loss_{x} double" for x in kinds) + "".join(f", {c} long" for c in names))
        return out.withColumnRenamed("key", key)
