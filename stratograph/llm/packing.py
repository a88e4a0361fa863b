"""Packing tokenized documents into fixed-length sequences by best-two-fit.

Best-two-fit needs only the number of pieces of each length, and lengths run from 1 to the capacity. So the packing runs over
that histogram (at most ``capacity`` numbers, whatever the corpus) and yields patterns: lengths that share a sequence, and
how many sequences repeat them. Pieces then take their places in the patterns by their number within their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACE, byte_alphabet, segment_tree_bpe
from .common import checkpoint, number_rows

#: The pre-tokenizer's pattern with possessive repeats: the same cuts, found faster.
_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^" + SPACE + r"\p{L}\p{N}]++|[" + SPACE + r"]++$|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]"
)
#: A text with so long a run of white space goes through the segment tree, which gives the same ids: the other library recurses on it.
LONG_RUN = 100_000
_LONG_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN}}}")


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Callable[[str], Sequence[int]]:
    import json

    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    back = {c: b for b, c in byte_alphabet().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {k: i for k, i in ranks.items() if i not in special.values()}
    encoding = tiktoken.Encoding("corpus", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and _LONG_RUN.search(text):
            return array("I", segment_tree_bpe(vocabulary)[1].ids(text))
        if any(s in text for s in special):  # the tokenizers library turns their strings into their ids
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, but for a shorter first one if it doesn't come out even."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece of each tokenized document: key, piece, start, length, ids_crc32. A null text counts as empty: its one
    piece is the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            at, piece, start, length, crc = [], array("q"), array("q"), array("q"), array("q")
            for row, value in enumerate(batch.column(1)):
                ids = array("I", encode(value.as_py() or ""))
                ids.append(end_id)
                begin = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    at.append(row)
                    piece.append(k)
                    start.append(begin)
                    length.append(n)
                    crc.append(zlib.crc32(ids[begin : begin + n].tobytes()))
                    begin += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32()))] + [pa.array(x, pa.int64()) for x in (piece, start, length, crc)],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    slim = docs.select(F.col(key), F.col(text))
    return slim.mapInArrow(run, f"`{key}` {slim.schema[0].dataType.simpleString()}, piece long, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, number of such sequences) that use up ``counts`` (pieces by length).

    A sequence is filled greedily: the longest piece left, then again and again the longest that still fits. Then its
    shortest piece gives way to two unpacked pieces if these fill the gap so opened more tightly. Equal lengths are
    interchangeable, so a pattern repeats as it is until one of its lengths runs short; each pattern is taken that many
    times at once.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a sequence of {capacity}")
        left[length] = n
    lengths = [n for n in range(1, capacity + 1) if left[n]]  # those that are left, ascending
    patterns: list[tuple[list[int], int]] = []
    while lengths:
        greedy: dict[int, int] = {}
        gap = capacity
        while k := bisect_right(lengths, gap):
            while k and left[lengths[k - 1]] <= greedy.get(lengths[k - 1], 0):
                k -= 1
            if not k:
                break
            best = lengths[k - 1]
            take = min(gap // best, left[best] - greedy.get(best, 0))
            greedy[best] = greedy.get(best, 0) + take
            gap -= take * best
        final = dict(greedy)
        if gap and len(lengths) > 1:
            shortest = min(greedy)
            room, most, pair = gap + shortest, shortest, None
            free = [n for n in lengths if left[n] - greedy.get(n, 0) > 0]
            low, high = 0, len(free) - 1
            while low <= high:
                total = free[low] + free[high]
                if total > room:
                    high -= 1
                    continue
                if total > most and (low < high or left[free[low]] - greedy.get(free[low], 0) > 1):
                    most, pair = total, (free[low], free[high])
                low += 1
            if pair:
                final[shortest] -= 1
                for n in pair:
                    final[n] = final.get(n, 0) + 1
                final = {n: k for n, k in final.items() if k}
        # a repeat needs its own pieces and those that the greedy step looks at
        times = 1 + min((left[n] - max(k, greedy.get(n, 0))) // k for n, k in final.items())
        patterns.append(([n for n, k in sorted(final.items(), reverse=True) for _ in range(k)], times))
        for n, k in final.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, n, sequence, offset): of the pieces with that length, numbers first to first + n - 1 go to the
    sequences from ``sequence`` on, one each, at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to a table of pieces (key, piece, length, and any other columns).

    The histogram of lengths goes to the driver (at most ``capacity`` rows) and the table of places back (some rows for each
    pattern, of which there are about as many as lengths). Repeated rows are packed each for itself; an empty table packs to
    an empty table; pieces with equal lengths are told apart by key and piece only.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = places(best_two_fit(counts, capacity))
    total = sum(counts.values())
    sizes = spark.createDataFrame(list(counts.items()), "length long, _size long")
    sized = pieces.join(F.broadcast(sizes), "length")
    numbered = number_rows(
        sized, "length", [F.col(key), F.col("piece")], "_number",
        F.xxhash64(F.col(key), F.col("piece"), F.lit("deal")), F.lit(max(64, total // 4096)),
    )
    table: dict[int, list] = {}
    for length, first, n, sequence, offset in rows:
        table.setdefault(length, []).append((first, sequence, offset))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        seats = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in table.items()}
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at = length == k
                first, base, off = seats[int(k)]
                pattern = np.searchsorted(first, number[at], "right") - 1
                sequence[at] = base[pattern] + number[at] - first[pattern]
                offset[at] = off[pattern]
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_number"]
            names = [name for name in batch.schema.names if name != "_number"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    slim = numbered.select(*[f"`{c}`" for c in pieces.columns], "_number")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_number")
    return slim.mapInArrow(seat, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize whole documents, cut those over ``capacity`` tokens, and pack the pieces into sequences of at most ``capacity``.

    Returns a row per piece: key, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one piece
    with the end token; a null key is packed as any other; an empty table gives an empty table; other columns are dropped.
    """
    return pack(checkpoint(token_pieces(docs, vocabulary, capacity, end_id, key, text)), capacity, key)
