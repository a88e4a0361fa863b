"""Byte-level BPE: encoding with a segment tree over adjacent pair ranks, and decoding.

A text is first cut where the pre-tokenizer certainly cuts (before a space that a non-space follows). Such a chunk's ids do
not depend on its neighbours, so each Python worker keeps the ids of the chunks that it has met; the merge loop runs once
for a chunk, not once for an occurrence.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's white space (Unicode White_Space) and its pattern, as the vocabulary file's ByteLevel uses.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
#: Chunks kept by a Python worker, and the longest that is kept.
KEPT_CHUNKS, KEPT_LENGTH = 600_000, 48

_SPLIT = re.compile(r"(?= \S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Chunks(dict):
    """Ids (little-endian unsigned 32-bit) by chunk; a missing chunk is encoded and kept while there is room."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str) -> None:
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(self.prefix + chunk)
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class ChunkedEncoder:
    """Encodes whole texts chunk by chunk. ``encode`` gives the ids of a string without special tokens."""

    def __init__(self, encode: Callable[[str], bytes], special: dict[str, int]) -> None:
        self.first, self.later = Chunks(encode, ""), Chunks(encode, " ")
        self.special = special
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def ids(self, text: str | None) -> bytes:
        """The text's ids. Special tokens' strings become their ids, as the tokenizers library does by default."""
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part) for part in self.cut.split(text) if part
        )

    def _plain(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            first, *later = _SPLIT.split(text)
            later = [x[1:] for x in later]
            if not first and later:  # the text begins with a space and a non-space
                return b"".join(map(self.later.__getitem__, later))
        else:
            first, *later = text.split(" ")
        return (self.first[first] if first else b"") + b"".join(map(self.later.__getitem__, later))


class SegmentTreeBpe:
    """Merges by a segment tree over the pairs of neighbours, a binary tree in one flat array: a leaf holds (rank of the pair that
    begins here, position), a node the lesser of its two children, so the root is the leftmost pair of the lowest rank. A merge
    changes three leaves and the nodes above them, a logarithmic number, for words of every length."""

    NONE = 1 << 62

    def __init__(self, spec: dict) -> None:
        vocab, model = spec["model"]["vocab"], spec["model"]
        alphabet = byte_alphabet()
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocab[a] << 32 | vocab[b]
            self.rank[pair], self.merged[pair] = rank << 32, vocab[a + b]
        back = {c: b for b, c in alphabet.items()}
        self.token_bytes = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        found = self.split(text)
        return self.word(found[0]) if len(found) == 1 else b"".join(map(self.word, found))

    def word(self, word: str) -> bytes:
        if (known := self.words.get(word)) is None:
            known = array("I", self.merge([*map(self.byte_id.__getitem__, word.encode("utf-8", "surrogatepass"))])).tobytes()
            if len(word) <= KEPT_LENGTH:
                if len(self.words) >= KEPT_CHUNKS:
                    self.words.clear()
                self.words[word] = known
        return known

    def merge(self, symbols: list[int]) -> list[int]:
        n, rank, merged, none = len(symbols), self.rank.get, self.merged, self.NONE
        if n < 2:
            return symbols
        width = 1 << (n - 2).bit_length()
        level = [rank(a << 32 | b, none) + i for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        level += [none] * (width - n + 1)
        levels = [level]
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        tree = [none]  # children of node k are 2k and 2k + 1, the root is 1, leaves begin at width
        for level in reversed(levels):
            tree += level
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) < none:
            i = root & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            symbols[i] = symbol = merged[symbols[i] << 32 | symbols[j]]
            symbols[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
                tree[width + i] = rank(symbol << 32 | symbols[k], none) + i
                tree[width + j] = none
            else:
                tree[width + i] = none
            if (h := before[i]) >= 0:
                tree[width + h] = rank(symbols[h] << 32 | symbol, none) + h
            # paths meet early; where a node stays, all above it are right but for the leaves that are still to come
            for leaf in (i, j if k < n else i, h if h >= 0 else i):
                node = width + leaf >> 1
                while node:
                    least, other = tree[2 * node], tree[2 * node + 1]
                    if other < least:
                        least = other
                    if tree[node] == least:
                        break
                    tree[node] = least
                    node >>= 1
        return [s for s in symbols if s >= 0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def segment_tree_bpe(path: str) -> tuple[SegmentTreeBpe, ChunkedEncoder]:
    with open(path, encoding="utf-8") as file:
        bpe = SegmentTreeBpe(json.load(file))
    return bpe, ChunkedEncoder(bpe.encode, bpe.special)


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns a row per input row: key, ids (array of int), decoded (string). A null or empty text has no ids and decodes to
    the empty string; a null key stays null; repeated rows give repeated results; other columns are dropped. ``vocabulary``
    is the path of a tokenizers JSON file, which every executor needs at that path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = segment_tree_bpe(vocabulary)
        for batch in batches:
            ids = [encoder.ids(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([array("I", x) for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())],
                names=[key, "ids", "decoded"],
            )

    slim = docs.select(F.col(key), F.col(text))
    return slim.mapInArrow(run, f"`{key}` {slim.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``encode_decode`` gives, as digests: key, n_tokens, ids_sha256, decoded_sha256.

    The same encoder and decoder run; ids leave the Python worker as a digest, so a row is small whatever its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = segment_tree_bpe(vocabulary)
        for batch in batches:
            n, hashed, decoded = [], [], []
            for value in batch.column(1):
                ids = encoder.ids(value.as_py())
                n.append(len(ids) // 4)
                hashed.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    slim = docs.select(F.col(key), F.col(text))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
