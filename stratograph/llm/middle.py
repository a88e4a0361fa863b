"""Fill-in-the-middle transformation of texts, by block rotation in one buffer, and its inverse.

A text's cuts and form follow from its key. Its bytes and the sentinels lie in one bytearray; segments change places by
rotations of three reversals each, and the same rotations the other way round give the text back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred, the first so many that are transformed, and the first so many of these with the suffix in front.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes that a reversal or a search for a cut takes at once.
STRIDE = 1 << 16
#: Bytes that continue a code point in UTF-8.
_CONTINUE = bytes(range(0x80, 0xC0))


class Plan(NamedTuple):
    """What follows from a key: form and the numbers of code points before the suffix and in the middle."""

    form: str
    prefix: int
    middle: int


def characters(text: bytes) -> int:
    """Code points of UTF-8 bytes: all bytes but those that continue one."""
    return sum(len(text[i : i + STRIDE].translate(None, _CONTINUE)) for i in range(0, len(text), STRIDE))


def plan(key: str, text: bytes, n: int) -> Plan:
    """Form and cuts of a text of ``n`` code points with a key in decimal."""
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    a, b, c, d = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not n or PREFIX in text or SUFFIX in text or MIDDLE in text or c % 100 >= TRANSFORMED:
        return Plan("plain", 0, 0)
    first, second = sorted((a % (n + 1), b % (n + 1)))
    return Plan("spm" if d % 100 < SUFFIX_FIRST else "psm", first, second - first)


def cut(text: bytes, begin: int, count: int) -> int:
    """The byte place ``count`` code points after the byte place ``begin``, scanning a stride at a time."""
    at = begin
    while count:
        part = text[at : at + STRIDE]
        starts = len(part.translate(None, _CONTINUE))
        if part.isascii() and count <= len(part):
            return at + count
        if starts <= count and at + STRIDE < len(text):
            count -= starts
            at += len(part)
            continue
        for byte in part:  # the place lies in this stride, or at the end of the text
            if byte & 0xC0 != 0x80:
                if not count:
                    return at
                count -= 1
            at += 1
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def reverse(buffer: bytearray, begin: int, end: int) -> None:
    """Reverse bytes in place: strides from both ends change places."""
    while end - begin > 1:
        n = min(STRIDE, (end - begin) // 2)
        low = buffer[begin : begin + n]
        buffer[begin : begin + n] = buffer[end - n : end][::-1]
        buffer[end - n : end] = low[::-1]
        begin += n
        end -= n


def rotate(buffer: bytearray, begin: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks begin..middle and middle..end by three reversals."""
    reverse(buffer, begin, middle)
    reverse(buffer, middle, end)
    reverse(buffer, begin, end)


def transform(text: bytes, how: Plan) -> bytes:
    """The text with sentinels, its segments in the order of the form."""
    if how.form == "plain":
        return text
    first = cut(text, 0, how.prefix)
    second = cut(text, first, how.middle)
    # sentinel and segment in the order of the text: prefix, middle, suffix
    buffer = bytearray(len(text) + len(PREFIX) + len(MIDDLE) + len(SUFFIX))
    at, places = 0, []
    for sentinel, begin, end in ((PREFIX, 0, first), (MIDDLE, first, second), (SUFFIX, second, len(text))):
        places.append(at)
        buffer[at : at + len(sentinel)] = sentinel
        at += len(sentinel)
        buffer[at : at + end - begin] = memoryview(text)[begin:end]
        at += end - begin
    # psm exchanges middle and suffix; spm brings the suffix to the front
    rotate(buffer, places[1] if how.form == "psm" else 0, places[2], len(buffer))
    return bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` made ``output`` of: the rotation the other way round, then the sentinels go. A text that is
    transformed holds no sentinel, so each is found at its first place."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":
        block, begin = buffer.find(MIDDLE), buffer.find(SUFFIX)
    else:
        block, begin = buffer.find(PREFIX), 0
    rotate(buffer, begin, block, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):  # from the end, so that places before stay
        at = buffer.find(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Transform every whole text: key, n (code points), form (plain, psm, spm), prefix_chars, middle_chars, output.

    A null text counts as empty and is plain, as is a text that holds a sentinel; prefix_chars and middle_chars are null then. A
    null key counts as an empty one and stays null. A repeated row gives the same result each time; an empty table gives an empty
    table; other columns are dropped. A row needs about four times its text in a worker's memory, whatever the other rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 2):
                counts, plans, outputs = [], [], []
                for name, value in zip(part.column(1), part.column(2)):
                    own = (value.as_py() or "").encode("utf-8", "surrogatepass")
                    n = characters(own)
                    how = plan(name.as_py() or "", own, n)
                    counts.append(n)
                    plans.append(how)
                    outputs.append(transform(own, how))
                cuts = [[None if p.form == "plain" else x for p, x in zip(plans, values)] for values in ([p.prefix for p in plans], [p.middle for p in plans])]
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array([p.form for p in plans]), *(pa.array(c, pa.int64()) for c in cuts), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "n", "form", "prefix_chars", "middle_chars", "output"])

    slim = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{key}`").cast("string").alias("_decimal"), F.col(f"`{text}`").alias("_text"))
    made = slim.mapInArrow(run, f"_key {slim.schema[0].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("_key", key)


def restored(transformed: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """``transformed`` with the text that each output was made of; a row without output or form has none."""
    fields = [f for f in transformed.schema if f.name != name]
    at, of = (next(i for i, f in enumerate(fields) if f.name == c) for c in (output, form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, at):
                texts = [None if o is None or f is None else restore(o.encode("utf-8", "surrogatepass"), f) for o, f in ((o.as_py(), f.as_py()) for o, f in zip(part.column(at), part.column(of)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, "_new"])

    kept = transformed.select(*(F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(fields)))
    made = kept.mapInArrow(run, ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", _new string")
    return made.toDF(*(f.name for f in fields), name)


def rows_of(batch: pa.RecordBatch, column: int, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def middle_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``fill_in_middle`` and ``restored`` give, texts as digests: key, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256."""
    both = restored(fill_in_middle(docs, key, text))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return both.select(F.col(f"`{key}`"), "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def _sql() -> str:
    """The same in the checking engine, by cutting and joining strings."""
    h = [f"('0x' || substr(h, {k}, 8))::UBIGINT" for k in (1, 9, 17, 25)]
    p, s, m = (f"'{x.decode()}'" for x in (PREFIX, SUFFIX, MIDDLE))
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cuts AS (SELECT doc_id, t, n, least({h[0]} % (n + 1), {h[1]} % (n + 1))::BIGINT AS a, greatest({h[0]} % (n + 1), {h[1]} % (n + 1))::BIGINT AS b,
  CASE WHEN n = 0 OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR {h[2]} % 100 >= {TRANSFORMED} THEN 'plain' WHEN {h[3]} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM docs),
parts AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || pre || {s} || suf || {m} || mid ELSE {s} || suf || {p} || pre || {m} || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""


ORACLE_SQL = _sql()
