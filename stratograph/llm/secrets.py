"""Secret scans: fixed patterns, and windows of high Shannon entropy in candidate strings. Built-in functions only.

A text is cut by each pattern; the lengths of what lies between matches and of the matches themselves, added up, give places in
code points. Candidates are runs of characters that keys and tokens are written in. A window slides over a candidate's
characters: each step takes one character in and lets one out, so two counts change, and with them the sum of c * log2(c) over
all counts, from which the window's entropy follows. Sums are whole numbers (``SCALE`` to one bit), so that no error adds up.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the base kinds. Of an assignment, the second group must have eight characters; the other patterns ask
#: for their least length themselves, which finds the same spans, as each match is a whole run.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Runs that may be secrets; the pattern begins with the characters they are made of.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base32", "entropy_base64")
#: Elements that an inner fold handles at once; see ``scan``.
BLOCK = 256
SCALE = 1 << 32
SPAN = "struct<start: bigint, kind: int, end: bigint>"


class Class(NamedTuple):
    """A class of candidates: its pattern, alphabet, window, and the least entropy in bits of a window."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float


#: The first class whose pattern a candidate fits is its own. Ordinary words, also long ones, stay below the last one's entropy.
CLASSES = (
    Class("entropy_hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdefABCDEF", 20, 2.95),
    Class("entropy_base32", "^[A-Z2-7=]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567=", 20, 3.55),
    Class("entropy_base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.75),
)
#: What isn't a secret: candidates that fit a pattern, and those right behind certain text. Identifiers (words that may be joined
#: by signs), numbers, UUIDs, digests, data in links, alphabets, keys that manuals show. Repeats are possessive: nothing is tried again.
ALLOWED = (
    "^(?:[-_/+=]*+[A-Za-z][a-z]{2,}+)++[0-9]{0,4}+[-_/+=]*+$", "^(?:[-_/+=]*+[A-Z]{2,}+)++[0-9]{0,4}+[-_/+=]*+$", "^[-_/+=0-9]+$",
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", "EXAMPLE", "0123456789|abcdefghij|ABCDEFGHIJ",
)
ALLOWED_BEHIND = ("([sS][hH][aA](1|224|256|384|512)|[mM][dD]5)[-:= ]?$", ";base64,$", "\\b(commit|digest|checksum|etag)[\"']?[:= ]+[\"']?$", "https?://[^ ]*$")
#: How much text before a candidate the last patterns see.
BEHIND = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Fold over an array and keep an output (of type ``out``) of every step: ``step`` takes the state and an item,
    and gives the next state and the output. Outputs of a block are gathered first, then blocks, so a long array costs
    little more than its length."""
    none = F.array().cast(f"array<{out}>")

    def inner(acc: Column, item: Column) -> Column:
        after, found = step(acc["state"], item)
        return F.struct(after.alias("state"), F.array_append(acc["out"], found).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["out"], d["out"]).alias("out")))

    def whole(items_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(items_) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda b: F.slice(items_, b * BLOCK + 1, BLOCK))
        done = F.aggregate(blocks, F.struct(state.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out")), outer)
        return F.when(F.size(items_) > 0, F.flatten(done["out"])).otherwise(none)

    return let(items, whole)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern in a text: an array of (start, end, behind, found), places in code points, the text just before a
    match, and the group asked for."""
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    kind = "struct<start: bigint, end: bigint, behind: string, found: string>"

    def places(matches: Column) -> Column:
        rest = F.array(F.split(text, pattern, -1), every(group) if group else matches)
        items = let(rest, lambda r: F.transform(matches, lambda m, i: F.struct(r[0][i].alias("gap"), m.alias("match"), r[1][i].alias("found"))))

        def step(at: Column, item: Column) -> tuple[Column, Column]:
            begin = at + F.length(item["gap"])
            end = begin + F.length(item["match"])
            return end, F.struct(begin.alias("start"), end.alias("end"), F.right(item["gap"], F.lit(BEHIND)).alias("behind"), item["found"].alias("found"))

        return scan(items, F.lit(0).cast("bigint"), kind, step)

    none = F.array().cast(f"array<{kind}>")
    return let(every(0), lambda m: F.when(F.size(m) > 0, places(m)).otherwise(none))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: an array of SPAN, in no order. Where an assignment cannot begin is told by one letter first."""
    kept = lambda found, kind: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))
    assigned = F.filter(located(text, ASSIGN.replace("(?i)", "(?i)(?=[psta])"), 2), lambda m: F.length(m["found"]) >= 8)
    return F.concat(kept(assigned, "assign"), kept(located(text, ACCESS), "access"), kept(located(text, HEX), "hex"))


def surprising(candidate: Column, of: Class) -> Column:
    """Places in a candidate that windows of high entropy cover: an array of (start, end), overlapping windows as one.

    The counts of a window are characters of a string, one for each of the alphabet; a step changes two of them.
    """
    w, size = of.window, len(of.alphabet)
    weights = F.array(*(F.lit(round(c * math.log2(c) * SCALE) if c > 1 else 0).cast("bigint") for c in range(w + 1)))
    most = math.floor((math.log2(w) - of.bits) * w * SCALE)  # entropy is log2(w) - sum / w
    zero = 48  # the character that stands for no occurrence
    place = "struct<at: bigint, hot: boolean>"
    marks = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(of.alphabet), c))

    def change(counts: Column, weight: Column, mark: Column, by: int) -> Column:
        """(counts, weight) with one more or less of a character."""
        now = F.ascii(F.substr(counts, mark, F.lit(1))) - zero
        return let(now, lambda n: F.struct(F.overlay(counts, F.char(n + by + zero), mark, F.lit(1)).alias("counts"), (weight + weights[n + by] - weights[n]).alias("weight")))

    def slide(marks_: Column) -> Column:
        def step(acc: Column, mark: Column) -> tuple[Column, Column]:
            leaving = F.when(acc["at"] >= w, F.get(marks_, (acc["at"] - w).cast("int")))
            out = F.when(leaving.isNull(), F.struct(acc["counts"].alias("counts"), acc["weight"].alias("weight"))).otherwise(change(acc["counts"], acc["weight"], leaving, -1))
            after = let(out, lambda o: change(o["counts"], o["weight"], mark, 1))
            state = let(after, lambda a: F.struct((acc["at"] + 1).alias("at"), a["counts"].alias("counts"), a["weight"].alias("weight")))
            return state, F.struct(acc["at"].alias("at"), ((acc["at"] >= w) & (acc["weight"] <= most)).alias("hot"))

        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(chr(zero) * size).alias("counts"), F.lit(0).cast("bigint").alias("weight"))
        # one more item than characters: what is put out is the state before an item
        seen = scan(F.concat(marks_, F.array(F.lit(1))), begin, place, step)
        ends = F.transform(F.filter(seen, lambda p: p["hot"]), lambda p: p["at"])
        return joined(ends, w)

    # entropy is at most log2 of the number of different characters
    few = lambda m: F.size(F.array_distinct(m)) < math.ceil(2**of.bits)
    return let(marks, lambda m: F.when(few(m), F.array().cast("array<struct<start: bigint, end: bigint>>")).otherwise(slide(m)))


def joined(ends: Column, window: int) -> Column:
    """Ends of windows as an array of (start, end): windows that overlap or touch are one."""

    def fold(numbers: Column) -> Column:
        first = F.filter(numbers, lambda e, i: (i == 0) | (e - F.get(numbers, i - 1) > window))
        last = F.filter(numbers, lambda e, i: (i == F.size(numbers) - 1) | (F.get(numbers, i + 1) - e > window))
        return F.arrays_zip(F.transform(first, lambda e: e - window).alias("start"), last.alias("end"))

    return let(ends, fold)


def entropy_spans(text: Column, classes: tuple[Class, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, allowed_behind: tuple[str, ...] = ALLOWED_BEHIND) -> Column:
    """Spans of high entropy in candidates that no allow-list holds: an array of SPAN."""

    def suspect(m: Column) -> Column:
        good = F.lit(False)
        for pattern in allowed:
            good = good | m["found"].rlike(pattern)
        for pattern in allowed_behind:
            good = good | m["behind"].rlike(pattern)
        return ~good

    def of_candidate(m: Column) -> Column:
        spans = F
        for c in classes:
            kind = F.lit(KINDS.index(c.kind)).alias("kind")
            hot = F.transform(surprising(m["found"], c), lambda p: F.struct((m["start"] + p["start"]).alias("start"), kind, (m["start"] + p["end"]).alias("end")))  # noqa: B023
            spans = spans.when(m["found"].rlike(c.pattern), hot)
        return spans.otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(F.filter(located(text, f"(?<!{CANDIDATE[:-5]}){CANDIDATE}"), suspect), lambda ms: F.flatten(F.transform(ms, of_candidate)))


def uncovered(spans: Column) -> Column:
    """Spans in order, without those of the method that lie within a base span."""
    base = KINDS.index("hex")

    def step(reach: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["kind"] <= base, F.greatest(reach, s["end"])).otherwise(reach), F.struct(s.alias("s"), ((s["kind"] <= base) | (s["end"] > reach)).alias("own"))

    # of equal starts base kinds come first, so whatever covers a span has been met before it
    marked = scan(spans, F.lit(-1).cast("bigint"), f"struct<s: {SPAN}, own: boolean>", step)
    return F.transform(F.filter(marked, lambda m: m["own"]), lambda m: m["s"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", allowed: tuple[str, ...] = ALLOWED, allowed_behind: tuple[str, ...] = ALLOWED_BEHIND) -> DataFrame:
    """Spans of secrets in whole texts: key, spans (array of kind, start, end; by start, then kind in the order of KINDS).

    Base spans are matches of the three patterns, leftmost and not overlapping within a kind, whatever the allow-lists say. The
    entropy of windows adds spans that no base span contains. Places are code points, the end exclusive. A null or empty text has
    no spans; a null key stays null; a repeated row gives a row each time; an empty table gives an empty table; other columns
    are dropped. Nothing is shuffled: a row's spans follow from its text alone.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    both = let(F.array_sort(F.concat(base_spans(value), entropy_spans(value, allowed=allowed, allowed_behind=allowed_behind))), uncovered)
    names = F.array(*map(F.lit, KINDS))
    found = docs.select(F.col(f"`{key}`"), both.alias("_found"))
    named = F.transform("_found", lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(F.col(f"`{key}`"), named.alias("spans"))


def secret_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``find_secrets`` finds, as counts, a digest of base spans, and text: key, n_assign, n_access, n_hex, base_sha256, spans."""
    joined_ = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    base = ("assign", "access", "hex")
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in base]  # noqa: B023
    digest = F.sha2(joined_(F.filter("spans", lambda s: s["kind"].isin(*base))).cast("binary"), 256)
    return find_secrets(docs, key, text).select(F.col(f"`{key}`"), *counts, digest.alias("base_sha256"), joined_(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same in the checking engine: places by sums over pieces, entropy of every window by counting its characters anew."""
    either = lambda p: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in p)
    plain = lambda p: p.replace("++", "+").replace("*+", "*").replace("}+", "}").replace("'", "''")
    assign = ("(" + either("password|passwd|secret|token|api_?key") + ")" + ASSIGN.partition("key)")[2]).replace("'", "''")
    located_ = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {g}) AS gs, string_split_regex(t, '{p}') AS gaps FROM docs"
        for k, p, g in ((0, assign, 2), (1, ACCESS, 0), (2, HEX, 0), (9, CANDIDATE, 0))
    )
    windows = {c.window for c in CLASSES}
    assert len(windows) == 1
    w = windows.pop()
    weights = ", ".join(str(round(c * math.log2(c) * SCALE) if c > 1 else 0) for c in range(1, w + 1))
    kind = "CASE " + " ".join(f"WHEN regexp_matches(m, '{c.pattern}') THEN {KINDS.index(c.kind)}" for c in CLASSES) + " END"
    most = "CASE kind " + " ".join(f"WHEN {KINDS.index(c.kind)} THEN {math.floor((math.log2(c.window) - c.bits) * c.window * SCALE)}" for c in CLASSES) + " END"
    fine = " OR ".join([f"regexp_matches(m, '{plain(p)}')" for p in ALLOWED] + [f"regexp_matches(right(gap, {BEHIND}), '{plain(p)}')" for p in ALLOWED_BEHIND])
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS ({located_}),
pieces AS (SELECT r, kind, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap FROM cut WHERE len(ms) > 0),
placed AS (SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT AS e FROM pieces),
base AS (SELECT r, kind, e - length(m) AS s, e FROM placed WHERE kind IN (1, 2) OR kind = 0 AND length(g) >= 8),
candidates AS (SELECT r, i, m, e - length(m) AS s, {kind} AS kind FROM placed WHERE kind = 9 AND NOT ({fine})),
windows AS (SELECT r, i, kind, s, m, unnest(range(0, length(m) - {w} + 1)) AS o FROM candidates),
chars AS (SELECT r, i, kind, s, o, unnest(string_split(substr(m, (o + 1)::INT, {w}), '')) AS c FROM windows),
counts AS (SELECT r, i, kind, s, o, count(*) AS n FROM chars GROUP BY r, i, kind, s, o, c),
hot AS (SELECT r, i, kind, s + o AS s FROM counts GROUP BY r, i, kind, s, o HAVING sum(([{weights}])[n]) <= {most}),
begun AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY r, i ORDER BY s) <= {w} THEN 0 ELSE 1 END AS new FROM hot),
islands AS (SELECT *, sum(new) OVER (PARTITION BY r, i ORDER BY s) AS island FROM begun),
added AS (SELECT r, kind, min(s) AS s, max(s) + {w} AS e FROM islands GROUP BY r, i, kind, island),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.s <= a.s AND b.e >= a.e)),
texts AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(({names})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind <= 2) AS b, string_agg(({names})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS x FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans
FROM docs LEFT JOIN texts USING (r)"""


ORACLE_SQL = _sql()
