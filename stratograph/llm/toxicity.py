"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes by an acceptor of word and word-stem patterns. Transducers for reported speech, negation, targets and
threats read a sentence's classes one after the other, and only reported speech reaches beyond a clause; their composition gives each insult or threat the context it stands
in, and a clause counts by the contexts of what it matches, not by its words alone. Insult patterns and the worth of each
context are learned from labelled documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .words import _mix_int

#: Labelled rows that are learned from, at most: those with the least hashes of their key.
LABELLED_ROWS = 20_000
#: Letters of stem patterns; different toxic documents that a pattern must occur in; the least log odds ratio of a pattern.
STEMS, LEAST_DOCUMENTS, LEAST_ODDS = (3, 4, 5, 6, 7), 3, 1.5
#: Different documents from which on a pattern is kept even if others cover all of its documents.
PLENTY = 10
#: Lexical weight of a seed, and the most that a document's evidence in one context adds up to.
SEED_WEIGHT, MOST_EVIDENCE = 6.0, 12.0
#: Words as written whose classes a worker remembers before it forgets them all (and those of one text more).
REMEMBERED = 500_000

#: Classes of words; BREAK stands between clauses of a sentence. LINK words take no part in the reach of others; CONTRAST and then
#: FIRST (the author's own clause) end a report; DIRECT is a target that is spoken to; HARM is done to it, HARMED is done with.
OTHER, NEGATION, REPORT, TARGET, THREAT, INSULT, BREAK, LINK, CONTRAST, FIRST, HARM, DIRECT, HARMED = range(13)
#: The bits of a class, and flags of a word that ends a clause, or a sentence (or line).
CLASS, BREAKS, ENDS = 15, 16, 32
#: Words of the closed classes, and a few insults to start from, in English, German, French and Spanish.
CLOSED = {
    NEGATION: "cannot without not no never neither nor isn't aren't wasn't don't nicht kein keine keinen keiner keines keinem nie niemals ne pas jamais non nunca jamás sin",
    REPORT: "say told tells said says saying wrote writes called calls claimed claims quoted sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó",
    TARGET: "he she they him them il ils él ellos",
    DIRECT: "you your you're you'll u yourself yourselves du dich dir euch ihr tu te toi vous usted ustedes",
    THREAT: "kill murder stab strangle shoot burn töten umbringen ermorden erschießen tuer assassiner égorger matar asesinar degollar",
    LINK: "be seem seems to call appear appears",
    CONTRAST: "but however yet though aber doch sondern mais pourtant pero sino",
    FIRST: "i i'm i'll i'd i've me my we ich mir wir je j'ai moi nous yo mí nosotros",
}
#: Stems and endings of further verbs of harm, as they are done (hang, killing) and suffered (stabbed).
_VERB = r"kill|murder|stab|strangl|shoot|burn|hang|chok|drown|behead|slaughter|butcher"
_HARM = re.compile(rf"(?:{_VERB})(?:e|es|s|b?ing)?|(?:töt|erwürg|erhäng|erstech|erschlag)(?:e|est|en|t)|tuerai|étrangl(?:e|er|erai)|mataré|mato|estrangul(?:o|ar|aré)")
_HARMED = re.compile(rf"(?:{_VERB})b?e[dn]|shot|hung|getötet|ermordet|erschossen|erstochen|erwürgt|tuée?s?|égorgée?s?|asesinad[oa]s?|degollad[oa]s?")

SEEDS = "idiot moron imbecile scum bastard depp abschaum trottel imbécile crétin salaud idiota imbécil estúpido cabrón"
#: Contexts of a match, and what a unit of lexical weight is worth in each before any label is seen.
CONTEXTS = {"plain": 1.0, "targeted": 1.2, "negated": 0.3, "reported": 0.5, "threat": 1.2}
START = -4.0

#: Signs that close a quote or a bracket after a word.
_CLOSING = "\"'”’»)]"
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_MATCHED = (THREAT, INSULT, HARM, HARMED)
_MATCH = re.compile(b"[" + re.escape(bytes(c | e for c in _MATCHED for e in (0, BREAKS, ENDS, BREAKS | ENDS))) + b"]")


class Transducer:
    """A finite-state transducer on word classes. ``arcs[state, symbol]`` is (next state, output); other symbols follow
    ``rest[state]`` and pass unchanged."""

    def __init__(self, arcs: dict[tuple[int, object], tuple[int, object]], rest: dict[int, int]) -> None:
        self.arcs, self.rest = arcs, rest

    def step(self, state: int, symbol: object) -> tuple[int, object]:
        if (found := self.arcs.get((state, symbol))) is not None:
            return found
        return self.rest[state], symbol


class Composed:
    """The composition: each machine reads what the one before it writes. Its transitions are tabled as they are met; there
    are as many as state tuples and symbols, whatever the texts."""

    def __init__(self, *machines: Transducer) -> None:
        self.machines = machines
        self.table: dict[tuple[tuple[int, ...], object], tuple[tuple[int, ...], object]] = {}

    def step(self, state: tuple[int, ...], symbol: object) -> tuple[tuple[int, ...], object]:
        if (found := self.table.get((state, symbol))) is None:
            after, out = [], symbol
            for machine, own in zip(self.machines, state):
                to, out = machine.step(own, out)
                after.append(to)
            found = self.table[state, symbol] = tuple(after), out
        return found

    def run(self, symbols: Sequence[object]) -> list[object]:
        state, out = (0,) * len(self.machines), []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out.append(written)
        return out


def _near(triggers: Sequence[int], reach: int, writes: dict[object, object]) -> Transducer:
    """For ``reach`` words after a trigger, write other symbols in place of some."""
    states = range(reach + 1)
    arcs: dict[tuple[int, object], tuple[int, object]] = {(s, trigger): (reach, trigger) for s in states for trigger in triggers}
    arcs |= {(s, symbol): (s - 1, out) for s in range(1, reach + 1) for symbol, out in writes.items()}
    arcs |= {(s, BREAK): (0, BREAK) for s in states} | {(s, LINK): (s, LINK) for s in states}
    return Transducer(arcs, {s: max(0, s - 1) for s in states})


def _reports(writes: dict[object, object]) -> Transducer:
    """After a report, to the end of the sentence, or to a contrast that the author's own clause follows (at once or after one
    word). What the author says to have said is no report."""
    none, reported, contrast, later, author = range(5)
    inside = (reported, contrast, later)
    arcs: dict[tuple[int, object], tuple[int, object]] = {(s, REPORT): (reported, REPORT) for s in (none, *inside)}
    arcs |= {(author, REPORT): (none, REPORT), (none, FIRST): (author, FIRST), (author, FIRST): (author, FIRST)}
    arcs |= {(s, CONTRAST): (contrast, CONTRAST) for s in inside} | {(s, FIRST): (author, FIRST) for s in (contrast, later)}
    arcs |= {(s, BREAK): (s, BREAK) for s in (contrast, later)}
    arcs |= {(s, symbol): (reported, out) for s in inside for symbol, out in writes.items()}
    return Transducer(arcs, {none: none, reported: reported, contrast: later, later: reported, author: none})


def _beyond(trigger: int, writes: dict[object, object]) -> Transducer:
    """After a trigger and then a break, to the end of what is read."""
    arcs: dict[tuple[int, object], tuple[int, object]] = {(0, trigger): (1, trigger), (1, BREAK): (2, BREAK)}
    arcs |= {(2, symbol): (2, out) for symbol, out in writes.items()}
    return Transducer(arcs, {0: 0, 1: 1, 2: 2})


def grammar() -> Composed:
    """Reported speech, then negation, then targets before a match. A threat counts only in the reach of a target. A report goes
    on over commas, colons and quotes; negation and targets end with their clause. Reports and targets may also follow a match,
    for which the sentence is read backwards as well (see ``Lexicon.evidence``): a report so has to be a clause of its own. Verbs
    of harm other than the listed threats count only if one who is spoken to suffers them: right before the participle, or right
    after the verb (a link apart)."""
    return Composed(
        _reports({INSULT: "reported", **dict.fromkeys((THREAT, HARM, HARMED), "reported threat")}),
        _near([NEGATION], 3, {INSULT: "negated", **dict.fromkeys((THREAT, HARM, HARMED), "negated threat")}),
        _near([TARGET, DIRECT], 5, {INSULT: "targeted", THREAT: "threat"}),
        _near([DIRECT], 3, {HARMED: "threat"}),
    )


def backwards() -> Composed:
    return Composed(
        _beyond(REPORT, {INSULT: "reported", **dict.fromkeys((THREAT, HARM, HARMED), "reported threat")}),
        _near([TARGET, DIRECT], 3, {INSULT: "targeted", THREAT: "threat"}),
        _near([DIRECT], 1, {HARM: "threat"}),
    )


@dataclass
class Lexicon:
    """Insult patterns (a whole word, or a stem with ``*``) with their lexical weights, and the worth of each context."""

    patterns: dict[str, float]
    start: float = START
    worth: dict[str, float] = field(default_factory=lambda: dict(CONTEXTS))

    def __post_init__(self) -> None:
        self.closed = {w: c for c, words in CLOSED.items() for w in words.split()}
        self.classes, self.weights = _Classes(self), {}
        self.machine, self.back = grammar(), backwards()

    def weight(self, word: str) -> float:
        """The acceptor: the largest weight of the patterns that the word matches; 0 for none."""
        best = self.patterns.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                best = max(best, self.patterns.get(word[:n] + "*", 0.0))
        return best

    def evidence(self, text: str | None) -> list[float]:
        """Lexical weight matched in each context of CONTEXTS, over all clauses of the text."""
        if len(self.classes) >= REMEMBERED:  # only between texts: a text needs the weights of all its words
            self.classes.clear()
            self.weights.clear()
        total = dict.fromkeys(CONTEXTS, 0.0)
        words, codes = [], bytearray()
        for line in (text or "").split("\n"):
            if own := line.split():
                words += own
                codes += bytes(map(self.classes.__getitem__, own))
                codes[-1] |= ENDS
        at = 0
        while found := _MATCH.search(codes, at):
            begin = found.start()
            while begin > at and not codes[begin - 1] & ENDS:
                begin -= 1
            end = found.start()
            while end < len(codes) - 1 and not codes[end] & ENDS:
                end += 1
            sentence, places = [], []
            for k in range(begin, end + 1):
                sentence.append(codes[k] & CLASS)
                places.append(k)
                if codes[k] & BREAKS:
                    sentence.append(BREAK)
                    places.append(-1)
            written, behind = self.machine.run(sentence), self.back.run(sentence[::-1])[::-1]
            for k, symbol, before, after in zip(places, sentence, written, behind):
                if symbol in _MATCHED:
                    context = after if before == symbol or str(after).startswith("reported") else before
                    context = "plain" if context == INSULT else context
                    if context in total:  # a threat out of any target's reach, negated or reported counts for nothing
                        total[context] += self.weights.get(words[k], SEED_WEIGHT)
            at = end + 1
        return [min(v, MOST_EVIDENCE) for v in total.values()]

    def score(self, text: str | None) -> float:
        z = self.start + sum(w * x for w, x in zip(self.worth.values(), self.evidence(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _closed_class(word: str, closed: dict[str, int]) -> int:
    """Class of a word by the lists, or by its form."""
    if (found := closed.get(word)) is not None:
        return found
    if word.endswith("n't"):
        return NEGATION
    return HARM if _HARM.fullmatch(word) else HARMED if _HARMED.fullmatch(word) else OTHER


class _Classes(dict):
    """Class of a word as written (with BREAKS if it ends a clause, ENDS if a sentence), remembered until ``Lexicon.evidence`` makes room."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        code, most = OTHER, 0.0
        for part in _LETTERS.findall(word.lower().replace("’", "'")):
            most = max(most, self.lexicon.weight(part))
            code = max(code, _closed_class(part, self.lexicon.closed))
        if most:
            code = INSULT
        last = word.rstrip(_CLOSING)[-1:]
        if last and last in ".;!?":
            code |= ENDS
        elif last and last in ",:" or word[-1] in _CLOSING:
            code |= BREAKS
        if most:
            self.lexicon.weights[word] = most
        self[word] = code
        return code


def _patterns(text: str) -> tuple[int, set[str]]:
    """A document's patterns, and a number that its near copies mostly share (the least hash of its words)."""
    words = set(_LETTERS.findall(text.lower()))
    found = set(words)
    for n in STEMS:
        found |= {w[:n] + "*" for w in words if len(w) >= n}
    return min((_mix_int(int.from_bytes(w.encode()[-8:], "little") ^ len(w)) for w in words), default=0) >> 1, found


def _learn_patterns(sample: DataFrame) -> dict[str, float]:
    """Insult patterns from a bounded sample (text, toxic).

    A pattern is counted once for documents that are near copies. Among patterns of nearly only toxic documents, those that
    cover the most toxic documents not covered yet are taken, as long as chance doesn't explain it; and all that are plentiful.
    """
    spark = sample.sparkSession

    def toxic_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                cluster, found = _patterns(text or "")
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string()), pa.array([cluster] * len(found), pa.int64())], names=["pattern", "cluster"])

    pairs = checkpoint(sample.filter("toxic = 1").select("text").mapInArrow(toxic_pairs, "pattern string, cluster long").distinct())
    seen = {r["pattern"]: r["n"] for r in pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {LEAST_DOCUMENTS}").collect()}
    shared = spark.sparkContext.broadcast(frozenset(seen))

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for p in _patterns(text or "")[1] & shared.value:
                    counts[p] = counts.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    clean = sample.filter("toxic = 0").select("text").mapInArrow(clean_counts, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    in_clean = {r["pattern"]: r["n"] for r in clean.collect()}
    n_toxic, n_clean = (sample.filter(f"toxic = {t}").count() for t in (1, 0))
    odds = lambda t, c: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    likely = [p for p, n in seen.items() if odds(n, in_clean.get(p, 0)) >= LEAST_ODDS]
    chosen = spark.createDataFrame([(p,) for p in likely], "pattern string")
    documents: dict[str, set[int]] = {}
    for r in pairs.join(F.broadcast(chosen), "pattern").collect():
        documents.setdefault(r["pattern"], set()).add(r["cluster"])
    open_ = {d for ds in documents.values() for d in ds}
    whole = len(open_)

    def gain(p: str) -> float:
        """Log likelihood ratio of how the pattern's occurrences fall on open toxic and on clean documents."""
        t, c = len(documents[p] & open_), in_clean.get(p, 0)
        rate = (len(open_) + 1) / (len(open_) + n_clean + 2)
        if t < LEAST_DOCUMENTS or t <= (t + c) * rate:
            return 0.0
        return t * math.log(t / ((t + c) * rate)) + (c * math.log(c / ((t + c) * (1 - rate))) if c else 0.0)

    # greedy cover, counted again as patterns are looked at: what is open only shrinks
    chance = math.log(len(seen) + 1) + 3
    heap = [(-gain(p), p.endswith("*"), -len(p), p) for p in documents]  # of equals, the most particular
    heapq.heapify(heap)
    taken: list[str] = []
    while heap and open_:
        was, stem, length, p = heapq.heappop(heap)
        now = gain(p)
        if now < chance:
            continue
        if now < -was - 1e-9 and heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, stem, length, p))
            continue
        taken.append(p)
        open_ -= documents[p]
    # what others cover wholly is kept as well if it is plentiful and no part or extension of a pattern that is taken
    for p in sorted(documents, key=lambda p: (-len(documents[p]), len(p), p)):
        stem = p.rstrip("*")
        related = any(q.rstrip("*").startswith(stem) or q.endswith("*") and stem.startswith(q[:-1]) for q in taken)
        if len(documents[p]) >= max(PLENTY, 0.02 * whole) and not related and in_clean.get(p, 0) <= 0.01 * len(documents[p]):
            taken.append(p)
    return {p: min(8.0, odds(len(documents[p]), in_clean.get(p, 0))) for p in taken}


def _fit(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, dict[str, float]]:
    """Logistic regression, drawn towards the worths that hold before any label is seen."""
    before = np.array([START, *CONTEXTS.values()])
    x = np.hstack([np.ones((len(evidence), 1)), evidence])
    theta = before.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - toxic) + (theta - before)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(theta))
        theta -= np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return float(theta[0]), {c: max(0.0, float(t)) for c, t in zip(CONTEXTS, theta[1:])}


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Lexicon:
    """A lexicon from labelled documents whose crc32(key as text) mod 5 isn't 0: at most LABELLED_ROWS of them, those with
    the least hashes. Rows without a key or label are left out; without any, seeds and starting worths remain."""
    usable = labels.filter(F.col(key).isNotNull() & F.col(toxic).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0))
    few = usable.select(F.col(key), F.col(toxic).cast("int").alias("toxic")).dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(LABELLED_ROWS)
    chosen = docs.sparkSession.createDataFrame(few.collect(), few.schema)
    sample = checkpoint(docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key).select("text", "toxic"))
    lexicon = Lexicon(dict.fromkeys(SEEDS.split(), SEED_WEIGHT) | _learn_patterns(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon.patterns)
        for batch in batches:
            rows = [own.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["evidence", "toxic"])

    found = sample.mapInArrow(run, "evidence array<double>, toxic int").toPandas()
    if len(found):
        lexicon.start, lexicon.worth = _fit(np.array(found["evidence"].tolist()), found["toxic"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.patterns, lexicon.start, lexicon.worth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    slim = docs.select(F.col(key), F.col(text))
    return slim.mapInArrow(run, f"`{key}` {slim.schema[0].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the labels and score all documents: key, held_out, score, predicted (1 if score >= 0.5).

    Only the text enters a score. Null and empty texts match nothing and have the lowest score. A null key is scored like any
    other and isn't held out; repeated rows are scored each; an empty table gives an empty table; other columns are dropped.
    """
    scored = score(docs, learn(docs, labels, key, text), key, text)
    held_out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select(key, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
