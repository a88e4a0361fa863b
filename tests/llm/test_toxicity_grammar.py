"""The toxicity grammar against plain rules, and the query's scores against both."""

import math
import random

import pytest

from stratograph.llm import toxicity as T

SF = "/root/testdata/sf0.001"
SAID = ["He said, you are a fool.", 'He said: "You fool"', '"You fool", he said', "He said that you are a fool", "You fool, said he."]


def evidence_by_force(lexicon, text):
    total = dict.fromkeys(T.CONTEXTS, 0.0)
    sentences = [[]]
    for line in (text or "").split("\n"):
        for word in line.split():
            code = lexicon.classes[word]
            sentences[-1].append((word, code & 7, bool(code & T.BREAKS)))
            if code & T.ENDS:
                sentences.append([])
        sentences.append([])
    for s in sentences:
        clause = [sum(b for *_, b in s[:i]) for i in range(len(s))]
        near = lambda i, cls, places: any(s[j][1] == cls and clause[j] == clause[i] for j in places if 0 <= j < len(s))  # noqa: E731, B023
        for i, (word, cls, _) in enumerate(s):
            if cls not in (T.THREAT, T.INSULT):
                continue
            aimed = "targeted" if cls == T.INSULT else "threat"
            reported = any(c == T.REPORT for _, c, _ in s[:i]) or any(c == T.REPORT and clause[j] > clause[i] for j, (_, c, _) in enumerate(s) if j > i)
            if reported:
                context = "reported" if cls == T.INSULT else None
            elif near(i, T.NEGATION, range(i - 3, i)):
                context = "negated" if cls == T.INSULT else None
            elif near(i, T.TARGET, range(i - 5, i)) or near(i, T.TARGET, range(i + 1, i + 4)):
                context = aimed
            else:
                context = "plain" if cls == T.INSULT else None
            if context:
                total[context] += lexicon.weights.get(word, T.SEED_WEIGHT)
    return [min(v, T.MOST_EVIDENCE) for v in total.values()]


@pytest.mark.parametrize("text", SAID)
def test_reported_speech(text):
    found = dict(zip(T.CONTEXTS, T.Lexicon({"fool": 5.0}).evidence(text)))
    assert found == {"plain": 0, "targeted": 0, "negated": 0, "reported": 5.0, "threat": 0}


def test_contexts_are_those_by_force():
    lexicon, draw = T.Lexicon({"fool": 1.0, "lowei*": 0.5}), random.Random(7)
    pool = ["fool", "loweiab", "kill", "you", "not", "said", "he", "tree", "house", "goes", "a"]
    for _ in range(3000):
        text = " ".join(draw.choice(["", "", '"']) + draw.choice(pool) + draw.choice(["", "", "", ",", ":", ".", '"', '."', "\n"]) for _ in range(draw.randrange(25)))
        assert lexicon.evidence(text) == pytest.approx(evidence_by_force(lexicon, text)), text


def test_scores_are_those_by_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = T.learn(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in T.score(docs, lexicon).collect():
        z = lexicon.start + sum(w * x for w, x in zip(lexicon.worth.values(), evidence_by_force(lexicon, texts[r["doc_id"]])))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


CASES = {
    "kill yourself": "threat",
    "I will hang you": "threat",
    "I am killing you": "threat",
    "you're getting stabbed": "threat",
    "they hang around": None,
    "he was shot": None,
    "you hang pictures": None,
    "I won’t strangle you": None,
    "they told him, I will hang you": None,
    "he doesn't seem to be a fool": "negated",
    "he doesn’t seem to be a fool": "negated",
    "I can't call you a fool": "negated",
    "er ist keiner der fool ist": "negated",
    "people say you are a fool": "reported",
    "I never said you are a fool": "reported",
    "He said hello but you are a fool": "reported",
    "He said hello but I think you are a fool": "targeted",
    "He said hello, but to me, you are a fool": "targeted",
    "I said you are a fool": "targeted",
}


@pytest.mark.parametrize("text", CASES)
def test_contexts_of_written_cases(text):
    found = {k for k, v in zip(T.CONTEXTS, T.Lexicon({"fool": 5.0}).evidence(text)) if v}
    assert found == ({CASES[text]} if CASES[text] else set())
