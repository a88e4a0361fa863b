"""Evidence doesn't depend on how many words a worker has met before, or meets in one text."""

from stratograph.llm import toxicity

PATTERNS = {"fool": 2.0, "lowei*": 3.5}


def test_many_words_before_a_text(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    lexicon = toxicity.Lexicon(PATTERNS)
    for i in range(200):
        text = f"you are a fool {i} and a loweiab {i} . kill you {i}"
        assert lexicon.evidence(text) == toxicity.Lexicon(PATTERNS).evidence(text)
    assert len(lexicon.classes) <= 60 and len(lexicon.weights) <= 60


def test_many_words_in_one_text():
    rare = " ".join(f"w{i}" for i in range(500_001))
    plain = dict(zip(toxicity.CONTEXTS, toxicity.Lexicon(PATTERNS).evidence(f"a fool. {rare}")))["plain"]
    assert plain == 2.0
