"""Perplexity bands: verdicts against brute force, and in scripts other than Latin."""

import collections
import math
import random

import pytest

from stratograph.llm import quality, queries

from .test_word_lm import by_force

SF = "/root/testdata/sf0.001"


def quantile(values, share, step):
    places = sorted(math.floor(v / step + 0.5) for v in values)
    return step * next(p for i, p in enumerate(places, 1) if i / len(places) >= share and (i == len(places) or places[i] != p))


def verdicts_by_force(docs):
    """kept and loss a word of (lang, text), by position."""
    out, groups = {}, collections.defaultdict(list)
    for i, (lang, _) in enumerate(docs):
        groups[lang or ""].append(i)
    for own in groups.values():
        texts = [docs[i][1] or "" for i in own]
        prose, counts = quality.prose(texts), quality.base_counts(texts)
        found = by_force(list(zip(texts, prose.tolist())))
        rate = [loss / max(n, 1) for n, loss, _ in found]
        worded = [k for k, (n, _, _) in enumerate(found) if n]
        middle = quantile([rate[k] for k in worded], 0.5, 0.001)
        low, high = (quantile([(rate[k] - middle) * math.sqrt(found[k][0]) for k in worded], q, 0.01) for q in (0.25, 0.75))
        for k, i in enumerate(own):
            usual = quality.DEVIATIONS * (high - low) / 1.349 / math.sqrt(max(found[k][0], 1))
            fails = counts["n_words"][k] < 20 or 100 * counts["n_repeat_words"][k] > 30 * counts["n_words"][k]
            out[i] = (not fails and middle - usual - quality.BELOW <= rate[k] <= middle + usual + quality.ABOVE, rate[k])
    return out


def test_verdicts_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    true = verdicts_by_force([(r["lang"], r["text"]) for r in docs])
    out = {r["doc_id"]: r for r in queries.op10_quality_rules(spark, SF).collect()}
    for i, r in enumerate(docs):
        kept, rate = true[i]
        assert math.log(out[r["doc_id"]]["perplexity"]) == pytest.approx(rate, rel=1e-5, abs=1e-6)
        assert out[r["doc_id"]]["kept"] == kept
    assert 0 < sum(k for k, _ in true.values()) < len(docs)


def test_gibberish_goes_in_any_script(spark):
    draw = random.Random(5)
    letters = {"ru": "абвгдежзиклмнопрст", "zh": "的一是不了人我在有他这中大来上", "el": "αβγδεζηθικλμνξοπρ"}
    rows = []
    for lang, own in letters.items():
        known = ["".join(draw.choices(own, k=draw.randrange(3, 7))) for _ in range(30)]
        rows += [(f"{lang}{i}", lang, " ".join(draw.choices(known, k=80))) for i in range(60)]
        for i in range(4):
            odd = [chr(0x4E00 + draw.randrange(8000)) if lang == "zh" else "".join(draw.choices(own, k=draw.randrange(3, 9))) for _ in range(80)]
            rows.append((f"{lang}-odd{i}", lang, " ".join(odd)))
    out = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id string, lang string, text string")).collect()}
    assert {d for d, kept in out.items() if not kept} == {f"{lang}-odd{i}" for lang in letters for i in range(4)}
