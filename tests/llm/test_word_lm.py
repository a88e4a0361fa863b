"""Word models: against a plain estimate, over any script, and growing with the corpus."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratograph.llm import lm_score, word_lm


def split(text):
    return [w for w in re.findall(r"\w+|[^\w\s]", text.lower()) if w not in word_lm.PARTING]


def by_force(docs, least=2):
    """n_tokens, target and background loss of (text, in target); words that come less often than ``least`` are one unknown word."""

    often = collections.Counter(w for t, _ in docs for w in split(t))
    known = {w for w, n in often.items() if n >= least}
    rare = max(len(often) - len(known), 1)
    numbered = lambda t: [w if w in known else "<?>" for w in split(t)]
    docs = [(numbered(t), inside) for t, inside in docs]

    def estimate(texts, size):
        pairs = collections.Counter(p for t in texts for p in zip(["<s>", *t], t))
        before = collections.Counter(c for _, c in pairs)
        d2, d1 = (word_lm._discounts([sum(n == k for n in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, before))
        after = collections.defaultdict(list)
        for (b, _), n in pairs.items():
            after[b].append(n)
        left = sum(d1[min(n, 3)] for n in before.values())

        def p(b, c):
            k, s = before[c], sum(before.values())
            one = ((k - d1[min(k, 3)]) + left / size) / s if s else 1 / size
            n, s = pairs[b, c], sum(after[b])
            return (n - d2[min(n, 3)]) / s + sum(d2[min(m, 3)] for m in after[b]) / s * one if s else one

        return p

    size = len(known) + 1
    models = [estimate([t for t, inside in docs if inside or not only], size) for only in (True, False)]
    return [(len(t), *(-sum(math.log(p(b, c) / (rare if c == "<?>" else 1)) for b, c in zip(["<s>", *t], t)) for p in models)) for t, _ in docs]


def some_texts(n=60, seed=3):
    draw = random.Random(seed)
    return [" ".join(f"w{int(draw.paretovariate(0.7))}"[:5] + draw.choice(["", "", ",", ".", "%"]) for _ in range(draw.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize(("vocabulary", "hot", "bucket", "piece"), [(1 << 20, 1 << 19, 1 << 20, 1 << 22), (20, 10, 50, 200), (0, 0, 1000, 1)])
def test_losses_are_those_by_force(spark, monkeypatch, vocabulary, hot, bucket, piece):
    """With one bucket of pairs and with many, and with common pairs scored on the way or not."""
    for name, value in (("VOCABULARY", vocabulary), ("HOT_PAIRS", hot), ("BUCKET", bucket), ("SLICE", piece)):
        monkeypatch.setattr(word_lm, name, value)
    docs = [(t, i % 3 == 0) for i, t in enumerate(some_texts())]
    often = sorted(collections.Counter(w for t, _ in docs for w in split(t)).values(), reverse=True)
    least = next((n for n in range(2, often[0] + 2) if sum(x >= n for x in often) <= vocabulary))
    rows = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, inside boolean").repartition(3)
    out = lm_score.cross_entropy_difference(rows, F.col("inside")).orderBy("doc_id").collect()
    for r, (n, target, background) in zip(out, by_force(docs, least), strict=True):
        assert r["n_tokens"] == n
        assert r["target_loss"] == pytest.approx(target / max(n, 1), rel=1e-5, abs=1e-6) and r["background_loss"] == pytest.approx(background / max(n, 1), rel=1e-5, abs=1e-6)


def test_groups_have_models_of_their_own(spark):
    """Each group's losses are those of a corpus of its own."""
    texts = {g: some_texts(30, seed) for seed, g in enumerate(("de", "en", None))}
    rows = spark.createDataFrame([(f"{g}{i}", g, t) for g, own in texts.items() for i, t in enumerate(own)], "doc_id string, lang string, text string")
    model = word_lm.Model(rows, "text", group=F.col("lang"))
    out = {r["doc_id"]: (r["n_tokens"], r["loss_n"]) for r in model.losses(rows, "doc_id").collect()}
    for g, own in texts.items():
        for i, (n, _, loss) in enumerate(by_force([(t, True) for t in own])):
            assert out[f"{g}{i}"] == (n, pytest.approx(loss, rel=1e-5))


def test_probabilities_add_up(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(some_texts())], "doc_id long, text string")
    model = word_lm.Model(rows, "text", flag=F.col("doc_id") % 2 == 0)
    counted = {r["code"]: r for r in model.counts().collect()}
    following = np.arange(model.lexicon.size + 1)
    for x in "nt":
        for b in range(len(model.lexicon.group)):
            code = (b << word_lm.BITS) + following
            n = np.array([counted[c][x] if c in counted else 0 for c in code.tolist()])
            one = np.where(following < model.lexicon.size, 1, np.exp(model.lexicon.log_rare[0]))
            assert (one * np.exp(-model.values[x].losses(code, n))).sum() == pytest.approx(1, rel=1e-5)


def test_sealed_arrays():
    for x in ([], [0, 0, 0], [1, 255, 256], [2**62, 0]):
        assert word_lm.unseal(word_lm.seal(np.array(x, np.int64))).tolist() == x


def test_topics_differ_in_any_script(spark):
    topics = [("кошка спит на окне", "поезд идет на север"), ("ἡ θάλασσα καὶ ὁ ἄνεμος", "ὁ βίος ἐστὶ μικρός"), ("猫在窗台上睡觉", "火车向北方行驶"), ("😀😃😄", "🚂🚃🚄")]
    for one, other in topics:
        rows = spark.createDataFrame([(i, one if i % 2 else other) for i in range(12)], "doc_id long, text string")
        score = {r["doc_id"] % 2: r["score"] for r in lm_score.cross_entropy_difference(rows, F.col("doc_id") % 2 == 1).collect()}
        assert score[1] < score[0] - 0.1


def test_word_order_counts_and_the_model_grows(spark):
    plain = [f"{a} sees {b}" for a in ("anna", "ben", "carl") for b in ("dora", "emil", "fritz")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*plain * 3, "dora anna sees"])], "doc_id long, text string")
    loss = {r["doc_id"]: r["background_loss"] for r in lm_score.cross_entropy_difference(rows, F.lit(True)).collect()}
    assert loss[27] > loss[0] + 0.3
    for n in (100, 10_000):
        many = spark.range(n).selectExpr("id AS doc_id", "concat('word', id div 2, ' next') AS text")
        assert word_lm.Model(many, "text").counts().count() == n
