import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import WORDS, rows_of, sentence
from stratakeep.llm import additive_model, decision_list, toxicity
from stratakeep.llm.statistics import FEATURES, held_out, statistics


def test_statistics_are_brute_force(spark):
    rng = random.Random(4)
    texts = [sentence(rng, n) for n in (1, 2, 3, 30)] + ["a b c a b c x", "X ###\nX ###\n\n y", "l\nl\n l\nm", "a b c", None, "", "Ü ü"]
    want = []
    for k, t in enumerate(texts):
        w = [x for x in (t or "").replace("\n", " ").split(" ") if x]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" ")]
        want.append((k, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)))
    got = statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want, key=str)


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose, and three kinds of junk; some of it insulting."""
    rng, rows = random.Random(5), []
    for k in range(900):
        words = sentence(rng, rng.randrange(60, 200)).split()
        kind = k % 6
        toxic = rng.random() < 0.3
        if kind == 0:
            words = [w + rng.choice(("###", "$$$")) for w in words]
        elif kind == 1:
            words = words[:3] * 40
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(("idiot", "zorkig", "zorkas", "zorkum")))
        rows.append((k, " ".join(words), int(kind > 1), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_rules(corpus):
    docs, labels = corpus
    rules = decision_list.fit(docs, labels)
    assert rules and all(c.feature in FEATURES for r in rules for c in r)
    got = decision_list.quality_rules(docs, rules).join(labels, "doc_id")
    assert got.where("quality = 0 and kept").count() <= 5 and got.where("quality = 1 and not kept").count() <= 5


def test_rule_order_is_the_lists():
    x = {c: np.zeros(4) for c in FEATURES}
    x["n_words"] = np.array([1.0, 5, 9, 20])
    rule = (decision_list.Condition("n_words", True, 4), decision_list.Condition("n_words", False, 10))
    assert decision_list.covered(rule, x).tolist() == [False, True, True, False] and "n_words > 4" in str(rule[0])


def test_additive_model(corpus, spark):
    docs, labels = corpus
    model = additive_model.fit_quality(docs, labels)
    got = additive_model.score_quality(docs, model).join(labels, "doc_id").withColumn("held", held_out(5, 0)).where("held").toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.97 and got.score.between(0, 1).all()
    again = additive_model.fit_quality(docs, labels)
    assert again.intercept == model.intercept and all((again.single[c] == model.single[c]).all() for c in FEATURES)


def test_pairs_find_an_interaction():
    rng = np.random.default_rng(0)
    x = {c: rng.random(3000) for c in FEATURES}
    y = ((x["n_words"] > 0.5) ^ (x["upper_share"] > 0.5)).astype(int)
    model = additive_model.fit(x, y)
    assert ("n_words", "upper_share") in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_toxicity(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    assert "zork" in model.lexicon.stems
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").withColumn("held", held_out(3, 1)).where("held").toPandas()
    assert ((got.score >= 0.7) == (got.toxic == 1)).mean() > 0.97 and got.score.between(0, 1).all()


def test_toxicity_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! you are an 1d1ot and a s.t.u.p.i.d clown", toxicity.Lexicon())))
    assert f["insult_count"] == 2 and f["hidden_count"] == 2 and f["near_second_person"] >= 1 and f["capital_share"] > 0
    assert toxicity.features(None, toxicity.Lexicon()) == toxicity.features(" ,", toxicity.Lexicon()) == [0.0] * len(toxicity.FEATURES)


def test_isotonic():
    rng = np.random.default_rng(2)
    s = rng.random(500)
    steps = toxicity.isotonic(s, (rng.random(500) < s).astype(float))
    assert (np.diff(steps[1]) >= 0).all() and (np.diff(steps[0]) >= 0).all() and abs(np.interp(0.5, *steps) - 0.5) < 0.15


@pytest.mark.parametrize("empty", [False, True])
def test_odd_input(spark, odd, labels, empty):
    docs, known = (odd.limit(0), labels.limit(0)) if empty else (odd, labels)
    n = docs.count()
    rules = decision_list.quality_rules(docs, decision_list.fit(docs, known))
    assert rules.count() == n
    quality = additive_model.score_quality(docs, additive_model.fit_quality(docs, known))
    toxic = toxicity.score_toxicity(docs, toxicity.fit(docs, known))
    for scored in (quality, toxic):
        assert scored.count() == n and scored.where("score is null or score < 0 or score > 1").count() == 0
    if not empty:
        row = rules.where("doc_id = 0").first()
        assert (row.n_words, row.base_failed, row.kept) == (0, True, False)
        assert odd.select(held_out(5, 0).alias("h")).where("h is null").count() == 0
        nothing = additive_model.fit_quality(docs, known.limit(0))
        assert additive_model.score_quality(docs, nothing).where(F.col("score") != 0.5).count() == 0
