"""Texts in no learned language go, whatever the softmax says; those in a learned one stay."""

import random

import pytest
from factloom.llm import language

MORE = {
    "en": "the of and thing with water over house light stone there which when people under morning garden",
    "de": "der und nicht haus über wasser licht stein groß werden können zwischen straße morgen garten immer",
    "fr": "le les été maison eau pierre lumière avec où quand dans jardin toujours matin entre être",
    "fi": "talo vesi kivi valo kun tyttö lukee kirjaa keittiössä koko perhe aina välillä aamu puutarha",
}


@pytest.mark.parametrize("unseen", ["de", "fi"])
def test_unseen_languages_and_noise_go(unseen):
    rnd = random.Random(9)
    said = {k: v.split() for k, v in MORE.items()}
    text = lambda lang: " ".join(rnd.choice(said[lang]) for _ in range(rnd.randrange(15, 60)))
    learned = [k for k in sorted(said) if k != unseen]
    model = language.fit([(lang, *language.features(text(lang))) for _ in range(200) for lang in learned])
    accepted = lambda texts: sum(language.Predictor(model).predict(texts)[2]) / len(texts)
    clean = [text(lang) for _ in range(50) for lang in learned]
    assert accepted(clean) >= 0.98
    assert accepted([text(unseen) for _ in range(100)]) <= 0.02
    assert accepted(["".join(rnd.sample(t, len(t))) for t in clean]) <= 0.02
    assert accepted([text(unseen).encode().decode("latin-1") for _ in range(100)]) <= 0.02


def test_one_learned_language_refuses_others():
    rnd = random.Random(4)
    said = {k: v.split() for k, v in MORE.items()}
    text = lambda lang: " ".join(rnd.choice(said[lang]) for _ in range(40))
    model = language.fit([("en", *language.features(text("en"))) for _ in range(300)])
    predict = language.Predictor(model).predict
    assert sum(predict([text("en") for _ in range(100)])[2]) >= 98
    assert sum(predict([text("fi") for _ in range(100)])[2]) <= 2


def test_the_bound_holds_for_equal_and_null_keys(spark):
    """Rows of one key, without a key, or repeated don't send more than the bound."""
    rnd = random.Random(2)
    said = {k: v.split() for k, v in MORE.items()}
    text = lambda lang: " ".join(rnd.choice(said[lang]) for _ in range(12))
    rows = [(None if i % 3 else 7, text(lang), lang) for i in range(400) for lang in ("en", "de")] + [(1, "the same text", "en")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.training_rows(df, rows=100)
    assert len(got) == 100 and {r[0] for r in got} == {"en", "de"}
    assert len(language.training_rows(df, rows=5000)) == len({(k, t, lang) for k, t, lang in rows})
    assert language.training_rows(df.filter("lang is null")) == []
