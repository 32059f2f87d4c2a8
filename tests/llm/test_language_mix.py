"""Proportions of the chosen set, and the language stage without labels."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from gridlark.llm import language

POOLS = {"en": ["the", "ing", "tion", "ly"], "fr": ["eux", "que", "ment", "oui"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choices(POOLS[lang], k=3)) for _ in range(n))


def test_without_labels_texts_with_a_letter_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !!", None), (3, None, None), (4, "", None), (5, "é", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {1, 5}


def test_proportions_of_the_chosen_set(spark):
    rng = random.Random(6)
    known = spark.createDataFrame([(i, say(rng, k, 60), k) for i in range(40) for k in POOLS], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, say(rng, "en", 80)), (2, say(rng, "en", 120) + " " + say(rng, "fr", 60)), (3, "12")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(docs, *language.learned(known)).collect()}
    assert [m.lang for m in got[1].lang_mix] == ["en"] and got[1].lang_mix[0].share == 1
    assert [m.lang for m in got[2].lang_mix] == ["en", "fr"] and sum(m.share for m in got[2].lang_mix) == pytest.approx(1)
    assert 0.5 < got[2].lang_mix[0].share < 0.85
    assert got[3].lang_mix == [] and got[3].lang_pred == "und"
