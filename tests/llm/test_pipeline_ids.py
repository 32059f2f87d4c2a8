"""Stages of the pipeline on rows of null or repeated ids."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string"


def text(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))


def test_null_and_repeated_ids_are_judged_by_their_texts(spark):
    a, b, c, d = map(text, range(4))
    rows = [
        *[(None, a, "en")] * 4,  # copies without an id: one stays
        (7, b, "en"), (None, b, "en"), (None, b + " extra", "fr"),  # the id comes first
        (3, c, "en"), (3, d, "en"), (3, d, "fr"),  # different texts under one id stay, equal ones are one document
        (9, c, "en"),
        (5, "", "en"), (5, "", "en"), (5, None, "en"), (5, None, "en"),
        (None, "", "en"), (None, "", "en"),
    ]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    want = [(None, a), (7, b), (3, c), (3, d), (5, ""), (5, None), (None, ""), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)


def test_unique_ids_are_as_before(spark):
    a, b = text(1), text(2)
    docs = spark.createDataFrame([(4, a, "en"), (2, a, "en"), (1, b, "en"), (6, None, "en")], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 2, 6]


# Every name that a stage or what it calls makes for itself, in any letters.
OWN = (
    "lang_pred lang_score Lang_Mix _key _KEY key _copy _copies _rest rest _like _n _one _part _tie like n one row component n_shingles "
    "_n_words _items _spans _ratio _u _draw _before _epochs target taken size digest quality_weight source_size rep bands shown none first "
    "_h shard slot hilbert text_crc32 _rank off__rank in__rank _doc_id a.b"
).split()


@pytest.mark.parametrize("doubtful", [False, True])
def test_extra_columns_of_any_name_stay_as_they_are(spark, tmp_path, doubtful):
    own = {c.lower(): c for c in OWN}.values()
    ids = [1, 2, 3, 3, None] if doubtful else [1, 2, 3, 4, 5]
    rows = [(i, text(n), "en", f"s{n % 2}", 7) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(c), F.lit(":"), F.md5("text")).alias(c) for c in own])
    spark.createDataFrame([("x", text(77))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows, name
        for r in rows:
            check = r.asDict()
            assert all(check[c].startswith(f"{c}:") and len(check[c]) == len(c) + 33 for c in own), name
            assert len({check[c].split(":")[1] for c in own}) == 1, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 5
