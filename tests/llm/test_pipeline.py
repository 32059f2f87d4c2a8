"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gridlark.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    pools = {"en": ["the", "ing", "tion", "ly"], "fr": ["eux", "que", "ment", "é"]}
    say = lambda k, n: " ".join("".join(rng.choices(pools[k], k=rng.randint(1, 4))) for _ in range(n))
    items = [(i, say("en", 20)) for i in range(4)]
    rows = []
    for i in range(80):
        k = "en" if i % 3 else "fr"
        t = say(k, rng.randint(20, 90))
        if i % 10 == 0:
            t += " " + items[i % 4][1] + " " + say(k, 8)
        rows.append((i, t, k, f"s{i % 3}", len(t)))
    rows += [(100 + j, rows[j][1], rows[j][2], "s0", 1) for j in range(5)]
    near = rows[1][1].split()
    rows += [(200, " ".join([*near, "extra"]), "en", None, 1), (201, None, "en", "s1", 0), (202, "", None, "s1", 0), (203, "12 !!", None, "s2", 5), (204, items[0][1], "en", "s2", 9)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, folder):
    ws = Workspace(spark, "pipeline-test")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(ws.table(stage(spark, steps[-1], folder)))
        if name != "sharding":
            assert steps[-1].columns == columns
    start, lang, near, clean, mixed, placed = [s.collect() for s in steps]
    ids = lambda rows: {r.doc_id for r in rows}
    assert ids(start) - ids(lang) == {201, 202, 203}
    want = brute.near_duplicates([(r.doc_id, r.text) for r in lang], 5, 80)
    assert ids(near) == {d for d, v in want.items() if v[2]}
    assert ids(near) - ids(clean) == {204} & ids(near)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {" ".join(t.split()[j : j + 10]) for t in items for j in range(11)}
    before = {r.doc_id: r.text for r in near}
    for r in clean:
        assert not any(w in r.text for w in windows) and r.n_chars == len(r.text)
        if not any(w in before[r.doc_id] for w in windows):
            assert r.text == before[r.doc_id]
    assert ids(mixed) <= ids(clean) and max(sum(1 for r in mixed if r.doc_id == d) for d in ids(mixed)) <= 3
    assert len(placed) == len(mixed)
    assert sorted((r.doc_id) for r in placed) == sorted(r.doc_id for r in mixed)
    assert corpus_pipeline.run(spark, folder).select(F.count("*")).first()[0] == len(placed)


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
