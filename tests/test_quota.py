"""Class quotas against the fold."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridlark.operators import quota


def fold(boxes, images, per_class, overrides):
    """{(group, image): selected} by the plain fold. boxes: (group, image, class, accepted, quality)."""
    held: dict = {}
    for g, i, c, ok, q in boxes:
        if ok:
            held.setdefault(g, {}).setdefault(i, []).append((c, q))
    out = {}
    for g, own in held.items():
        order = sorted(own, key=lambda i: (-round(sum(q for _, q in own[i]) / len(own[i]), 9), i))
        seen, used = Counter(), Counter()
        for i in order:
            n = Counter(c for c, _ in own[i])
            ok = images <= 0 or all(seen[c] < images for c in n)
            limit = {c: overrides.get(c, per_class) for c in n}
            ok = ok and all(limit[c] <= 0 or used[c] + k <= limit[c] for c, k in n.items())
            out[g, i] = ok
            if ok:
                seen.update(n.keys())
                used.update(n)
    return out


def boxes(seed, n, groups):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice(groups)
        for _ in range(rng.randint(1, 6)):
            rows.append((g, i, rng.choice([0, 0, 0, 1, 2, 3, 4, 5]), rng.random() < 0.7, rng.choice([0.5, 0.5, 0.75, 0.875, rng.randint(0, 64) / 64])))
    return rows


CASES = [(3, 0, {}), (0, 7, {}), (5, 9, {0: 4, 3: -1}), (0, 0, {2: 1}), (1, 1, {}), (40, 300, {}), (0, 0, {})]


@pytest.mark.parametrize("bins", [2, 13])
def test_quota_is_the_fold(spark, monkeypatch, bins):
    monkeypatch.setattr(quota, "_BIN", bins)
    rows = boxes(bins, 160, ["hot"] * 6 + ["b", None, "c"])
    df = spark.createDataFrame(rows, "group string, image_id int, class_id int, accepted boolean, quality_score double").repartition(5).withColumns({"t": F.lit("clash"), "stop": F.lit(1)})
    for images, per_class, overrides in CASES[:3] if bins == 2 else CASES:
        got = {(r.group, r.image_id): r.selected for r in quota.class_quota(df, images, per_class, overrides).collect()}
        assert got == fold(rows, images, per_class, overrides), (images, per_class, overrides)


def test_demotion(spark):
    rows = [("g", 1, 0, 0, True, 0.9), ("g", 1, 1, 0, False, 0.1), ("g", 2, 0, 0, True, 0.8), ("g", 2, 1, 3, False, 0.2), ("g", 3, 0, 3, True, 0.7)]
    df = spark.createDataFrame(rows, "group string, image_id int, pred_idx int, class_id int, accepted boolean, quality_score double")
    df = df.withColumn("reasons", F.when(F.col("accepted"), F.array().cast("array<string>")).otherwise(F.array(F.lit("old"))))
    chosen = quota.class_quota(df, 1)
    for earlier in (False, True):
        got = {(r.image_id, r.pred_idx): (r.accepted, r.reasons) for r in quota.with_quota(df, chosen, earlier).collect()}
        assert got == {
            (1, 0): (True, []), (1, 1): (False, ["old"]), (2, 0): (False, [quota.REASON]),
            (2, 1): (False, ["old", quota.REASON] if earlier else ["old"]), (3, 0): (True, []),
        }


def test_empty(spark):
    df = spark.createDataFrame([], "group string, image_id int, class_id int, accepted boolean, quality_score double")
    assert quota.class_quota(df, 2).count() == 0 and quota.class_quota(df).count() == 0
