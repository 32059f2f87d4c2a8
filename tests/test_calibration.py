import hashlib
import random
from collections import Counter

import pytest

from gridlark.operators import splits


def plain_fold(images, fraction, seed):
    groups = {}
    for g, classes in images:
        groups.setdefault(g, []).append(set(classes))
    keys = sorted(groups, key=lambda g: hashlib.md5(f"{seed}:{g}".encode()).hexdigest())
    held = {g: Counter(c for cs in groups[g] for c in cs) for g in keys}
    totals = sum(held.values(), Counter())
    target = {c: max(1, round(n * fraction)) for c, n in totals.items()}
    limit = max(1, round(len(keys) * fraction))
    taken, seen = set(), Counter()
    for g in sorted(keys, key=lambda g: (len(held[g]), len(groups[g])), reverse=True):
        if any(seen[c] < target[c] for c in held[g]) and len(taken) < limit:
            taken.add(g)
            seen.update(held[g])
    by_class = len(taken)
    for g in keys:
        if len(taken) >= limit:
            break
        taken.add(g)
    return taken, by_class < limit


@pytest.mark.parametrize(("seed", "fraction", "few"), [(1, 0.5, 4096), (2, 0.2, 2), (3, 0.35, 1), (4, 0.01, 4096)])
def test_split_is_the_plain_fold(spark, monkeypatch, seed, fraction, few):
    monkeypatch.setattr(splits, "_FEW", few)
    rng = random.Random(seed)
    images = []
    for g in range(60):
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            images.append((f"g{g}", rng.sample([0, 3, 4, 5], rng.choice([0, 1, 1, 2]))))
    rows = spark.createDataFrame(images, "group string, classes array<int>").repartition(5)
    got = {r.group: r.split for r in splits.calibration_fraction_split(rows, fraction, seed).collect()}
    want, _ = plain_fold(images, fraction, seed)
    assert len(got) == 60 and {g for g, s in got.items() if s == "calibration"} == want


def test_top_up_to_the_limit(spark):
    images = [("all", [0, 3, 4, 5])] * 20 + [(f"g{i}", [i % 2]) for i in range(10)] + [(f"e{i}", []) for i in range(9)]
    want, topped = plain_fold(images, 0.5, 7)
    assert topped
    rows = spark.createDataFrame(images, "group string, classes array<int>")
    assert {r.group for r in splits.calibration_fraction_split(rows, 0.5, 7).collect() if r.split == "calibration"} == want


def test_constant_quota_is_the_plain_fold(spark):
    rng = random.Random(8)
    rows = [(str(i), rng.sample(range(4), rng.randint(0, 3)), rng.randint(1, 5)) for i in range(50)]
    taken, seen = set(), Counter()
    for g, cs, n in sorted(rows, key=lambda r: (-len(r[1]), -r[2], hashlib.md5(f"1:{r[0]}".encode()).hexdigest())):
        if any(seen[c] < 12 for c in cs):
            taken.add(g)
            seen.update(dict.fromkeys(cs, n))
    got = splits.calibration_split(spark.createDataFrame(rows, "group string, classes array<int>, size long"), 12, 1).collect()
    assert {r.group for r in got if r.split == "calibration"} == taken and len(got) == 50
