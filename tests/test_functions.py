import random

import pytest
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import catalog, hashes, names


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit_box(x, y, w, h):
    return B.Box(*[F.lit(float(v)) for v in (x, y, w, h)])


@pytest.mark.parametrize(("other", "want"), [((0.5, 0.5, 0.2, 0.2), 1.0), ((0.6, 0.5, 0.2, 0.2), 1 / 3), ((0.9, 0.9, 0.1, 0.1), 0.0), ((0.5, 0.5, 0.0, 0.0), 0.0)])
def test_iou(spark, other, want):
    assert one(spark, B.iou(lit_box(0.5, 0.5, 0.2, 0.2), lit_box(*other))) == pytest.approx(want)


def test_quality_of_a_good_box(spark):
    score, reasons = B.quality(F.lit(3), F.lit(0.55), F.lit(0.55), lit_box(0.5, 0.5, 0.2, 0.2), F.lit(None).cast("int"))
    assert one(spark, score) == pytest.approx(0.955)
    assert one(spark, reasons) == []


def test_dynamic_threshold(spark):
    assert one(spark, B.dynamic_threshold(F.lit(0.40))) == pytest.approx(0.70)
    assert one(spark, B.dynamic_threshold(F.lit(None).cast("double"))) == pytest.approx(0.55)


def test_undo_views(spark):
    box = lit_box(0.2, 0.3, 0.1, 0.2)
    got = [one(spark, F.array(*[getattr(B.undo_view(F.lit(k), box), c) for c in "xywh"])) for k in ("identity", "hflip", "vflip")]
    assert got == [pytest.approx(x) for x in ([0.2, 0.3, 0.1, 0.2], [0.8, 0.3, 0.1, 0.2], [0.2, 0.7, 0.1, 0.2])]


@pytest.mark.parametrize(("raw", "want"), [("Under-Ripe", "under_ripe"), ("FFB", None), ("masak", "ripe"), ("zzz", None), (" over ripe ", "overripe")])
def test_class_names(spark, raw, want):
    assert one(spark, catalog.canonical_class(F.lit(raw))) == want


@pytest.mark.parametrize(("path", "scene", "base"), [("a/Clip12_IMG_003.jpg", "Clip12", "clip12_img_003"), ("b/src1_A-b_jpg.rf.abc.jpg", "src1_A-b", "a_b"), ("x/123.png", "123", "123")])
def test_names(spark, path, scene, base):
    assert one(spark, names.scene_group(F.lit(path))) == scene
    assert one(spark, names.base_name(F.lit(path))) == base


def test_path_class_and_split(spark):
    assert one(spark, names.path_class(F.lit("r/FFBtest/UnRipe/1.jpg"))) == 5
    assert one(spark, names.path_split(F.lit("r/FFBtest/UnRipe/1.jpg"))) == "test"
    assert one(spark, names.path_split(F.lit("r/latest/ripe/1.jpg"))) == "unknown"


def test_parsers(spark):
    assert one(spark, names.parsed_map(F.lit("Ripe=0.5, unripe = 0.6,"))) == {"ripe": 0.5, "unripe": 0.6}
    assert one(spark, names.parsed_numbers(F.lit("0.1, 0.2,"))) == [0.1, 0.2]


def test_probes_meet_once_a_piece_within_its_radius(spark):
    rng = random.Random(6)
    for distance, bits in ((0, 64), (1, 64), (5, 64), (8, 64), (12, 64), (3, 32)):
        cut = hashes.pieces(distance, bits)
        assert sum(p.radius + 1 for p in cut) == distance + 1 and cut[0].low == 0 and cut[-1].high == bits
        pairs = []
        for _ in range(40):
            a = rng.getrandbits(bits)
            pairs.append((a, a ^ sum(1 << k for k in rng.sample(range(bits), rng.randint(0, min(bits, distance + 6))))))
        limbs = lambda x: [x >> 32 * i & 0xFFFFFFFF for i in range(bits // 32)]
        names = [f"{s}{i}" for s in "lr" for i in range(bits // 32)]
        rows = spark.createDataFrame([(*limbs(a), *limbs(b)) for a, b in pairs], ", ".join(f"{n} long" for n in names))
        sides = [hashes.probes([F.col(n) for n in names if n[0] == s], cut, s == "r") for s in "lr"]
        for (a, b), r in zip(pairs, rows.select(*sides).collect(), strict=True):
            near = sum(bin((a ^ b) >> p.low & (1 << p.high - p.low) - 1).count("1") <= p.radius for p in cut)
            assert len(set(r[0]) & set(r[1])) == near and (near > 0 or bin(a ^ b).count("1") > distance)
            assert len(set(r[0])) == len(r[0]) and len(set(r[1])) == len(r[1])
    assert sum(p.share() for p in hashes.pieces(12)) < 0.01


def test_hash_distance(spark):
    assert one(spark, hashes.hamming([F.lit(10)], [F.lit(8)])) == 1
