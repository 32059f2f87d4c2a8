import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators import decisions, duplicates, matching, metrics, quota, ranking, rollups, splits
from gridlark.sources import labels, sinks

BOX = "class_id int, xc double, yc double, w double, h double"


def truth(spark, rows):
    return spark.createDataFrame(rows, f"image_id long, gt_idx long, {BOX}")


def predictions(spark, rows):
    return spark.createDataFrame(rows, f"image_id long, pred_idx long, {BOX}, confidence double")


def test_second_prediction_of_a_box_is_false_in_the_match_but_not_mined(spark):
    t = truth(spark, [(1, 0, 3, 0.5, 0.5, 0.2, 0.2)])
    p = predictions(spark, [(1, 0, 3, 0.5, 0.5, 0.2, 0.2, 0.9), (1, 1, 3, 0.5, 0.5, 0.2, 0.2, 0.8)])
    assert [r.is_tp for r in matching.greedy_match(p, t).orderBy("pred_idx").collect()] == [True, False]
    assert matching.false_positives(p, t).count() == 0


def test_tie_takes_the_first_box(spark):
    t = truth(spark, [(1, 1, 3, 0.6, 0.5, 0.2, 0.2), (1, 0, 3, 0.4, 0.5, 0.2, 0.2)])
    p = predictions(spark, [(1, 0, 3, 0.5, 0.5, 0.2, 0.2, 0.9)])
    assert matching.greedy_match(p, t, (0.3,)).first().gt_idx == 0


def iou(a, b):
    w = max(0, min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2))
    h = max(0, min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def plain_matches(t, p, floor):
    """Take predictions above a floor one by one."""
    out, used = {}, set()
    for r in sorted((x for x in p if x[-1] >= floor), key=lambda x: (-x[-1], x[0], x[1])):
        best, at = 0.0, None
        for g in sorted(t):
            if g[0] == r[0] and g[2] == r[2] and (g[0], g[1]) not in used and iou(r[3:7], g[3:7]) > best:
                best, at = iou(r[3:7], g[3:7]), (g[0], g[1])
        out[r[0], r[1]] = best >= 0.5
        if best >= 0.5:
            used.add(at)
    return out


def test_one_pass_serves_all_confidence_floors(spark):
    rng = random.Random(5)
    t = [(i, k, rng.randint(0, 1), rng.uniform(0.3, 0.6), rng.uniform(0.3, 0.6), 0.3, 0.3) for i in range(12) for k in range(4)]
    p = [(i, k, rng.randint(0, 1), rng.uniform(0.3, 0.6), rng.uniform(0.3, 0.6), 0.3, 0.3, rng.choice([0.1, 0.4, 0.7, 0.9])) for i in range(12) for k in range(7)]
    got = {(r.image_id, r.pred_idx): (r.is_tp, r.confidence) for r in matching.greedy_match(predictions(spark, p), truth(spark, t)).collect()}
    for floor in (0.0, 0.4, 0.8):
        assert plain_matches(t, p, floor) == {k: v[0] for k, v in got.items() if v[1] >= floor}


def test_average_precision_by_hand(spark):
    curve_rows = [(1, 0, 3, 0.9, True), (1, 1, 3, 0.8, False), (1, 2, 3, 0.7, True)]
    m = spark.createDataFrame(curve_rows, "image_id long, pred_idx long, class_id int, confidence double, is_tp boolean").withColumn("hits", F.col("is_tp").cast("int"))
    counts = spark.createDataFrame([(3, 2), (4, 1)], "class_id int, gt long")
    rows = {r.class_id: r for r in metrics.average_precision(m, counts, (0.5,)).collect()}
    assert rows[3].ap == pytest.approx((51 + 50 * 2 / 3) / 101)
    assert (rows[3].precision, rows[3].recall) == pytest.approx((2 / 3, 1))
    assert (rows[4].ap, rows[4].precision, rows[4].recall) == (0, 0, 0)


def test_masks_are_the_greedy_match_at_each_threshold(spark):
    rng = random.Random(11)
    at = lambda: rng.uniform(0.3, 0.5)
    t = [(i, k, rng.randint(0, 1), at(), at(), 0.3, 0.3) for i in range(15) for k in range(rng.randint(1, 4))]
    p = [(i, k, rng.randint(0, 1), at(), at(), 0.3, 0.3, rng.choice([0.1, 0.4, 0.7, 0.9])) for i in range(15) for k in range(7)]
    steps = (0.5, 0.6, 0.75, 0.9)
    masks = {(r.image_id, r.pred_idx): r.hits for r in matching.hit_masks(predictions(spark, p), truth(spark, t), steps).collect()}
    want = dict.fromkeys(masks, 0)
    for r in matching.greedy_match(predictions(spark, p), truth(spark, t), steps).collect():
        want[r.image_id, r.pred_idx] |= r.is_tp << steps.index(r.iou_thr)
    assert len(masks) == len(p) and masks == want and len(set(want.values())) > 3


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(spark, parts):
    rng = random.Random(12)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(parts)
    got = {r.k: (r.v, r.s) for r in ranking.running(df, ["g"], -F.floor(F.col("k") / 7), [F.col("k").desc()], {"s": "v"}).collect()}
    sums: dict = {}
    for g, k, v in reversed(rows):
        sums[g] = sums.get(g, 0) + v
        assert got[k] == (v, sums[g])
    assert ranking.running(df.where("false"), ["g"], F.col("k"), [F.col("k")], {"s": "v"}).count() == 0


def test_a_baseline_of_several_rows_is_an_error(spark):
    rows = spark.createDataFrame([("base", 1.0), ("other", 3.0)], "variant string, f1 double")
    assert {r.variant: r.delta_f1 for r in rollups.deltas(rows, "variant", "base", ["f1"]).collect()} == {"base": 0.0, "other": 2.0}
    assert rollups.deltas(rows, "variant", "none", ["f1"]).count() == 0
    with pytest.raises(Exception, match="several rows"):
        rollups.deltas(rows.union(rows), "variant", "base", ["f1"]).collect()


def test_sweep_without_predictions(spark):
    m = spark.createDataFrame([], "class_id int, confidence double, is_tp boolean")
    counts = spark.createDataFrame([(3, 4)], "class_id int, gt long")
    row = metrics.sweep(m, counts, (0.5,)).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall, row.f1) == (0, 0, 4, 0, 0, 0)


def test_first_threshold_of_equals_is_best(spark):
    m = spark.createDataFrame([(3, 0.9, True)], "class_id int, confidence double, is_tp boolean")
    counts = spark.createDataFrame([(3, 1)], "class_id int, gt long")
    assert metrics.best_threshold(metrics.sweep(m, counts, (0.2, 0.5))).first().threshold == 0.2


LINES = ["3 .5 .5 .2 .2", "3.9 .5 .5 .2 .2", "3 1.2 .5 .2 .2", "3 .5 .5 0 .2", "9 .5 .5 .2 .2", "3 .5 .5 .2", "x .5 .5 .2 .2", ""]


def test_label_lines(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(LINES)], "image_id long, line_no int, line string")
    got = labels.strict_counts(rows).first()
    assert (got.valid, got.bad, got.boxes_ripe) == (2, 6, 2)
    assert labels.strict_counts(rows, skip_blank=True).first().bad == 5
    assert labels.lenient(rows).count() == 4


def test_label_files_round_trip(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "a.txt").write_text("3 0.5 0.5 0.25 0.25\n4 0.1 0.1 0.05 0.05\n")
    boxes = labels.lenient(labels.label_lines(spark, str(folder))).withColumn("gt_idx", F.col("line_no"))
    assert sinks.label_text(boxes).first().text == "3 0.500000 0.500000 0.250000 0.250000\n4 0.100000 0.100000 0.050000 0.050000"


def test_quota_admits_by_quality(spark):
    rows = [(0, 1, 3, 0.9), (0, 2, 3, 0.8), (0, 2, 4, 0.8), (0, 3, 4, 0.7)]
    df = spark.createDataFrame([(g, i, c, q, True) for g, i, c, q in rows], "group long, image_id long, class_id int, quality_score double, accepted boolean")
    got = {r.image_id: r.selected for r in quota.class_quota(df, images_per_class=1).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_group_split(spark):
    rows = spark.createDataFrame([(g,) for g, n in (("a", 9), ("b", 5), ("c", 3), ("d", 1)) for _ in range(n)], "g string")
    assert {r.g: r.split for r in splits.group_split(rows, "g").collect()} == {"a": "train", "b": "train", "c": "valid", "d": "test"}


def test_calibration_split_is_disjoint_and_full(spark):
    rows = [(str(i), [i % 3, (i + 1) % 3] if i % 2 else [i % 3], 1 + i % 4) for i in range(30)]
    got = splits.calibration_split(spark.createDataFrame(rows, "group string, classes array<int>, size long"), 5, 1).collect()
    taken = {r.group for r in got if r.split == "calibration"}
    assert len(got) == 30 and taken
    for c in range(3):
        assert sum(s for g, cs, s in rows if g in taken and c in cs) >= 5


def test_choose_groups_is_disjoint():
    test, valid = splits.choose_groups([("a", {0: 5, 1: 5}), ("b", {0: 1}), ("c", {1: 3}), ("d", {0: 2, 1: 2})])
    assert test and valid and not set(test) & set(valid)


@pytest.mark.parametrize("limit", [0, 5, 12])
def test_hash_duplicates_match_brute_force(spark, limit):
    rng = random.Random(2)
    base = [rng.getrandbits(62) for _ in range(12)]
    rows = []
    for i in range(60):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 9)):
            h ^= 1 << rng.randint(0, 61)
        rows.append((i, i % 3, h & 0xFFFFFFFF, h >> 32))
    got = {(r.left_id, r.right_id, r.distance) for r in duplicates.by_hash(spark.createDataFrame(rows, "image_id long, dataset int, h0 long, h1 long"), ["h0", "h1"], limit).collect()}
    want = set()
    for a in rows:
        for b in rows:
            d = bin((a[2] ^ b[2]) | ((a[3] ^ b[3]) << 32)).count("1")
            if a[0] < b[0] and a[1] != b[1] and d <= limit:
                want.add((a[0], b[0], d))
    assert got == want


def test_safe_target():
    assert sinks.safe_target("/data/out/x", "/data/out") == "/data/out/x"
    for bad in ("/data/out", "/data/out/../y", "/etc", "/"):
        with pytest.raises(ValueError):
            sinks.safe_target(bad, "/data/out")
