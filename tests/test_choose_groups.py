import pytest

from gridlark.operators import splits

COUNTS = [("a", {0: 5, 1: 5}), ("b", {0: 5, 1: 5}), ("c", {0: 1, 1: 1}), ("d", {0: 30, 1: 30})]


def test_images_decide_where_classes_tie():
    # every group holds both classes: of the choices with 1200 test and 800 valid images, 1200 is next to a fifth of 2350; by
    # shares of boxes others win
    images = {"a": 1100, "b": 900, "c": 300, "d": 50}
    assert splits.choose_groups(COUNTS, images) == (["b", "c"], ["a"])


def test_count_next_to_a_fifth_of_all_is_last():
    images = {"a": 3000, "b": 1300, "c": 5000, "d": 4000}  # a fifth is 2660, above 1200 all tie
    assert splits.choose_groups(COUNTS, images) == (["a"], ["b"])


def test_classes_outside_the_catalog_do_not_count():
    test, _ = splits.choose_groups([("a", {7: 1, 8: 1}), ("b", {0: 1}), ("c", {1: 1})], {"a": 1, "b": 1, "c": 1})
    assert set(test) >= {"b"} or set(test) >= {"c"}
    with pytest.raises(ValueError):
        splits.choose_groups([("a", {0: 1})], {"a": 1})


def test_counts_are_made_in_spark(spark):
    images = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "image_id long, g string")
    boxes = spark.createDataFrame([(1, 0), (1, 0), (2, 3)], "image_id long, class_id int")
    counts, sizes = splits.group_counts(images, boxes, "g")
    assert dict(counts) == {"a": {0: 2, 3: 1}, "b": {}} and sizes == {"a": 2, "b": 1}
