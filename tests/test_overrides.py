from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridlark.functions import overrides as O


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_overrides(spark):
    assert one(spark, O.class_values, "Abnormal=0.45, under-ripe = 1e-1,,abnormal=2") == {0: 2.0, 4: 0.1}
    assert one(spark, O.class_counts, "ripe=80.9") == {3: 80}
    assert one(spark, O.class_set, "unripe, ripe,Ripe") == [3, 5]
    assert one(spark, O.class_sources, "under_ripe:unripe|ripe, abnormal: empty") == {4: [3, 5], 0: [1]}
    for f, none in ((O.class_values, {}), (O.class_set, []), (O.class_sources, {})):
        assert one(spark, f, "") == one(spark, f, None) == one(spark, f, " , ") == none


@pytest.mark.parametrize(("f", "text"), [(O.class_values, "ripe"), (O.class_values, "rock=1"), (O.class_values, "ripe=x"), (O.class_values, "ripe="), (O.class_set, "ripe,rock"), (O.class_sources, "ripe"), (O.class_sources, "ripe:rock"), (O.class_sources, "ripe:")])
def test_what_cannot_be_read_is_an_error(spark, f, text):
    with pytest.raises(Exception, match="unknown class|expected|no number"):
        one(spark, f, text)
