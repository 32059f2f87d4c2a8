"""Running sums along an order without a window over a whole group.

Each row has a bin, a number that never falls along the order and depends on the row alone. Rows are ordered within
their group's bins, and a bin starts from the sums of the bins before it, so a group with a third of all rows spans
as many tasks as it has bins. Bins are fixed by the rows' values: what is computed again after a lost executor agrees
with what was there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 4096  # bins of confidence


def lot(digest: Column, digits: int = 2) -> Column:
    """The first hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def by_confidence() -> tuple[Column, list[Column]]:
    """Bin and order of predictions: by confidence from the highest, ties by image and number. Equal confidences share
    a bin, so a detector that gives one value to a third of all boxes has these ordered in one task."""
    step = F.floor((1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))) * STEPS)
    return step, [F.col("confidence").desc(), F.col("image_id"), F.col("pred_idx")]


def running(rows: DataFrame, group: Sequence[str], bin_: Column, order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """rows with the sums of {new column: summed column} over the rows of their group up to and with themselves.

    ``order`` has to tell the rows of a group apart, and the bin must not fall along it.
    """
    dealt = rows.withColumn("_bin", bin_)
    keys = [*group, "_bin"]
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    part = dealt.groupBy(*keys).agg(*[F.sum(v).alias(f"_own_{k}") for k, v in sums.items()])
    part = part.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[F.coalesce(F.sum(f"_own_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"_in_{k}": F.sum(v).over(inside) for k, v in sums.items()})
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = own.join(part, same)
    return joined.select(*[F.col(c) for c in rows.columns], *[(F.col(f"_off_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])
