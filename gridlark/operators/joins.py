"""Joins that an equality of columns doesn't say: numbers within a tolerance, and first rows of a list with a fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.tables import fresh

#: A cell's width in tolerances: a value in a thousand lies near an edge and is in two cells.
_CELL = 4096.0


def within_tolerance(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Rows of both sides whose values differ by less than the tolerance, and whose columns ``on`` are equal. how: inner or left.

    Each left value is in one cell of a grid, each right one in its cell and, near an edge, in the next one, so a pair meets once, in an
    equi-join on the cell. Null, NaN and infinite values are near nothing. Other column names of the two sides have to differ.
    """
    cell, = fresh([*left.columns, *right.columns], "_cell")
    width = tolerance * _CELL
    finite = lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))
    at = lambda v: F.floor(v / width).cast("double")
    a, b = F.col(left_value).cast("double"), F.col(right_value).cast("double")
    l = left.withColumn(cell, F.when(finite(a), at(a)))  # noqa: E741
    # twice the tolerance, so that no rounding of the cells can part a pair
    r = right.withColumn(cell, F.explode(F.when(finite(b), F.array_distinct(F.array(at(b - 2 * tolerance), at(b + 2 * tolerance)))).otherwise(F.array().cast("array<double>"))))
    l, r = l.alias("l"), r.alias("r")
    same = F.col(f"l.{cell}") == F.col(f"r.{cell}")
    for c in on:
        same &= F.col(f"l.`{c}`") == F.col(f"r.`{c}`")
    same &= F.abs(F.col(f"l.`{left_value}`").cast("double") - F.col(f"r.`{right_value}`").cast("double")) < tolerance
    own = [F.col(f"l.`{c}`") for c in left.columns]
    return l.join(r, same, how).select(*own, *[F.col(f"r.`{c}`") for c in right.columns if c not in on])


def first_listed(rows: DataFrame, key: str, order: Sequence[str | Column], listed: DataFrame, listed_order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows whose key is listed, in the order of the list (a key listed twice gives its row twice); the first n rows
    by their own order if none is. With place, from 1.

    Both choices are cut to n rows before one is left out, all in one plan. listed has the column of the key, and what its order names.
    """
    kind, place, at = fresh([*rows.columns, *listed.columns], "_kind", "place", "_at")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    wanted = listed.select(F.col(key), F.struct(*[c if isinstance(c, Column) else F.col(c) for c in listed_order]).alias(at)).where(F.col(key).isNotNull())
    hits = rows.join(wanted, key).orderBy(at).limit(n)
    ranked = lambda df, by, which: df.select(*columns, F.row_number().over(Window.orderBy(*by)).alias(place), F.lit(which).alias(kind))
    # windows over at most n and 2 * n rows
    both = ranked(hits, [at], 0).unionByName(ranked(rows.orderBy(*order).limit(n), order, 1))
    least = F.min(kind).over(Window.partitionBy(F.lit(0)))
    return both.withColumn(at, least).where(F.col(at) == F.col(kind)).select(*columns, place)
