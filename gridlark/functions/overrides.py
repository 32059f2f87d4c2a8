"""Texts that set something for single classes, as columns: a text that can't be read is an error of the query, not a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.catalog import class_id


def _items(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda e: F.trim(e)), lambda e: e != "")


def _wrong(what: str, item: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), item))


def _class(name: Column) -> Column:
    found = class_id(F.trim(name))
    return F.when(found.isNull(), _wrong("unknown class", name).cast("int")).otherwise(found)


def _last_of_each(pairs: Column) -> Column:
    """A map of pairs (k, v); of pairs of one key the last counts."""
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<int>"), F.transform(F.slice(pairs, 1, 0), lambda p: p["v"])), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def class_values(text: Column) -> Column:
    """``abnormal=0.45, under_ripe=0.5`` as a map from class ids to numbers; empty text and null are an empty map."""

    def pair(item: Column) -> Column:
        name, value = F.substring_index(item, "=", 1), F.trim(F.regexp_extract(item, r"(?s)^[^=]*=(.*)$", 1))
        key = F.when(~F.contains(item, F.lit("=")), _wrong("expected class=value", item).cast("int")).otherwise(_class(name))
        number = value.try_cast("double")
        return F.struct(key.alias("k"), F.when(number.isNull(), _wrong("no number", item).cast("double")).otherwise(number).alias("v"))

    return _last_of_each(F.transform(_items(text), pair))


def class_counts(text: Column) -> Column:
    """As class_values, cut to whole numbers."""
    return F.transform_values(class_values(text), lambda _, v: v.cast("int"))


def class_set(text: Column) -> Column:
    """``ripe, unripe`` as the sorted array of class ids."""
    return F.array_sort(F.array_distinct(F.transform(_items(text), _class)))


def class_sources(text: Column) -> Column:
    """``under_ripe:unripe|ripe, abnormal:empty`` as a map from class ids to sorted arrays of class ids."""

    def pair(item: Column) -> Column:
        target, sources = F.substring_index(item, ":", 1), F.regexp_extract(item, r"(?s)^[^:]*:(.*)$", 1)
        key = F.when(~F.contains(item, F.lit(":")), _wrong("expected target:source|source", item).cast("int")).otherwise(_class(target))
        return F.struct(key.alias("k"), F.array_sort(F.array_distinct(F.transform(F.split(sources, r"\|"), _class))).alias("v"))

    return _last_of_each(F.transform(_items(text), pair))
