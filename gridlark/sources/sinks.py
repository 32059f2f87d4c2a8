"""Sinks: tables as CSV, label text, JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_of_columns(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the columns of any, in the order they are first seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def header(rows: DataFrame) -> DataFrame:
    """key, place (from 0) of ragged rows (row, cells as an array of key and value): keys in the order in which they are first seen."""
    seen = rows.select("row", F.posexplode("cells").alias("at", "cell")).groupBy(F.col("cell.key").alias("key")).agg(F.min(F.struct("row", "at")).alias("first"))
    # a row per column
    return seen.select("key", (F.row_number().over(Window.orderBy("first")) - 1).alias("place"))


def from_ragged(rows: DataFrame) -> DataFrame:
    """row and a text column for every key of ragged rows, in the order in which keys are first seen; a cell that a row lacks is empty,
    of a key that a row has twice the last value counts."""
    keys = [r["key"] for r in header(rows).orderBy("place").collect()]  # the columns of the table to come
    cells = rows.select("row", F.map_from_entries(F.expr("filter(cells, (c, i) -> not exists(slice(cells, i + 2, size(cells)), d -> d.key = c.key))")).alias("m"))
    return cells.select("row", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")).alias(k) for k in keys])


def csv_line(columns: list[str]) -> Column:
    """Columns as one line of CSV: quotes around what has a quote, a comma or a line end."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))
    return F.concat_ws(",", *[quoted(f"`{c}`") for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def label_text(boxes: DataFrame) -> DataFrame:
    """image_id, text: a line ``class xc yc w h`` of six decimals for each box, in the order of gt_idx."""
    number = lambda c: F.replace(F.format_number(F.bround(c, 6), 6), F.lit(","), F.lit(""))
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *[number(c) for c in ("xc", "yc", "w", "h")])
    return boxes.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gt_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def event_json(time: Column, event: Column, payload: Column) -> Column:
    """One line of an event log: time, event and the payload's fields."""
    return F.to_json(F.struct(time.alias("time"), event.alias("event"), payload.alias("payload")))


def safe_target(path: str, root: str) -> str:
    """The path if it lies under the root and isn't the root itself; overwriting anything else is an error."""
    clean = path.rstrip("/")
    if ".." in clean.split("/") or not clean.startswith(root.rstrip("/") + "/") or root.rstrip("/") in ("", "~"):
        raise ValueError(f"not below {root}: {path}")
    return clean


def command_line(command: Column) -> Column:
    """An argument array as one line; arguments with spaces are quoted."""
    return F.array_join(F.transform(command, lambda a: F.when(a.contains(" "), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)), " ")


def checksums(files: DataFrame) -> DataFrame:
    """path, length, sha256 of binary files."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
