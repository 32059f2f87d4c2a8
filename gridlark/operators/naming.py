"""Names that differ, letter case aside, given out in an order.

The rule is a loop's: a row keeps its name if no row before it has that name, else it gets the first of name_1, name_2, ..
that none has. A given name can be one that a later row brings along, so that row moves on, too. As a name with a number can
only be given to rows of the name without it, names form trees, and the loop comes apart into levels of these:

* Of the rows of one name, the first in order keeps it, unless a row of the name above got it before. The others are a
  queue, in order; the j-th of them takes the j-th number that is free.
* A number k is not free (blocked) if a row with that very name comes before the row of the queue that gets as far. With rho
  rows of the queue before it and b blocked numbers below k, that row is number k - b of the queue; so k is blocked if k - b > rho.
  Supposing too few blocked numbers gives too many and the reverse, so rounds from none enclose the truth until
  nothing moves. Every round settles at least the least open number of each name; where all rows of one name come before or after
  those of the other, it is two rounds.
* A number that is free and taken from the queue is lost to its own rows: then all of them are the next level's queue.

Ranks, blocked numbers and places are running sums over bins (operators/ranking.py), so a name that a third of all rows
have is in no one task. Rows without a name stay so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.ranking import running
from gridlark.tables import Written, fresh

#: Rows of one bin, as a power of two.
_BIN = 13


def _suffix(name: Column) -> Column:
    """From the last dot on, if something stands before and after it."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def _bare(name: Column, suffix: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix))


def _bin(number: str) -> Column:
    return F.shiftright(F.col(number), _BIN)


def unique_names(rows: DataFrame, within: str, name: str, order: Sequence[str | Column]) -> DataFrame:
    """rows with sample_name, distinct within each value of ``within`` (letter case aside). The order tells rows apart."""
    ws = Written(rows.sparkSession, "names")
    t, = fresh(rows.columns, "_t")
    numbered = ws.table(rows.orderBy(*order).withColumn(t, F.monotonically_increasing_id()))
    low = F.lower(F.col(name))
    suffix = _suffix(low)
    place = F.coalesce(F.concat(F.lit("="), F.length(F.col(within).cast("string")).cast("string"), F.lit(":"), F.col(within).cast("string")), F.lit("-"))
    key = lambda n: F.concat(place, F.lit("/"), n)
    # numbers of up to 18 digits: no table has rows enough for others to be given
    above, number = [F.regexp_extract(_bare(low, suffix), r"(?s)^(.+)_([1-9][0-9]{0,17})$", i) for i in (1, 2)]
    tail = F.regexp_extract(_bare(low, suffix), r"(?s)^.+?((?:_[1-9][0-9]{0,17})*)$", 1)
    family = F.concat(_bare(_bare(low, suffix), tail), suffix)
    parsed = numbered.where(F.col(name).isNotNull()).select(
        F.col(t).alias("t"), key(low).alias("key"), key(family).alias("family"), F.when(number != "", key(F.concat(above, suffix))).alias("above"),
        F.nullif(number, F.lit("")).cast("long").alias("k"), (F.length(tail) - F.length(F.replace(tail, F.lit("_"), F.lit("")))).alias("depth"),
    )
    nodes = parsed.groupBy("key", "family", "above", "k", "depth").agg(F.min("t").alias("first"), F.count("*").alias("n"))
    crowded = nodes.groupBy("family").agg(F.max("n").alias("most")).where("most > 1").select("family")
    nodes = ws.table(nodes.join(crowded, "family", "left_semi"))
    given = _given(ws, parsed.join(crowded, "family", "left_semi").select("t", "key"), nodes)
    end = _suffix(F.col(name))
    if given is None:
        return numbered.drop(t).withColumn("sample_name", F.col(name))
    out = numbered.join(given.select(F.col("t").alias(t), F.col("k").alias(f"{t}k")), t, "left")
    moved = F.concat(_bare(F.col(name), end), F.lit("_"), F.col(f"{t}k").cast("string"), end)
    return out.withColumn("sample_name", F.when(F.col(f"{t}k").isNull(), F.col(name)).otherwise(moved)).drop(t, f"{t}k")


def _given(ws: Written, rows: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """t, k of the rows that get a number. rows (t, key); nodes (key, above, k, depth, first, n)."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return None
    rows, given, lost = ws.table(rows), None, None
    for depth in range(deepest + 1):
        here = nodes.where(F.col("depth") == depth).select("key", "first", "n")
        here = here.join(lost.withColumn("lost", F.lit(True)), "key", "left") if lost is not None else here.withColumn("lost", F.lit(None).cast("boolean"))
        here = here.where("n > 1 or lost")
        queue = rows.join(here, "key").where("lost or t <> first").select("key", "t", F.lit(1).cast("long").alias("one"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("k"))
        below = nodes.where(F.col("depth") == depth + 1).join(here.select(F.col("key").alias("above")), "above")
        events = queue.unionByName(below.select(F.col("above").alias("key"), F.col("first").alias("t"), F.lit(0).cast("long").alias("one"), F.col("key").alias("child"), "k"))
        ranked = ws.table(running(events, ["key"], _bin("t"), [F.col("t")], {"rank": "one"}))
        queue, children = ranked.where("one = 1").select("key", "t", "rank"), ranked.where("one = 0").select("key", "child", "k", "rank")
        blocked = _blocked(ws, children)
        size = queue.groupBy("key").agg(F.count("*").alias("size"))
        lost = ws.table(blocked.join(size, "key").where("not blocked and k - below <= size").select(F.col("child").alias("key")))
        stops = blocked.where("blocked").select("key", (F.col("k") - F.col("below")).alias("at"), "k", F.lit(None).cast("long").alias("t"), F.lit(1).cast("long").alias("stop"))
        line = queue.select("key", F.col("rank").alias("at"), F.lit(None).cast("long").alias("k"), "t", F.lit(0).cast("long").alias("stop")).unionByName(stops)
        placed = running(line, ["key"], _bin("at"), [F.col("at"), F.col("stop").desc(), F.col("k")], {"passed": "stop"})
        got = ws.table(placed.where("stop = 0").select("t", (F.col("at") + F.col("passed")).alias("k")))
        given = got if given is None else given.unionByName(got)
    return given


def _blocked(ws: Written, children: DataFrame) -> DataFrame:
    """children (key, child, k, rank) with below (blocked numbers below k) and blocked."""
    state = children.withColumns({"blocked": F.col("k") > F.col("rank"), "below": F.lit(0).cast("long")})
    while True:
        counted = running(state.drop("below").withColumn("_stop", F.col("blocked").cast("long")), ["key"], _bin("k"), [F.col("k")], {"_upto": "_stop"})
        below = F.col("_upto") - F.col("_stop")
        now = counted.select("key", "child", "k", "rank", F.col("blocked").alias("was"), below.alias("below"), (F.col("k") - below > F.col("rank")).alias("blocked"))
        now = ws.table(now)
        state = now.drop("was")
        if not now.where("blocked <> was").limit(1).count():
            return state
