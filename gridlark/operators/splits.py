"""Splits, samples and caps. Every random choice is an order by md5(seed:key), so reruns agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.catalog import CLASSES
from gridlark.operators.naming import unique_names
from gridlark.operators.ranking import lot, running
from gridlark.tables import Written


def random_order(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def sample_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int | str) -> DataFrame:
    """n rows of each group in the random order."""
    w = Window.partitionBy(group).orderBy(random_order(seed, F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def ratio_split(rows: DataFrame, key: str, seed: int | str, train: float = 0.8, valid: float = 0.1, within: str | None = None, cuts: tuple[float, float] | None = None) -> DataFrame:
    """rows with split, cut at whole numbers of rows in the random order, per ``within`` if given.

    The parts are floor(n * train) and floor(n * valid) rows and the rest; or, with ``cuts``, the rows up to each cut. Keys
    tell rows apart. Places in the order come from running counts over its bins, so no group is ordered in one task.
    """
    order = random_order(seed, F.col(key))
    group = [within] if within else []
    counted = rows.withColumns({"_one": F.lit(1).cast("long")})
    ranked = running(counted, group, lot(order, 4), [order, F.col(key)], {"_at": "_one"}).drop("_one")
    total = rows.groupBy(*[F.col(g).alias("_g") for g in group]).agg(F.count("*").alias("_n"))
    ranked = ranked.join(total, F.col(within).eqNullSafe(F.col("_g"))).drop("_g") if within else ranked.crossJoin(F.broadcast(total))  # one row
    n, at = F.col("_n"), F.col("_at")
    low, high = (F.floor(n * train), F.floor(n * train) + F.floor(n * valid)) if cuts is None else [F.floor(n * c) for c in cuts]
    return ranked.withColumn("split", F.when(at <= low, "train").when(at <= high, "valid").otherwise("test")).drop("_n", "_at")


def with_pseudo(original: DataFrame, pseudo: DataFrame, seed: int = 42) -> DataFrame:
    """original (split, name) and pseudo-labelled images (source_idx from 1, name, valid lines): one table of both.

    Each pseudo source is cut at 80 and 90 % of its images in random order, whatever their labels; then those without a
    valid line go. Names get the source's prefix, and a number where the split has the name already: originals come first,
    then the pseudo sources in turn, by name.
    """
    lots = F.concat_ws(":", "source_idx", "name")
    keyed = pseudo.withColumns({"_source": F.col("source_idx"), "_lots": lots})
    cut = ratio_split(keyed, "_lots", seed, within="_source", cuts=(0.8, 0.9)).where("valid > 0")
    named = cut.select("split", F.concat(F.lit("pseudo"), F.col("source_idx").cast("string"), F.lit("_"), F.col("name")).alias("name"), F.col("source_idx").cast("long").alias("_pseudo"))
    both = original.select("split", "name", F.lit(0).cast("long").alias("_pseudo")).unionByName(named)
    return unique_names(both, "split", "name", ["_pseudo", "name"]).select("split", "sample_name", (F.col("_pseudo") > 0).alias("pseudo"))


def group_split(rows: DataFrame, group: str, test_share: float = 0.25, valid_share: float = 0.15) -> DataFrame:
    """group, n, split: whole groups; the smallest ones test, the next valid, the rest train. Three groups at least."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    ws = Written(rows.sparkSession, "groups")
    # the order as one of numbers, so that groups, which may be many, are ranked over bins and not in one task
    placed = ws.table(counts.orderBy(F.col("n").desc(), F.col(group)).withColumn("_t", F.monotonically_increasing_id()))
    ranked = running(placed.withColumn("_one", F.lit(1).cast("long")), [], F.shiftright("_t", 13), [F.col("_t")], {"_rank": "_one"})
    total = placed.agg(F.count("*").alias("_total"))
    share = lambda s: F.greatest(F.lit(1), F.bround(F.col("_total") * s).cast("int"))
    ranked = ranked.crossJoin(F.broadcast(total)).withColumns({"_test": share(test_share), "_valid": share(valid_share)})  # one row
    kind = F.when(F.col("_rank") > F.col("_total") - F.col("_test"), "test").when(F.col("_rank") > F.col("_total") - F.col("_test") - F.col("_valid"), "valid").otherwise("train")
    few = F.when(F.col("_total") < 3, F.raise_error(F.lit("a disjoint split needs three groups"))).otherwise(kind)
    return ranked.select(group, "n", few.alias("split"))


def group_counts(images: DataFrame, boxes: DataFrame, group: str) -> tuple[list[tuple[str, dict[int, int]]], dict[str, int]]:
    """Boxes by class, and images, of each group, for choose_groups. images (image_id, group), a row per image; boxes (image_id, class_id)."""
    own = images.select("image_id", F.col(group).cast("string").alias("_g"))
    sizes = {r[0]: r[1] for r in own.groupBy("_g").agg(F.count("*")).collect()}
    found: dict[str, dict[int, int]] = {g: {} for g in sizes}
    for g, c, n in own.join(boxes.select("image_id", "class_id"), "image_id").groupBy("_g", "class_id").agg(F.count("*")).collect():
        found[g][c] = n
    return list(found.items()), sizes


def choose_groups(counts: list[tuple[str, dict[int, int]]], images: Mapping[str, int] | None = None, tests: Sequence[int] = (1, 2, 3, 4), valids: Sequence[int] = (1, 2, 3)) -> tuple[list[str], list[str]]:
    """Test and valid groups of a small table (group, boxes by class; images by group) by search.

    The best has most classes in test, then in valid, most test images up to 1200, most valid images up to 800, and a
    count of test images next to a fifth of all; the first names of equals. Without images every box counts as one.
    """
    names, held = sorted(g for g, _ in counts), {g: {c for c, k in boxes.items() if k and c in CLASSES} for g, boxes in counts}
    size = dict(images) if images is not None else {g: sum(boxes.values()) for g, boxes in counts}
    whole, best, choice = sum(size[g] for g in names), None, None
    sums = lambda gs: (len(set().union(*[held[g] for g in gs])), sum(size[g] for g in gs))
    for t in tests:
        if t > len(names) - 1:
            continue
        for test in combinations(names, t):
            rest = [n for n in names if n not in test]
            in_test, test_images = sums(test)
            for v in valids:
                for valid in combinations(rest, v):
                    in_valid, valid_images = sums(valid)
                    score = (in_test, in_valid, min(test_images, 1200), min(valid_images, 800), -abs(test_images - 0.2 * whole))
                    if best is None or score > best:
                        best, choice = score, (list(test), list(valid))
    if choice is None:
        raise ValueError("a choice of test and valid groups needs two groups")
    return choice


def pooled(tables: Mapping[str, DataFrame], leave_out: Sequence[str] = ()) -> DataFrame:
    """The rows of splits in one table, with the split that each is from; splits in ``leave_out`` give none."""
    kept = [t.withColumn("split", F.lit(name)) for name, t in tables.items() if name not in leave_out]
    return reduce(lambda a, b: a.unionByName(b), kept)


def held_out(rows: DataFrame, group: str, names: Sequence) -> DataFrame:
    """rows with held_out: whether the group is one of the names. If that would hold out every row, none is."""
    hit = F.coalesce(F.col(group).isin(*names), F.lit(False)) if names else F.lit(False)
    others = rows.where(~hit).limit(1).select(F.lit(True).alias("_others"))
    some = rows.select(F.lit(1).alias("_one")).limit(1).join(F.broadcast(others), F.lit(True), "left").select(F.col("_others").isNotNull().alias("_some"))
    # one row
    return rows.crossJoin(F.broadcast(some)).withColumn("held_out", hit & F.col("_some")).drop("_some")


def with_split(rows: DataFrame, splits: DataFrame, group: str) -> DataFrame:
    """rows with the split of their group; the split table has a row per group."""
    return rows.join(splits.select(group, "split"), group)


def calibration_split(groups: DataFrame, quota: int, seed: int | str) -> DataFrame:
    """group, split: calibration until each class has ``quota`` images, the rest locked.

    groups (group, classes array, size), where every image of a group counts for each of its classes. Groups of more
    classes and more images come first, ties in random order. A group is taken if it holds a class below its quota.
    """
    counts = F.map_from_entries(F.transform(F.array_distinct("classes"), lambda c: F.struct(c, F.col("size").cast("bigint"))))
    ranked = Written(groups.sparkSession, "groups").table(_ranked(groups.select("group", "size", counts.alias("counts")), seed))
    classes = [r[0] for r in ranked.select(F.explode(F.map_keys("counts"))).distinct().collect()]
    return _labelled(ranked, _taken(ranked, dict.fromkeys(classes, quota), None))


def calibration_fraction_split(images: DataFrame, fraction: float, seed: int | str) -> DataFrame:
    """group, split: whole groups until each class has its share of images, topped up to the share of groups.

    images (group, classes array of the image, which may be empty), a row per image. A class's target is
    max(1, round(images that hold it * fraction)), the limit max(1, round(groups * fraction)) groups. Groups of more classes,
    then of more images come first, ties in random order; one is taken if it holds a class below its target and
    the limit isn't reached. Groups in random order then fill up to the limit.
    """
    kind = dict(images.dtypes)["classes"].removeprefix("array<").removesuffix(">")
    # the null stands for the image itself
    held = images.select("group", F.explode(F.concat(F.array(F.lit(None).cast(kind)), F.array_distinct("classes"))).alias("c"))
    held = held.groupBy("group", "c").agg(F.count("*").alias("n"))
    counts = F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "n"))))
    groups = held.groupBy("group").agg(F.max(F.when(F.col("c").isNull(), F.col("n"))).alias("size"), counts.alias("counts"))
    ranked = Written(images.sparkSession, "groups").table(_ranked(groups, seed))
    totals = {r[0]: r[1] for r in ranked.select(F.explode("counts")).groupBy("key").agg(F.sum("value")).collect()}
    limit = max(1, round(ranked.count() * fraction))
    return _labelled(ranked, _taken(ranked, {c: max(1, round(n * fraction)) for c, n in totals.items()}, limit))


# Rows of the last step of a search, and hexadecimal digits of the random order that a step more looks at.
_FEW, _DIGITS = 4096, 3


def _ranked(groups: DataFrame, seed: int | str) -> DataFrame:
    """group, counts and the order: _a, _b by classes and size, _c at random, _d the group's name."""
    name = F.coalesce(F.col("group").cast("string"), F.lit(""))
    return groups.select("group", "counts", (-F.size("counts")).alias("_a"), (-F.col("size")).cast("bigint").alias("_b"), random_order(seed, name).alias("_c"), name.alias("_d"))


def _labelled(ranked: DataFrame, taken: Column) -> DataFrame:
    return ranked.select("group", F.when(taken, "calibration").otherwise("locked_final_test").alias("split"))


def _taken(ranked: DataFrame, targets: dict, limit: int | None) -> Column:
    """Condition on the groups that a fold in their order takes.

    While no class fills up, every group that holds an open class is taken; so the fold is a run per class, and a
    run ends at the first group whose running count reaches a target or the limit. That group is found by sums over
    ever finer ranges of the order, and no group's row but a few of the last range leaves Spark.
    """
    order = ["_a", "_b", "_c", "_d"]
    levels = [F.struct("_a", "_b"), *[F.struct("_a", "_b", F.substring("_c", 1, _DIGITS * k).alias("_p")) for k in range(1, 10)], F.struct(*order)]
    seen, n, after, runs = dict.fromkeys(targets, 0), 0, None, F.lit(False)
    open_ = {c for c, t in targets.items() if t > 0}
    while open_ and (limit is None or n < limit):
        here = F.arrays_overlap(F.map_keys("counts"), F.array(*[F.lit(c) for c in sorted(open_)]))
        if after is not None:
            here &= F.struct(*order) > after
        full = {c: targets[c] for c in open_}
        end, n, seen = _crossing(ranked.where(here), levels, order, seen, full, n, limit)
        if end is not None:
            after = _point(end, order)
            here &= F.struct(*order) <= after
        runs |= here
        if end is None:
            break
        open_ = {c for c in open_ if seen[c] < targets[c]}
    if limit is None or n >= limit:
        return runs
    rest, order = ranked.where(~runs), ["_c", "_d"]
    levels = [*[F.struct(F.substring("_c", 1, _DIGITS * k).alias("_p")) for k in range(1, 10)], F.struct(*order)]
    end, _, _ = _crossing(rest, levels, order, {}, {}, n, limit)
    return F.lit(True) if end is None else runs | (F.struct(*order) <= _point(end, order))


def _point(values: Sequence, names: Sequence[str]) -> Column:
    kinds = {"_a": "int", "_b": "bigint"}
    return F.struct(*[F.lit(v).cast(kinds.get(c, "string")).alias(c) for v, c in zip(values, names, strict=True)])


def _crossing(rows: DataFrame, levels: list[Column], order: list[str], seen: dict, full: dict, n: int, limit: int | None) -> tuple:
    """(order of the first row at which a count reaches its number in ``full`` or the rows reach the limit, or None; rows and
    counts up to it)."""
    classes = list(seen)
    sums = [F.count("*"), *[F.coalesce(F.sum(F.coalesce(F.element_at("counts", F.lit(c)), F.lit(0))), F.lit(0)) for c in classes]]
    last = len(levels) - 1
    level = 0
    while True:
        parts = rows.groupBy(levels[level].alias("at")).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])
        for r in sorted(parts.collect(), key=lambda r: tuple(r[0])):
            more = {c: seen[c] + r[2 + i] for i, c in enumerate(classes)}
            if any(more[c] >= t for c, t in full.items()) or (limit is not None and n + r[1] >= limit):
                break
            n, seen = n + r[1], more
        else:
            return None, n, seen
        if level == last:
            return tuple(r[0]), n + r[1], more
        rows = rows.where(levels[level] == _point(r[0], r[0].__fields__))
        level = last if r[1] <= _FEW else level + 1


def oversample(images: DataFrame, key: str, target: int, seed: int | str) -> DataFrame:
    """class_id, key, copy: ``target`` rows of each class, in key order if there are more images, else all of them and
    random further picks. Only classes of fewer images than the target, which are small, are numbered as a whole."""
    counts = images.groupBy(F.col("class_id").alias("_c")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("class_id").orderBy(key)
    first = images.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= target)
    short = counts.where(F.col("_n") < target)
    picks = short.select("_c", "_n", F.explode(F.sequence(F.col("_n") + 1, F.lit(target).cast("long"))).alias("_i"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_c", "_i")), 1, 8), 16, 10).cast("long") % F.col("_n") + 1
    picks = picks.select("_c", place.alias("_lot"), (F.col("_i") - F.col("_n")).cast("int").alias("copy"))
    more = first.join(picks, (F.col("class_id") == F.col("_c")) & (F.col("_r") == F.col("_lot"))).select("class_id", key, "copy")
    return first.select("class_id", key, F.lit(0).alias("copy")).unionByName(more)


def replicate(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def top_and_random(rows: DataFrame, group: str, key: str, order: Sequence[Column], cap: int, seed: int | str, top: float = 0.5) -> DataFrame:
    """``cap`` rows of each group: the first part by the order, the rest in random order; with the way of choice.

    Both parts are firsts of a group, which Spark cuts before the shuffle. Keys tell a group's rows apart.
    """
    part, lead = Window.partitionBy(group), int(cap * top)
    first = rows.withColumn("_r", F.row_number().over(part.orderBy(*order, key))).where(F.col("_r") <= lead).drop("_r")
    taken = first.select(F.col(group).alias("_g"), F.col(key).alias("_k"))  # ``lead`` rows of each group
    rest = rows.join(taken, F.col(group).eqNullSafe(F.col("_g")) & (F.col(key) == F.col("_k")), "left_anti")
    rest = rest.withColumn("_r", F.row_number().over(part.orderBy(random_order(seed, F.col(key)), key))).where(F.col("_r") <= cap - lead).drop("_r")
    return first.withColumn("chosen_by", F.lit("rank")).unionByName(rest.withColumn("chosen_by", F.lit("random")))


def capped_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def even_indices(count: Column, n: int, central: float = 0.8) -> Column:
    """n evenly spaced indices over the central share of 0 .. count - 1; the middle one for n = 1."""
    if n == 1:
        return F.array((count / 2).cast("int"))
    low, high = count * (1 - central) / 2, (count - 1) - count * (1 - central) / 2
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(low + (high - low) * i / (n - 1)).cast("int")))
