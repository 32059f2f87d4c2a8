"""File names, paths, and what they say about scene, split and class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.catalog import normalized_name

# Words in paths of an image-level dataset that name a class, tried in this order.
PATH_CLASSES = {"damaged": 0, "empty": 1, "overripe": 2, "unripe": 5, "ripe": 3}
# Words of a title that name a class.
TITLE_WORDS = (("abnormal", 0), ("kurang masak", 4), ("mentah", 5), ("terlalu masak", 2), ("overripe", 2))
# What is taken off a stem, in this order, to get its scene; and what is replaced in a lower-case stem
# to get its base name.
SCENE_PATTERNS = (r"(?i)(?:frame|img|image|copy)[_-]?\d+$", r"(?i)[_-]?(?:jpg|jpeg|png|bmp)$", r"--\d+.*$", r"\d+$")
BASE_PATTERNS = ((r"^(?:src\d+_|pseudo\d+_)", ""), (r"[_-](?:jpg|jpeg|png|bmp)$", ""), (r"[^a-z0-9]+", "_"))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.get(parts(path), F.size(parts(path)) - 2)


def _before_export_mark(name: Column) -> Column:
    return F.element_at(F.split(name, r"\.rf\."), 1)


def scene_group(path: Column) -> Column:
    """The source a frame was taken from: its stem without frame counters, suffix remnants and digits."""
    s = _before_export_mark(stem(path))
    for pattern in SCENE_PATTERNS:
        s = F.regexp_replace(s, pattern, "")
    s = F.btrim(s, F.lit("_- "))
    return F.when(s != "", s).otherwise(stem(path))


def base_name(path: Column) -> Column:
    """A key that is equal for exports of one image: lower case, no split prefix, no suffix remnant, one separator."""
    s = _before_export_mark(F.lower(stem(path)))
    for pattern, by in BASE_PATTERNS:
        s = F.regexp_replace(s, pattern, by)
    return F.btrim(s, F.lit("_"))


def _tail(path: Column) -> Column:
    p = parts(path)
    return F.lower(F.array_join(F.slice(p, F.greatest(F.size(p) - 3, F.lit(1)), F.lit(4)), "_"))


def path_class(path: Column) -> Column:
    """Class id named in the last four parts of a path, first word that fits; null if none does."""
    found, text = F.lit(None).cast("int"), _tail(path)
    for word, number in reversed(PATH_CLASSES.items()):
        found = F.when(F.contains(text, F.lit(word)), F.lit(number)).otherwise(found)
    return found


def path_split(path: Column) -> Column:
    """test, train or unknown, from the last four parts of a path."""
    text = _tail(path)
    found = F.lit("unknown")
    for name in ("train", "test"):
        found = F.when(F.contains(text, F.lit(f"ffb{name}")) | F.rlike(text, F.lit(f"(?<![a-z]){name}")), F.lit(name)).otherwise(found)
    return found


def weak_classes(name: Column) -> Column:
    """Class ids named anywhere in a title; several may be. The word for ripe inside that for under-ripe names none."""
    text = F.btrim(F.regexp_replace(F.translate(F.lower(name), "_", " "), r"\s+", " "))
    ids = [F.when(F.contains(text, F.lit(w)), F.lit(i)) for w, i in TITLE_WORDS]
    ripe = F.when(F.rlike(F.regexp_replace(text, "kurang masak", ""), F.lit(r"\bmasak\b")), F.lit(3))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*ids, ripe))))


def scene_folder(path: Column, root: str, normalized: bool = True) -> Column:
    """The first folder below the root; ``root_scene`` for files in the root itself or outside of it."""
    base = root.rstrip("/") + "/"
    below = F.filter(F.split(F.substring(path, len(base) + 1, 1 << 20), "/"), lambda p: p != "")
    first = F.get(below, F.lit(0))
    return F.when(F.startswith(path, F.lit(base)) & (F.size(below) > 1), normalized_name(first) if normalized else first).otherwise("root_scene")


def slug(text: Column, most: int = 90) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), F.lit("_")), 1, most)


def parsed_map(text: Column) -> Column:
    """``a=0.5, b=0.6`` as a map from trimmed lower-case names to numbers; empty text is an empty map."""
    entries = F.filter(F.transform(F.split(text, ","), lambda e: F.trim(e)), lambda e: e != "")
    pairs = F.transform(entries, lambda e: F.struct(F.lower(F.trim(F.substring_index(e, "=", 1))).alias("k"), F.trim(F.substring_index(e, "=", -1)).try_cast("double").alias("v")))
    return F.map_from_entries(pairs)


def parsed_numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda v: F.trim(v) != ""), lambda v: F.trim(v).try_cast("double"))
