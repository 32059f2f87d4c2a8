"""The class catalog and its aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class names and ids, the evaluated classes, and the aliases of class names. An alias without a
# target drops the class.
CLASSES = {0: "abnormal", 1: "empty", 2: "overripe", 3: "ripe", 4: "under_ripe", 5: "unripe"}
EVALUATED = (0, 3, 4, 5)
ALIASES = {
    "abnormal": "abnormal",
    "damaged": "abnormal",
    "damaged_bunch": "abnormal",
    "empty": "empty",
    "empty_bunch": "empty",
    "janjang_kosong": "empty",
    "overripe": "overripe",
    "over_ripe": "overripe",
    "terlalu_masak": "overripe",
    "ripe": "ripe",
    "ripe_ffb": "ripe",
    "fresh_fruit_bunch_ripe": "ripe",
    "masak": "ripe",
    "tbs_masak": "ripe",
    "under_ripe": "under_ripe",
    "underripe": "under_ripe",
    "kurang_masak": "under_ripe",
    "unripe": "unripe",
    "unripe_ffb": "unripe",
    "fresh_fruit_bunch_unripe": "unripe",
    "fresh_fruit_bunch": None,
    "ffb": None,
    "flower": None,
    "immature": "unripe",
    "partially_ripe": "under_ripe",
    "fully_ripe": "ripe",
    "decayed": "abnormal",
    "rotten": "abnormal",
    "belum_masak": "unripe",
    "tbs_mentah": "unripe",
    "tbs_abnormal": "abnormal",
}
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")

IDS = {name: number for number, name in CLASSES.items()}


def class_table(spark: SparkSession) -> DataFrame:
    """class_id, class_name, evaluated: six rows."""
    return spark.createDataFrame([(i, n, i in EVALUATED) for i, n in CLASSES.items()], "class_id int, class_name string, evaluated boolean")


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalized_name(name: Column) -> Column:
    """Trimmed, lower case, hyphens and spaces as underscores."""
    return F.translate(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), "- ", "__")


def canonical_class(name: Column) -> Column:
    """The catalog's class name of a raw name; null if there is none or its alias drops it."""
    known = _literal_map({a: c for a, c in ALIASES.items() if c is not None} | {c: c for c in IDS})
    return F.get(F.array(known[normalized_name(name)]), F.lit(0))


def class_id(name: Column, unknown: int | None = None) -> Column:
    """Id of a raw class name; ``unknown`` (null, or -1 as older data have it) where there is none."""
    found = _literal_map(IDS)[canonical_class(name)].cast("int")
    return found if unknown is None else F.coalesce(found, F.lit(unknown))


def class_name(number: Column) -> Column:
    return _literal_map(CLASSES)[number]
