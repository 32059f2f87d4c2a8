"""Label and annotation sources, all to one table: image_id, gt_idx, class_id, xc, yc, w, h."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.catalog import CLASSES, IMAGE_EXTENSIONS, class_id
from gridlark.functions.names import extension, file_name, parent, parts, stem
from gridlark.tables import fresh

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: A line of five such numbers between white space, and nothing else.
FIVE = r"^\s*{0}(?:\s+{0}){{4}}\s*\z".format(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
#: The same for an SQL text, whose strings know backslashes.
FIVE_SQL = FIVE.replace("\\", "\\\\")
_SPACE = "\t\n\x0b\f\r"


def fields(line: Column) -> Column:
    """What stands between white space."""
    return F.array_remove(F.split(F.translate(line, _SPACE, " " * len(_SPACE)), " "), "")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, name parts of the images below a folder, ordered by path components on request (``parts``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS)).select("path", stem(F.col("path")).alias("stem"), parts(F.col("path")).alias("parts"))


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """image_id (the file's stem), line_no, line of all label files below a folder."""
    # read.text() would set wholetext anew
    text = spark.read.format("text").option("recursiveFileLookup", True).option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("line_no", "line")
    return text.where(F.col("value") != "").select(stem(F.col("path")).alias("image_id"), lines)


def register_label_boxes(spark: SparkSession, name: str = "label_boxes") -> None:
    """An SQL function of a label text, for ``SELECT .. FROM (SELECT *, label_boxes(value) AS boxes FROM files), LATERAL inline_outer(boxes) WHERE line_no IS NOT NULL``:
    line_no, class_id, xc, yc, w, h of each line of five numbers of a known class, as ``lenient`` gives them. (With ``inline``, Spark adds a filter of the array's
    size, and parses each text once more for it.)

    It is an expression that the plan around it takes in: rows are made where the text is read, without a join or a shuffle.
    """
    number = lambda i: f"try_cast(get(t, {i}) AS DOUBLE)"
    values = ", ".join(f"'{c}', {number(i + 1)}" for i, c in enumerate(("xc", "yc", "w", "h")))
    spaces = r"'\t\n\u000b\u000c\r'"
    spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(label_text STRING) RETURNS ARRAY<STRUCT<line_no: INT, class_id: INT, xc: DOUBLE, yc: DOUBLE, w: DOUBLE, h: DOUBLE>>
    RETURN filter(transform(transform(split(regexp_replace(label_text, r'\n$', ''), r'\n'), l -> CASE WHEN l RLIKE '{FIVE_SQL}' THEN array_remove(split(translate(l, {spaces}, '     '), ' '), '') END),
      (t, i) -> CASE WHEN t IS NOT NULL THEN named_struct('line_no', i, 'class_id', CAST({number(0)} AS INT), {values}) END),
      b -> b.class_id IN ({", ".join(map(str, CLASSES))}))""")


def parsed(lines: DataFrame) -> DataFrame:
    """lines with class_id, xc, yc, w, h (null where a line isn't five numbers of a known class) and blank."""
    # one match of the whole line, and tokens in a column of their own that nothing is pushed through, so that both are made once a line
    numbers = F.filter(F.array(F.when(F.col("line").rlike(FIVE), fields(F.col("line")))), lambda t: t.isNotNull())
    (tokens,) = fresh(lines.columns, "_tokens")
    rows = lines.withColumn(tokens, F.explode_outer(numbers))
    number = lambda i: F.get(tokens, F.lit(i)).try_cast("double")
    raw = number(0).cast("int")  # truncates
    known = raw.isin(*CLASSES)
    cols = {"class_id": F.when(known, raw), "blank": F.trim("line") == ""}
    return rows.withColumns(cols | {c: F.when(known, number(i + 1)) for i, c in enumerate(("xc", "yc", "w", "h"))}).drop(tokens)


def valid(row: DataFrame | None = None) -> Column:
    """The strict rule: a known class, all numbers in 0 .. 1, and an extent."""
    inside = F.col("class_id").isNotNull()
    for c in ("xc", "yc", "w", "h"):
        inside &= F.col(c).between(0, 1)
    return F.coalesce(inside & (F.col("w") > 0) & (F.col("h") > 0), F.lit(False))


def lenient(lines: DataFrame, allowed: tuple[int, ...] | None = None) -> DataFrame:
    """Boxes of parsable lines of known (and allowed) classes, whatever their range."""
    rows = parsed(lines).where("class_id is not null")
    return rows.where(F.col("class_id").isin(*allowed)) if allowed else rows


def strict_counts(lines: DataFrame, skip_blank: bool = False) -> DataFrame:
    """Per image: valid and bad lines and boxes of each class."""
    rows = parsed(lines)
    rows = rows.where("not blank") if skip_blank else rows
    rows = rows.withColumn("ok", valid())
    count = lambda c: F.count_if(c)
    return rows.groupBy("image_id").agg(count(F.col("ok")).alias("valid"), count(~F.col("ok")).alias("bad"), *[count(F.col("ok") & (F.col("class_id") == i)).alias(f"boxes_{n}") for i, n in CLASSES.items()])


def remapped(lines: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Boxes whose class is mapped, with the new class; others go. No check of ranges."""
    to = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return parsed(lines).withColumn("class_id", to[F.col("class_id")]).where("class_id is not null")


def masked_lines(images_: DataFrame, lines: DataFrame, allowed: tuple[int, ...]) -> DataFrame:
    """Every image with its raw lines of allowed classes, joined by newlines; none gives an empty text."""
    kept = lenient(lines, allowed).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return images_.join(kept, "image_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of a COCO file: crowds, unknown categories and empty boxes go, pixels become centre form in shares."""
    whole = spark.read.option("multiLine", True).json(path)
    return coco_boxes(*[whole.select(F.explode(c).alias("x")).select("x.*") for c in ("images", "annotations", "categories")])


def coco_boxes(images_: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    known = categories.select(F.col("id").alias("category_id"), class_id(F.col("name")).alias("class_id")).where("class_id is not null")
    crowd = F.coalesce(F.col("iscrowd"), F.lit(0)) if "iscrowd" in annotations.columns else F.lit(0)
    boxes = annotations.where(crowd == 0).join(F.broadcast(known), "category_id").join(images_.select(F.col("id").alias("image_id"), "file_name", "width", "height"), "image_id")
    x, y, w, h = [F.col("bbox")[i].cast("double") for i in range(4)]
    boxes = boxes.where((w > 0) & (h > 0))
    return boxes.select("image_id", "file_name", "class_id", ((x + w / 2) / F.col("width")).alias("xc"), ((y + h / 2) / F.col("height")).alias("yc"), (w / F.col("width")).alias("w"), (h / F.col("height")).alias("h"))


def darknet_split(folder: Column) -> Column:
    """train, valid or test by the folder's name, the first that is in it."""
    name = F.lower(folder)
    return F.when(name.contains("train"), "train").when(name.contains("val"), "valid").when(name.contains("test"), "test")


def class_folders(paths: DataFrame) -> DataFrame:
    """A whole-image box of the class its folder names; other folders go."""
    rows = paths.withColumn("class_id", class_id(parent(F.col("path")))).where("class_id is not null")
    return rows.withColumns({"xc": F.lit(0.5), "yc": F.lit(0.5), "w": F.lit(1.0), "h": F.lit(1.0)})


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, or an empty table of its schema where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema)


def without_rejected(paths: DataFrame, rejects: DataFrame) -> DataFrame:
    """paths (path) without those whose name or stem is in the reject list (value; ``#`` begins a comment)."""
    listed = rejects.select(F.lower(F.trim(F.split("value", "#")[0])).alias("_listed")).where("_listed <> ''").distinct()
    named = paths.withColumns({"_name": F.lower(F.element_at(F.split("path", "/"), -1)), "_stem": F.lower(stem(F.col("path")))})
    for key in ("_name", "_stem"):
        named = named.join(listed, F.col(key) == F.col("_listed"), "left_anti")
    return named.drop("_name", "_stem")


def official_list(paths: DataFrame, listed: DataFrame) -> DataFrame:
    """paths whose name is listed, letter case aside; an error if a listed name has no file."""
    names = listed.select(F.lower(F.trim("value")).alias("_listed")).where("_listed <> ''").distinct()
    rows = paths.withColumn("_name", F.lower(F.element_at(F.split("path", "/"), -1)))
    lost = names.join(rows, F.col("_listed") == F.col("_name"), "left_anti")
    if lost.limit(1).count():
        raise FileNotFoundError(f"listed without a file: {[r[0] for r in lost.limit(5).collect()]}")
    return rows.join(names, F.col("_name") == F.col("_listed"), "left_semi").drop("_name")


def label_candidates(path: Column, root: str) -> Column:
    """Where an image's label file may lie, first choice first: beside it, with a folder ``images`` (each in turn) as
    ``labels``, in the root's labels, in the labels of the root's first folder."""
    to_text = lambda p: F.concat(F.regexp_replace(p, r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))
    pieces = F.split(path, "/")
    at = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.lower(F.get(pieces, i)) == "images")
    swapped = F.transform(at, lambda i: to_text(F.array_join(F.transform(pieces, lambda p, j: F.when(j == i, "labels").otherwise(p)), "/")))
    base = root.rstrip("/")
    below = F.split(F.substring(path, len(base) + 2, 1 << 20), "/")
    name = to_text(file_name(path))
    inside = F.startswith(path, F.lit(base + "/"))
    own = F.array_compact(F.array(
        F.when(inside, F.concat(F.lit(f"{base}/labels/"), name)),
        F.when(inside & (F.size(below) > 1), F.concat(F.lit(f"{base}/"), F.get(below, F.lit(0)), F.lit("/labels/"), name)),
    ))
    return F.concat(F.array(to_text(path)), swapped, own)


def with_label_file(images_: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """images (path) with label_path: the first candidate among the files (path), null if there is none."""
    tried = images_.select("path", F.posexplode(label_candidates(F.col("path"), root)).alias("_rank", "_candidate"))
    there = tried.join(files.select(F.col("path").alias("_candidate")).distinct(), "_candidate", "left_semi")
    first = there.groupBy("path").agg(F.min_by("_candidate", "_rank").alias("label_path"))
    return images_.join(first, "path", "left")


def source_masks_of(images_: DataFrame, masks: DataFrame, classes: int = 6) -> DataFrame:
    """images (name) with mask: that of the source numbered in a name ``src<k>_..``, all ones without one.

    masks (source, observed, declared as arrays of numbers): the observed mask counts, else the declared one, else ones.
    """
    ones = F.array(*[F.lit(1.0)] * classes)
    number = F.nullif(F.regexp_extract("name", r"(?i)^src(\d+)_", 1), F.lit("")).cast("int")
    known = masks.select(F.col("source").alias("_source"), F.coalesce("observed", "declared").cast("array<double>").alias("_mask"))
    return images_.withColumn("_number", number).join(known, F.col("_number") == F.col("_source"), "left").withColumn("mask", F.coalesce("_mask", ones)).drop("_number", "_source", "_mask")
