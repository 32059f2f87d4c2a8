"""Whole datasets as found in folders: catalogs, formats told by what is there, and one table of boxes out of all formats.

The functions work on a listing (path) and on the small texts among the files (path, value); ``listing`` and ``texts`` read
both from any store that Spark reads. A dataset is a folder directly below the given one.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.catalog import CLASSES, IMAGE_EXTENSIONS, class_id
from gridlark.functions.names import extension, file_name, parent, stem
from gridlark.operators.splits import ratio_split
from gridlark.sources.labels import coco_boxes, darknet_split, valid

# ---------------------------------------------------------------- files


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of the files below a folder that have bytes; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def texts(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """path, value of the whole text files below a folder whose names match one of the patterns. Files without bytes have no row."""
    found = None
    for pattern in names:
        # read.text() would set wholetext anew
        read = spark.read.format("text").option("recursiveFileLookup", True).option("wholetext", True).option("pathGlobFilter", pattern)
        one = read.load(folder).select(F.col("_metadata.file_path").alias("path"), "value")
        found = one if found is None else found.unionByName(one)
    return found


def class_lists(spark: SparkSession, folder: str, depth: int = 4) -> DataFrame:
    """path, value of the ``_darknet.labels`` files up to ``depth`` folders below a folder.

    Spark's readers skip names that begin with an underscore, so the store is asked for these: a few names for each split folder.
    """
    hadoop, found = spark._jvm.org.apache.hadoop, []
    io = spark._jvm.org.apache.commons.io.IOUtils
    root = hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for level in range(depth + 1):
        for status in fs.globStatus(hadoop.fs.Path(root, "*/" * level + "_darknet.labels")) or []:
            stream = fs.open(status.getPath())
            found.append((status.getPath().toString(), io.toString(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(found, "path string, value string")


def below(path: Column, folder: str) -> Column:
    """The path below a folder, null elsewhere."""
    at = folder.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(at)), F.substring(path, len(at) + 1, 1 << 20))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def resolved(base: Column, path: Column) -> Column:
    """A path as seen from a folder, without ``.`` and ``..``; absolute ones (and those with a scheme) stay where they are."""
    whole = F.when(path.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?/"), path).otherwise(F.concat(base, F.lit("/"), path))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(p.isin(".", ""), acc).otherwise(F.concat(acc, F.array(p)))
    # what stands before the first name (nothing, or a scheme) is kept as it is
    head = F.regexp_extract(whole, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?/*)", 1)
    kept = F.aggregate(F.split(F.substring(whole, F.length(head) + 1, F.lit(1 << 20)), "/"), F.array(F.lit("")), step)
    return F.concat(head, F.array_join(F.slice(kept, 2, 1 << 20), "/"))


# ---------------------------------------------------------------- catalogs


def _plain(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def _pieces(text: str, mark: str) -> list[str]:
    """text cut at a mark outside quotes."""
    out, quote = [""], ""
    for c in text:
        if c == mark and not quote:
            out.append("")
            continue
        out[-1] += c
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
    return out


def catalog_fields(text: str) -> dict:
    """Top-level values of a catalog file, and its names as {id: name}: the subset of YAML that such files are written in.

    Names are a list or a map, in the line of the key (also over several lines) or in lines below it. An id that is no whole
    number is an error.
    """
    values: dict[str, str] = {}
    names: dict[int, str] = {}
    key, open_ = "", ""
    for line in map(_uncommented, text.lstrip("﻿").splitlines()):
        if open_:
            values[key] += " " + line.strip()
            open_ = "" if line.endswith(open_) else open_
        elif line.strip() in ("", "---", "...", "{}"):
            continue
        elif line[0].isspace() or line.startswith("- "):
            if key == "names":
                item = line.strip()
                if item.startswith("-"):
                    names[len(names)] = _plain(item[1:])
                else:
                    number, _, name = item.partition(":")
                    names[int(_plain(number))] = _plain(name)
        else:
            key, _, value = line.partition(":")
            key, value = _plain(key), value.strip()
            values[key] = value
            if value[:1] in ("[", "{") and value:
                end = {"[": "]", "{": "}"}[value[0]]
                open_ = "" if value.endswith(end) else end
    inline = values.get("names", "")
    if inline.startswith("["):
        names = dict(enumerate(_plain(p) for p in _pieces(inline[1:-1], ",") if p.strip()))
    elif inline.startswith("{"):
        for p in _pieces(inline[1:-1], ","):
            if p.strip():
                number, _, name = p.partition(":")
                names[int(_plain(number))] = _plain(name)
    single = {k: _plain(v) for k, v in values.items() if k in ("path", "train", "val", "test") and v not in ("", "~", "null")}
    return single | {"nc": int(values["nc"]) if values.get("nc") else None, "names": names}


_CATALOG = "catalog string, path string, train string, val string, test string, nc int, names map<int,string>, error string"


def catalogs(files: DataFrame) -> DataFrame:
    """Catalog texts (path, value) -> catalog, root, train, valid, test (folders of images, null if not given), nc, names, error.

    A relative root is seen from the catalog's folder, which is the root of a catalog without one. A text that can't be read
    has its error and nulls.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    got = catalog_fields(text or "")
                    rows.append((path, *[got.get(k) for k in ("path", "train", "val", "test", "nc")], list(got["names"].items()), None))
                except ValueError as wrong:
                    rows.append((path, None, None, None, None, None, None, str(wrong)))
            kinds = [*[pa.string()] * 5, pa.int32(), pa.map_(pa.int32(), pa.string()), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["catalog", "path", "train", "val", "test", "nc", "names", "error"])

    read = files.select("path", "value").mapInArrow(run, _CATALOG)
    home = folder_of(F.col("catalog"))
    root = resolved(home, F.coalesce("path", F.lit(".")))
    place = lambda c: resolved(root, F.col(c))
    return read.select("catalog", F.when(F.col("error").isNull(), root).alias("root"), place("train").alias("train"), place("val").alias("valid"), place("test").alias("test"), "nc", "names", "error")


def catalog_text(root: Column, classes: dict[int, str] | None = None) -> Column:
    """The text of a catalog of a root whose splits lie in train, valid and test."""
    names = classes or CLASSES
    # fixed values: keys and folders of such a catalog
    tail = "\n".join(["train: train/images", "val: valid/images", "test: test/images", "", f"nc: {len(names)}", "names:", *[f"  {i}: {names[i]}" for i in sorted(names)]])
    return F.concat(F.lit("path: "), root, F.lit(f"\n{tail}\n"))


def class_mapping(names: Column) -> Column:
    """Old class ids to those of the library, from a catalog's names; unknown names have none."""
    to = F.transform_values(names, lambda _, name: class_id(name))
    return F.map_filter(to, lambda _, new: new.isNotNull())


def chosen_catalog(found: DataFrame, folder: str) -> DataFrame:
    """dataset, catalog: of each dataset data.yaml in its folder, else data.yml there, else the first data.yaml further down."""
    rest = below(F.col("path"), folder)
    dataset, inner = F.split_part(rest, F.lit("/"), F.lit(1)), F.regexp_replace(rest, r"^[^/]*/", "")
    rank = F.when(inner == "data.yaml", 0).when(inner == "data.yml", 1).when(file_name(inner) == "data.yaml", 2)
    ranked = found.select(dataset.alias("dataset"), "path", rank.alias("_rank"), inner.alias("_inner")).where("_rank is not null")
    return ranked.groupBy("dataset").agg(F.min_by("path", F.struct("_rank", "_inner")).alias("catalog"))


# ---------------------------------------------------------------- formats

#: Formats in the order in which they are tried.
FORMATS = ("catalog", "coco", "darknet", "folders")
_KEYS = ("images", "annotations", "categories")


def formats(files: DataFrame, small: DataFrame, folder: str) -> DataFrame:
    """dataset, format, source: the first of FORMATS that a dataset shows, and the file that shows it (null for folders).

    files: the listing (path), with the class lists; small: the texts (path, value) of YAML and JSON files. A JSON file is of the coco format if
    its top level is an object that holds all three lists; other files that aren't JSON are passed over. A dataset without any sign is of
    no format and has no row.
    """
    rest = below(F.col("path"), folder)
    inside = lambda df: df.withColumn("dataset", F.split_part(rest, F.lit("/"), F.lit(1))).where(F.contains(rest, F.lit("/")))
    first = lambda df, kind: df.groupBy("dataset").agg(F.min("path").alias("source")).withColumn("format", F.lit(kind))
    whole = F.try_parse_json("value")
    has = [F.try_variant_get(whole, f"$.{k}", "variant").isNotNull() for k in _KEYS]
    coco = inside(small).where(F.lower(file_name(F.col("path"))).endswith(".json")).where(has[0] & has[1] & has[2])
    images = inside(files).where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS)).where(class_id(parent(F.col("path"))).isNotNull())
    signs = [
        chosen_catalog(files, folder).select("dataset", F.col("catalog").alias("source"), F.lit("catalog").alias("format")),
        first(coco, "coco"), first(inside(files).where(file_name(F.col("path")) == "_darknet.labels"), "darknet"),
        first(images, "folders").withColumn("source", F.lit(None).cast("string")),
    ]
    every = signs[0]
    for s in signs[1:]:
        every = every.unionByName(s)
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))
    return every.groupBy("dataset").agg(F.min_by(F.struct("format", "source"), rank).alias("x")).select("dataset", "x.*")


def _lines(small: DataFrame) -> DataFrame:
    return small.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))


def _mapped(boxes: DataFrame, mapping: str) -> DataFrame:
    """Boxes under the class that the mapping gives their raw one; others go."""
    return boxes.withColumn("class_id", F.try_element_at(F.col(mapping), F.col("raw"))).where("class_id is not null")


def _numbers(lines: DataFrame) -> DataFrame:
    """Lines of five fields whose first is a number, with that as a whole one (raw) and the others as text."""
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.withColumn("_f", fields).where(F.size("_f") == 5).withColumn("raw", F.get("_f", F.lit(0)).try_cast("double").cast("int")).where("raw is not null")
    return rows.withColumns({c: F.get("_f", F.lit(i + 1)).try_cast("double") for i, c in enumerate(("xc", "yc", "w", "h"))}).drop("_f")


_COLUMNS = ("dataset", "format", "split", "image", "class_id", "xc", "yc", "w", "h")


def harmonized(files: DataFrame, small: DataFrame, folder: str, seed: int = 42) -> DataFrame:
    """dataset, format, split, image, class_id, xc, yc, w, h: the boxes of all datasets below a folder under the library's classes.

    files: the listing (path), with the class lists; small: the texts (path, value) of YAML, JSON and label files and class lists.

    * catalog: images in a split's folder (in <split>/images beside the catalog if that folder holds nothing), labels in the
      folder with ``labels`` for ``images``; lines of five fields under the mapped class, whatever their range.
    * coco: as ``coco_boxes``; images found by name; split 80/10/10 of all images in random order.
    * darknet: labels beside the images in folders with a class list, split by the folder's name or its parent's; the strict rule.
    * folders: a whole-image box of the class that the folder names; split 80/10/10 in random order.
    """
    found = formats(files, small, folder)
    rest = below(F.col("path"), folder)
    pictures = files.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS)).select("path", F.split_part(rest, F.lit("/"), F.lit(1)).alias("dataset"))
    pictures = pictures.withColumns({"home": folder_of(F.col("path")), "stem": stem(F.col("path"))})
    labels = small.where(extension(F.col("path")) == "txt").select("path", "value")
    parts = [_of_catalogs(found, pictures, labels, small), _of_coco(found, pictures, small, seed), _of_darknet(found, pictures, labels, small), _of_folders(found, pictures, seed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _joined_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Lines of the label file (label) of each image."""
    own = _lines(labels).withColumnRenamed("path", "label")
    return images.join(own, "label")


def _of_catalogs(found: DataFrame, pictures: DataFrame, labels: DataFrame, small: DataFrame) -> DataFrame:
    here = found.where("format = 'catalog'")
    read = catalogs(small.join(here.select(F.col("source").alias("path")), "path", "left_semi"))
    read = here.join(read, F.col("source") == F.col("catalog")).select("dataset", "catalog", class_mapping(F.col("names")).alias("mapping"), F.explode(F.create_map(*[x for s in ("train", "valid", "test") for x in (F.lit(s), F.col(s))])).alias("split", "home"))
    read = read.where("home is not null")
    there = pictures.select("home").distinct().withColumn("there", F.lit(True))
    beside = F.concat(folder_of(F.col("catalog")), F.lit("/"), F.col("split"), F.lit("/images"))
    placed = read.join(there, "home", "left").withColumn("home", F.when(F.col("there"), F.col("home")).otherwise(beside)).drop("there")
    images = placed.join(pictures.drop("dataset"), "home")
    label = F.concat(F.replace("home", F.lit("/images"), F.lit("/labels")), F.lit("/"), F.col("stem"), F.lit(".txt"))
    rows = _mapped(_numbers(_joined_labels(images.withColumn("label", label), labels)), "mapping")
    return rows.select("dataset", F.lit("catalog").alias("format"), "split", F.col("path").alias("image"), *_COLUMNS[4:])


def _of_coco(found: DataFrame, pictures: DataFrame, small: DataFrame, seed: int) -> DataFrame:
    here = found.where("format = 'coco'").select("dataset", F.col("source").alias("path"))
    whole = small.join(here, "path").select("dataset", F.from_json("value", _COCO).alias("x"))
    # ids are told apart by their dataset
    own = lambda c, key: whole.select("dataset", F.explode(f"x.{c}").alias("r")).select("dataset", "r.*").withColumn(key, F.struct("dataset", key))
    images, marks, kinds = own("images", "id"), own("annotations", "image_id"), own("categories", "id").drop("dataset")
    marks = marks.withColumn("category_id", F.struct("dataset", "category_id"))
    boxes = coco_boxes(images.drop("dataset"), marks.drop("dataset"), kinds)
    key = F.concat_ws(":", "dataset", F.col("id.id").cast("string"))
    split = ratio_split(images.select("dataset", "id", key.alias("key")), "key", seed, 0.8, 0.1, within="dataset", cuts=(0.8, 0.9)).select(F.col("id").alias("image_id"), "split")
    paths = pictures.select("dataset", file_name(F.col("path")).alias("name"), "path").groupBy("dataset", "name").agg(F.min("path").alias("image"))
    rows = boxes.join(split, "image_id").withColumns({"dataset": F.col("image_id.dataset"), "name": file_name(F.col("file_name"))}).join(paths, ["dataset", "name"])
    return rows.select("dataset", F.lit("coco").alias("format"), "split", "image", *_COLUMNS[4:])


_COCO = (
    "images array<struct<id:long,width:double,height:double,file_name:string>>, "
    "annotations array<struct<image_id:long,category_id:long,iscrowd:int,bbox:array<double>>>, categories array<struct<id:long,name:string>>"
)


def _of_darknet(found: DataFrame, pictures: DataFrame, labels: DataFrame, small: DataFrame) -> DataFrame:
    lists = small.where(file_name(F.col("path")) == "_darknet.labels").withColumn("home", folder_of(F.col("path")))
    above = folder_of(F.col("home"))
    lists = lists.withColumn("split", F.coalesce(darknet_split(file_name(F.col("home"))), darknet_split(file_name(above)))).where("split is not null")
    known = F.filter(F.transform(F.split("value", r"\r?\n"), lambda e: F.trim(e)), lambda n: n != "")
    names = F.map_from_arrays(F.sequence(F.lit(0), F.size("names") - 1), F.col("names"))
    lists = lists.withColumn("names", known).where(F.size("names") > 0).select("home", "split", class_mapping(names).alias("mapping"))
    images = pictures.join(found.where("format = 'darknet'").select("dataset"), "dataset", "left_semi").join(lists, "home")
    label = F.concat("home", F.lit("/"), "stem", F.lit(".txt"))
    rows = _mapped(_numbers(_joined_labels(images.withColumn("label", label), labels)), "mapping").where(valid())
    return rows.select("dataset", F.lit("darknet").alias("format"), "split", F.col("path").alias("image"), *_COLUMNS[4:])


def _of_folders(found: DataFrame, pictures: DataFrame, seed: int) -> DataFrame:
    images = pictures.join(found.where("format = 'folders'").select("dataset"), "dataset", "left_semi").withColumn("class_id", class_id(parent(F.col("path")))).where("class_id is not null")
    rows = ratio_split(images, "path", seed, within="dataset", cuts=(0.8, 0.9))
    rows = rows.withColumns({"xc": F.lit(0.5), "yc": F.lit(0.5), "w": F.lit(1.0), "h": F.lit(1.0)})
    return rows.select("dataset", F.lit("folders").alias("format"), "split", F.col("path").alias("image"), *_COLUMNS[4:])


# ---------------------------------------------------------------- run summaries and manifests


def summaries(files: DataFrame) -> DataFrame:
    """JSON texts (path, value) -> path, summary: a VARIANT, so files of different keys are one column. Texts that aren't JSON have null."""
    return files.select("path", F.try_parse_json("value").alias("summary"))


def summary_value(path: str, kind: str, summary: Column | None = None) -> Column:
    """A value of a summary by its path (``a.b``), null where it is missing or of another kind."""
    return F.try_variant_get(F.col("summary") if summary is None else summary, f"$.{path}", kind)


def class_thresholds(path: str = "classwise_thresholds") -> Column:
    """The thresholds of a summary by class: its keys are written as text. Keys that are no whole numbers go."""
    raw = F.map_filter(summary_value(path, "map<string,double>"), lambda k, _: k.try_cast("int").isNotNull())
    return F.transform_keys(raw, lambda k, _: k.cast("int"))


def run_roots(spark: SparkSession, manifest: str, kind: str | None = None) -> DataFrame:
    """name, expected_summary, root of an experiment manifest (CSV with a header, or a JSON list): a run's root is the folder above that of
    its summary. Of rows of one name the last counts. A manifest without these columns is an error."""
    as_json = (kind or manifest.rsplit(".", 1)[-1]).lower() == "json"
    rows = spark.read.option("multiLine", True).json(manifest) if as_json else spark.read.csv(manifest, header=True, multiLine=True, escape='"')
    rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns}).withColumn("_n", F.monotonically_increasing_id())
    last = rows.groupBy("name").agg(F.max_by("expected_summary", "_n").alias("expected_summary"))
    up = lambda p: F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))
    clean = F.regexp_replace("expected_summary", r"[\\/]+", "/")
    return last.select("name", "expected_summary", up(up(clean)).alias("root"))

