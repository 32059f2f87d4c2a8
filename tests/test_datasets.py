"""Datasets in real folders: catalogs, formats, and one table of boxes against plain reading."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridlark.functions.catalog import CLASSES
from gridlark.sources import datasets


def put(path, text="pixels"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


CATALOGS = {
    "list": ("names: [ripe, 'under ripe', \"mentah\"]\ntrain: ../train/images\nval: valid/images\nnc: 3\n", {0: "ripe", 1: "under ripe", 2: "mentah"}),
    "block": ("# comment\npath: /data/x\ntrain: train/images  # there\nval: ''\nnc: 2\nnames:\n- ripe # a\n- 'a # b'\ntest:\n", {0: "ripe", 1: "a # b"}),
    "map": ("﻿path: ../../up\nnames:\n  0: abnormal\n  3: 'ripe'\n  '5': \"un:ripe\"\nval: valid/images\n", {0: "abnormal", 3: "ripe", 5: "un:ripe"}),
    "inline": ("names: {0: a, 2: 'b, c'}\n", {0: "a", 2: "b, c"}),
    "several lines": ("names: ['a',\n  b,\n  'c']\nnc: 3", {0: "a", 1: "b", 2: "c"}),
    "none": ("train: x\n", {}),
    "empty": ("", {}),
}


def test_catalog_fields():
    for text, names in CATALOGS.values():
        assert datasets.catalog_fields(text)["names"] == names
    with pytest.raises(ValueError):
        datasets.catalog_fields("names:\n  a: ripe\n")


def test_catalogs_from_a_store(spark, tmp_path):
    for k, (text, _) in CATALOGS.items():
        put(tmp_path / "sets" / k.replace(" ", "_") / "data.yaml", text)
    put(tmp_path / "sets" / "bad" / "data.yaml", "names:\n  a: ripe\n")
    rows = {r.catalog.rsplit("/", 2)[1]: r for r in datasets.catalogs(datasets.texts(spark, str(tmp_path), ["data.y*ml"])).collect()}
    base = f"file:{tmp_path}/sets"
    assert "empty" not in rows  # Spark's readers give no row for a file without bytes
    for k, (_, names) in CATALOGS.items():
        if k == "empty":
            continue
        assert rows[k.replace(" ", "_")].names == names and rows[k.replace(" ", "_")].error is None
    assert (rows["list"].root, rows["list"].train, rows["list"].valid, rows["list"].test) == (f"{base}/list", f"{base}/train/images", f"{base}/list/valid/images", None)
    assert (rows["block"].root, rows["block"].train, rows["block"].valid, rows["block"].nc) == ("/data/x", "/data/x/train/images", "/data/x", 2)
    assert (rows["map"].root, rows["map"].valid) == (f"file:{tmp_path}/up", f"file:{tmp_path}/up/valid/images")
    assert rows["bad"].error and rows["bad"].names is None and rows["bad"].root is None


def test_catalog_text_reads_back(spark):
    text = spark.range(1).select(datasets.catalog_text(F.lit("/a/b")).alias("t")).first()[0]
    got = datasets.catalog_fields(text)
    assert got["names"] == CLASSES and (got["path"], got["train"], got["val"], got["nc"]) == ("/a/b", "train/images", "valid/images", len(CLASSES))


def test_paths_are_resolved(spark):
    cases = {("/a/b", "../c"): "/a/c", ("/a", "../../.."): "/", ("file:/a/b", "./x//y/."): "file:/a/b/x/y", ("s3a://k/a", "../b"): "s3a://k/b", ("/a", "/q/../r"): "/r", ("/a", "hdfs://h/x"): "hdfs://h/x"}
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "base string, path string, want string").withColumn("got", datasets.resolved(F.col("base"), F.col("path")))
    for r in rows.collect():
        assert r.got == r.want, r


def folder(root):
    """Datasets of each format; every label is of one box."""
    line = lambda c, x=0.5: f"{c} {x} 0.5 0.2 0.2\n"
    put(root / "yolo/data.yaml", "train: ../train/images\nval: valid/images\nnames: [masak, junk, Under-Ripe]\n")
    put(root / "yolo/other.json", json.dumps({"images": [], "annotations": [], "categories": []}))
    for i, text in enumerate([line(0), line(1), line(2, 1.5), "0 .5 .5 .2\nx 1 1 1 1\n2.7 0.5 0.5 0.2 0.2\n", ""]):
        put(root / f"yolo/train/images/a{i}.jpg")
        put(root / f"yolo/train/labels/a{i}.txt", text)
    put(root / "yolo/valid/images/v.png")
    put(root / "yolo/valid/labels/v.txt", line(2) + line(0))
    put(root / "yolo/valid/images/unlabelled.png")
    put(root / "coco/notes.json", "{not json")
    put(root / "coco/deep/ann.json", json.dumps({
        "images": [{"id": i, "width": 100, "height": 50, "file_name": f"x/{i}.jpg"} for i in range(10)],
        "categories": [{"id": 7, "name": "Ripe"}, {"id": 8, "name": "leaf"}],
        "annotations": [{"image_id": i, "category_id": 7 if i % 2 else 8, "iscrowd": int(i == 3), "bbox": [10, 10, 20, 20]} for i in range(10)] + [{"image_id": 1, "category_id": 7, "bbox": [0, 0, 0, 5]}],
    }))
    for i in range(9):
        put(root / f"coco/imgs/{i}.jpg")
    for split in ("train_rev", "val", "other"):
        put(root / f"dark/{split}/part/_darknet.labels", "ripe\n\n unripe \nfoo\n")
        put(root / f"dark/{split}/part/i.jpg")
        put(root / f"dark/{split}/part/i.txt", line(0) + line(1, 1.2) + line(2) + line(1) + "1 0.5 0.5 0 0.1\n")
    for i in range(10):
        put(root / f"flat/{'ripe' if i % 2 else 'weeds'}/{i}.jpeg")
    put(root / "nothing/readme.txt", "x")
    put(root / "loose.jpg")


def test_formats_and_boxes(spark, tmp_path):
    root = tmp_path / "sets"
    folder(root)
    lists = datasets.class_lists(spark, str(root))
    files = datasets.listing(spark, str(root)).select("path").unionByName(lists.select("path"))
    small = datasets.texts(spark, str(root), ["*.yaml", "*.json", "*.txt"]).unionByName(lists)
    one = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    files, small = one(files).cache(), one(small).cache()
    found = {r.dataset: (r.format, r.source and r.source.removeprefix(f"{root}/")) for r in datasets.formats(files, small, str(root)).collect()}
    assert found == {"yolo": ("catalog", "yolo/data.yaml"), "coco": ("coco", "coco/deep/ann.json"), "dark": ("darknet", "dark/other/part/_darknet.labels"), "flat": ("folders", None)}
    rows = datasets.harmonized(files, small, str(root)).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.dataset, []).append((r.split, r.image.removeprefix(f"{root}/{r.dataset}/"), r.class_id, round(r.xc, 6), round(r.w, 6)))
    # ../train/images holds nothing, so train/images beside the catalog is taken
    assert sorted(by["yolo"]) == sorted([("train", "train/images/a0.jpg", 3, 0.5, 0.2), ("train", "train/images/a2.jpg", 4, 1.5, 0.2), ("train", "train/images/a3.jpg", 4, 0.5, 0.2), ("valid", "valid/images/v.png", 4, 0.5, 0.2), ("valid", "valid/images/v.png", 3, 0.5, 0.2)])
    assert sorted(x[1:] for x in by["coco"]) == [(f"imgs/{i}.jpg", 3, 0.2, 0.2) for i in (1, 5, 7)]
    assert sorted(by["dark"]) == sorted([(s, f"{f}/part/i.jpg", c, 0.5, 0.2) for s, f in (("train", "train_rev"), ("valid", "val")) for c in (3, 5)])
    assert sorted(x[1:] for x in by["flat"]) == [(f"ripe/{i}.jpeg", 3, 0.5, 1.0) for i in (1, 3, 5, 7, 9)] and sorted(x[0] for x in by["flat"]) == ["test", "train", "train", "train", "train"]
    assert datasets.formats(files.where("false"), small.where("false"), str(root)).count() == 0


def test_summaries_and_manifests(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps({"name": "x", "classwise_thresholds": {"0": 0.4, "5": 1, "all": 0.5}, "deep": {"n": 3}}))
    put(tmp_path / "b.json", json.dumps({"name": 7, "more": [1]}))
    put(tmp_path / "c.json", "broken")
    got = datasets.summaries(datasets.texts(spark, str(tmp_path), ["*.json"]))
    got = got.select(F.element_at(F.split("path", "/"), -1).alias("f"), datasets.class_thresholds().alias("t"), datasets.summary_value("deep.n", "int").alias("n"), datasets.summary_value("name", "string").alias("name"))
    assert {r.f: (r.t, r.n, r.name) for r in got.collect()} == {"a.json": ({0: 0.4, 5: 1.0}, 3, "x"), "b.json": (None, None, "7"), "c.json": (None, None, None)}
    rows = [("r1", "runs/r1/reports/s.json"), ("r2", "C:\\\\x\\\\r2\\\\reports\\\\s.csv"), ("r1", "again/r1/reports/s.json"), ("r3", "s.json")]
    put(tmp_path / "m.json", json.dumps([{"name": n, "expected_summary": p, "seed": 1} for n, p in rows]))
    put(tmp_path / "m.csv", "﻿name,note,expected_summary\r\n" + "".join(f'{n},"a, ""b""",{p}\r\n' for n, p in rows))
    want = {"r1": "again/r1", "r2": "C:/x/r2", "r3": "."}
    for f in ("m.json", "m.csv"):
        assert {r.name: r.root for r in datasets.run_roots(spark, str(tmp_path / f)).collect()} == want


def test_run_roots_match_sql(spark, tmp_path):
    """A run for each supplier, also of names that repeat, are missing, or have quotes and white space at their ends."""
    duckdb = pytest.importorskip("duckdb")
    names = ["a", "a", " b ", 'c, "d"', None, "", "e:f", "tail\n", "back\\", "a"]
    rows = [(10 * i + k, name) for i, name in enumerate(names) for k in (8, 9)] + [(None, "no key")]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["s14_run_roots"]).fetchall()
    got = entry.queries()["s14_run_roots"](spark, str(tmp_path))
    assert got.columns == ["name", "root"] and len(want) == 2 * len(names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
