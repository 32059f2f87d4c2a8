import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from gridlark.plans import queries as detection

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_every_detection_query_is_listed_once():
    assert set(detection.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["a12_threshold_sweep", "p06_decisions", "j05_confusion_pairs", "s02_strict_label_counts", "l11_class_quota", "l11_box_quota", "w10_unique_names", "s10_harmonized_datasets", "j11_far_hashes"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda df: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert rows(want) == rows(got)


def test_imports_without_the_corpus_package(tmp_path):
    """The entry module and the rest work where the corpus folders are gone."""
    import shutil

    shutil.copytree(ROOT / "gridlark", tmp_path / "gridlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'j04_greedy_match' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
