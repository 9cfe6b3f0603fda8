"""Every query of the catalog against its SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
import check
from marginalia import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in check.TABLES:
        con.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert name in contract.oracle_sql() and name in contract.queries()
    good, note = check.compare(spark, con, SF_DIR, name)
    assert good, note


def test_entry_gives_reports(spark):
    df = contract.entry(spark)
    assert df.columns == ["report_path", "part_no", "markdown"]
    assert df.count() == 200


def test_entry_imports_without_the_corpus_package(tmp_path):
    root = os.path.dirname(os.path.abspath(contract.__file__))
    shutil.copytree(f"{root}/marginalia", tmp_path / "marginalia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    names = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path,
                                   env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert names() == list(catalog.QUERIES)
    # An empty folder, as compiled files leave one behind, and a pipeline without its package.
    (tmp_path / "marginalia/llm/__pycache__").mkdir(parents=True)
    (tmp_path / "corpus_pipeline.py").write_text("from marginalia.llm import packing\n")
    assert names() == list(catalog.QUERIES)
    # A mistake inside the package is not passed over.
    (tmp_path / "marginalia/llm/catalog.py").write_text("from .mistyped import x\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    with pytest.raises(subprocess.CalledProcessError):
        names()
