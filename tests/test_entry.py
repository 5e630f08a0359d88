"""Every query against its DuckDB statement, and the shape of the entry file."""

import os
import shutil
import subprocess
import sys

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_file
from goldrec.oracle import SQL
from goldrec.queries import QUERIES
from tools.check import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duck(SF)
    yield connection
    connection.close()


def test_every_query_has_a_statement():
    assert set(QUERIES) - set(SQL) == {"latency_quantiles_sketched"}  # a random sketch
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_file.queries())
    assert set(SQL) <= set(entry_file.oracle_sql())


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_the_optional_part(tmp_path):
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md")
    copy = tmp_path / "repo"
    shutil.copytree(entry_file.ROOT, copy, ignore=left_out)
    assert not os.path.exists(copy / "goldrec/llm")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for path in (copy, copy / "corpus_pipeline.py"):
        if path != copy:
            path.unlink()
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
        assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL))]


def test_a_rewritten_folder_is_read_again(spark, tmp_path):
    copy = tmp_path / "sf"
    shutil.copytree(SF, copy)
    before = QUERIES["customer_count"](spark, str(copy)).first().customers
    pq.write_table(pq.read_table(f"{SF}/events.parquet").slice(0, 8), copy / "events.parquet")
    assert 0 < QUERIES["customer_count"](spark, str(copy)).first().customers < before
