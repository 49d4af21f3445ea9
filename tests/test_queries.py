"""Every registered query against its check SQL, on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from threadloom.plans.catalog import QUERIES
from threadloom.plans.oracle import ORACLE

ROOT = Path(__file__).resolve().parents[1]
SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"html_to_markdown_pages"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, str(SF_DIR))
    columns = sorted(df.columns)
    rows = [tuple(row[c] for c in columns) for row in df.collect()]
    assert rows
    if name in ORACLE:
        result = tables.execute(ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        expected = [tuple(row[i] for i in order) for row in result.fetchall()]
        assert sorted(rows, key=str) == sorted(expected, key=str)


def test_entry_from_another_folder(tmp_path):
    """The contract file loads without a session, and tasks find their code wherever the job is started."""
    code = (
        f"import importlib.util as u; s = u.spec_from_file_location('e', {str(ROOT / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"print(m.entry(spark).count(), m.queries()['select_nodes'](spark, {str(SF_DIR)!r}).count() > 0)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=True)
    count, found = done.stdout.split()[-2:]
    assert int(count) > 0 and found == "True"
