"""Every query of the catalogue against its SQL on DuckDB, over the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from assaykit.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, FOLDER)
    got = rows(frame.columns, frame.collect())
    if name in catalogue.ORACLES:
        cursor = duck.execute(catalogue.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert got == rows(names, cursor.fetchall())
    else:
        assert got[0]


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    """The entry must import, and the other queries stay, when the corpus files are deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/assaykit", tmp_path / "assaykit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
