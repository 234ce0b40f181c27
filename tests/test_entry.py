"""The registry: names, SQL, independence of the llm folders, and queries against DuckDB at the smallest scale."""

import importlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from driftline import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_core_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


def test_llm_that_cannot_be_imported_is_left_out(tmp_path):
    """Without the tokenizers' package, say."""
    shutil.copytree(f"{ROOT}/driftline", tmp_path / "driftline", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    (tmp_path / "tokenizers.py").write_text("raise ImportError('none here')")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout) == len(catalog.QUERIES), said.stderr


def test_rest_imports_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/driftline", tmp_path / "driftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql())[:1])"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) == len(catalog.QUERIES)
    assert not any("llm" in open(os.path.join(d, f)).read() for d, _, names in os.walk(tmp_path / "driftline") for f in names if f.endswith(".py"))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x.tolist() if hasattr(x, "tolist") else x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_match_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted([plain(r[c]) for c in names] for r in df.collect()) == sorted([plain(r[k]) for k in at] for r in want.fetchall())


def test_entry(spark):
    importlib.reload(__spark_entry__)
    assert __spark_entry__.entry(spark).columns == ["relative_path", "action", "src_size", "dst_size"]
