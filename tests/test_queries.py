"""Every query against its SQL, and the driver's contract."""

import importlib
import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from auditloom.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(df):
    def one(v):
        if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return None
        return repr(round(float(v), 6)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), sql.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_other_queries_run(spark):
    for name in QUERIES.keys() - ORACLE_SQL.keys():
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_entry_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).parent.parent
    shutil.copytree(root / "auditloom", tmp_path / "auditloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert told.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]


def test_entry_tells_of_a_library_that_the_corpus_operators_miss(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "xxhash":
                raise ModuleNotFoundError(name, name=name)

    if not importlib.util.find_spec("corpus_pipeline"):
        pytest.skip("there are no corpus operators")
    for name in [m for m in sys.modules if m.startswith("auditloom.llm") or m in ("corpus_pipeline", "__spark_entry__", "xxhash")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError, match="xxhash"):
        importlib.import_module("__spark_entry__")
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
