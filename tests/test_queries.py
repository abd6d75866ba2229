"""Every registered query against its SQL in DuckDB on the smallest tables; the rest must give rows."""

import importlib
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from editloom.plans import registry
from tests.conftest import DATA

FOLDER = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Run once each in other tests, or in the bench alone.
SLOW = {"l4_gbtr", "l5_logit", "l6_gbtc", "t18_covariate", "t12_mean", "t12_gmean", "t12_median", "t12_bootstrap_poisson", "l10_rare_regress", "l10_rare_classify", "l11_curve", "t12_by_length", "t12_gmean_multinomial", "t18_seeds"}
#: Queries that find nothing on the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return None
        return f"{x:.6g}" if isinstance(x, (float, np.floating)) else str(int(x)) if isinstance(x, (int, bool, np.integer, np.bool_)) else str(x)

    return sorted((tuple(cell(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0 or name in EMPTY
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns == ["condition", "position", "ref_nt", "obs_nt", "cells", "mean_activity"]


def test_the_rest_works_without_the_optional_parts(monkeypatch):
    for name in ("corpus_pipeline", "editloom.llm", "editloom.llm.queries"):
        monkeypatch.delitem(sys.modules, name, raising=False)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("editloom.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    again = importlib.reload(entry)
    assert set(again.queries()) == set(registry.queries()) and set(again.oracle_sql()) == set(registry.oracle_sql())
