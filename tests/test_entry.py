"""The driver's contract: names match, queries equal their SQL on the smallest tables."""

import dataclasses
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from ionweave import queries
from ionweave.config import SearchConfig
from ionweave.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def cells(df: pd.DataFrame) -> list:
    def one(v):
        if pd.isna(v):
            return ""
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False))


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert cells(got) == cells(expected)


@pytest.mark.parametrize("name", ["deisotope", "dia_greedy_search", "mf_impute"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_greedy_search_runs_as_configured(spark, monkeypatch):
    used = []
    monkeypatch.setattr(queries, "window_search", lambda raw, index, config: used.append(config) or raw)
    QUERIES["dia_greedy_search"](spark, SF)
    own = SearchConfig()
    assert {f.name for f in dataclasses.fields(own) if getattr(own, f.name) != getattr(used[0], f.name)} == {"g_tolerances", "g_tolerance_units"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
