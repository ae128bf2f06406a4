"""Queries that make ids from 1,000,000 on, over passages that have such ids themselves, against their oracles."""

import os

import duckdb
import pytest

from lessonloom.plans import ORACLES, QUERIES
from lessonloom.plans.frames import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = str(tmp_path_factory.mktemp("large_keys"))
    for t in TABLES:
        if t == "part":
            duckdb.execute(f"copy (select * replace (p_partkey + k as p_partkey) from '/root/testdata/sf0.01/part.parquet', (values (0), (1000000)) as t(k)) to '{made}/part.parquet' (format parquet)")
        else:
            os.symlink(f"{FOLDER}/{t}.parquet", f"{made}/{t}.parquet")
    return made


@pytest.mark.parametrize("name", ["a7_upsert", "d3_delete_impact", "k5_catalogs", "k5_publish", "k5_refused", "k6_studio_save", "k6_refused"])
def test_large_keys(spark, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)
