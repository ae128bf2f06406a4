"""Every query of the practice domain against its oracle in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lessonloom.plans import ORACLES, QUERIES
from lessonloom.plans.frames import TABLES

FOLDER = "/root/testdata/sf0.001"


def plain(x):
    return round(x, 9) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set threads = 4")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_frames_are_read_by_both(db):
    from lessonloom.plans.frames import FRAMES, duck

    for name in FRAMES:
        db.execute(f"select * from {duck('@' + name)} limit 1").fetchall()
