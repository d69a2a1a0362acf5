"""Every ledger query against its SQL on the smallest tables."""

import hashlib
import os

import duckdb
import pytest

from ledgerloom import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, FOLDER)
    if name not in plans.SQL:
        assert name in ("X04_blake2b", "L12_seeded_sample")  # held against stored values below
        return
    want = duck.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable([tuple(r) for r in got.collect()], got.columns) == comparable(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_digests_of_the_whole_table(spark, duck):
    want = {i: hashlib.blake2b(n.encode(), digest_size=32, person=b"ledgerloom").hexdigest() for i, n in duck.sql("SELECT p_partkey, p_name FROM part").fetchall()}
    got = {r["item"]: r["digest"] for r in plans.QUERIES["X04_blake2b"](spark, FOLDER).collect()}
    assert got == want and want[1] == "b7379ca1d3450a0eeaeddba089006e30634f42ffbac9636d00af4bccc84bb5e4"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_the_seeded_sample_is_stored(spark):
    got = sorted(r["outpoint"] for r in plans.QUERIES["L12_seeded_sample"](spark, FOLDER).collect())
    assert len(got) == 100 and got[:5] == [11, 21, 140, 197, 203] and sum(got) == 82111
