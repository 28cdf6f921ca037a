"""Each catalogue query against its DuckDB twin: columns, row count and values."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strata.operators import reads
from strata.queries import ORACLE, QUERIES


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(names)


@pytest.fixture(scope="module")
def duck():
    d = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = duckdb.connect()
    for t in ("events", "orders", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con, d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    con, d = duck
    df = QUERIES[name](spark, d)
    got = rows_of(df.columns, df.collect())
    assert got[0]
    want = con.sql(ORACLE[name])
    assert got == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("keys", [range(120), range(0, 3000, 170), [5, 99, 100, 101, 731, 732, 5000], [8], []])
def test_next_key_over_the_whole_order(spark, keys):
    keys = [f"{k:016d}" for k in keys]
    view = spark.createDataFrame([(k, 1, 0.5) for k in keys], "key string, seq long, value double")
    got = reads.neighbours(view, F.substring("key", 1, 14))
    assert got.columns == ["key", "seq", "value", "next_key"]
    assert sorted((r.key, r.next_key) for r in got.collect()) == list(zip(keys, [*keys[1:], None]))


def test_next_key_query_crosses_buckets(spark, duck):
    _, d = duck
    keys = sorted(r.key for r in QUERIES["kv_latest"](spark, d).collect())
    assert sorted((r.key, r.next_key) for r in QUERIES["kv_next_key"](spark, d).collect()) == list(zip(keys, [*keys[1:], None]))
