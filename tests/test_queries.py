import glob
import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import table_queries

SF = "/root/testdata/sf0.001"


def plain(frame, cols):
    def one(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 4)) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiu" or type(v) is int else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(table_queries.QUERIES))
def test_query_matches_sql(spark, name):
    got = table_queries.QUERIES[name](spark, SF).toPandas()
    if name not in table_queries.SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(table_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


def test_checksums_cover_whole_texts(spark):
    def plain_fnv1a(data):
        h = 2166136261
        for c in data:
            h = (h ^ c) * 16777619 % 2**32
        return h

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert max(map(len, texts.values())) > 64
    got = {r[0]: tuple(r)[1:] for r in table_queries.QUERIES["q_checksums"](spark, SF).collect()}
    assert got == {i: (zlib.crc32(b), plain_fnv1a(b)) for i, b in texts.items()}


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
