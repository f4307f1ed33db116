"""Each query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from folioscope import plans

TOP = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{TOP}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(shown, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, TOP)
    cols = sorted(df.columns)
    got = sorted((tuple(shown(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(plans.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(shown(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, TOP).count() > 0


def test_chunks_cover_all_words(spark):
    """Every non-blank line of a document is in its layout chunks, in order."""
    from pyspark.sql import functions as F

    made = plans.texts.chunk.chunk(plans.texts._blocks(spark, TOP), ("layout",), target=64, overlap=0)
    chunks = made.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("seq", "block_ids"))).alias("c"))
    ids = {r.document_id: [b for c in r.c for b in c.block_ids] for r in chunks.collect()}
    want = {}
    for r in plans.texts._blocks(spark, TOP).orderBy("document_id", "reading_order").collect():
        want.setdefault(r.document_id, []).append(r.block_id)
    assert ids == want
