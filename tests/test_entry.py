"""Driver contract and Spark-vs-DuckDB agreement at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

TABLES = ["documents", "embeddings", "conversations", "events", "labels", "pages", "benchmark"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"source", "reason", "n"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_oracle(spark, con, name):
    pdf = E.queries()[name](spark, SF_SMALL).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    assert sorted(pdf.columns) == sorted(odf.columns)
    cols = sorted(pdf.columns)

    def rows(df):
        return sorted((tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")), key=repr)
    assert rows(pdf) == rows(odf)


def test_fixture_counts_sf001(spark):
    """Independent counts from FIXTURES.md section 2 (sf0.01)."""
    sf = "/root/testdata/sf0.01"
    q = E.queries()
    reasons = {r["reason"]: r["count"] for r in q["utterance_quality"](spark, sf).groupBy("reason").count().collect()}
    assert reasons == {"meaningful": 578, "extreme_length": 382, "repetitive corruption": 35,
                       "too short and no emotional content": 5}
    seeds = {r["seed_reason"]: r["count"] for r in q["seed_quality"](spark, sf).groupBy("seed_reason").count().collect()}
    assert seeds == {"good_seed": 143, "too_long": 377, "too_short": 14, "simple_question": 2}
    roles = {r["reason"]: r["n"] for r in q["skip_funnel"](spark, sf).filter("source = 'EmpatheticDialogues'").collect()}
    assert roles == {"unmapped": 16, "skip_flag": 9, "processed": 511}
