"""Every registered query against its DuckDB twin on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from review_insights.plans import catalog
from tools.oracle_check import TABLES, rows_of

QUERIES = catalog.QUERIES
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def _spark_kind(t):
    if t.startswith("array"):
        return "array"
    return {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "boolean": "bool",
            "string": "text"}.get(t, "float" if t.startswith("decimal") else t)


def _duck_kind(t):
    t = str(t)
    if t.endswith("[]"):
        return "array"
    return {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "int", "SMALLINT": "int", "DOUBLE": "float", "FLOAT": "float",
            "BOOLEAN": "bool", "VARCHAR": "text"}.get(t, "float" if t.startswith("DECIMAL") else t)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    twin = con.sql(ORACLE[name])
    assert {c: _spark_kind(t) for c, t in df.dtypes} == {c: _duck_kind(t) for c, t in zip(twin.columns, twin.types)}
    scols, srows = rows_of(df.toPandas())
    dcols, drows = rows_of(twin.df())
    assert scols == dcols
    assert srows == drows


def test_only_the_trained_model_has_no_twin():
    assert set(QUERIES) - set(ORACLE) == {"score_mllib"}


def test_trained_model_scores_every_review(spark, sf_small):
    df = QUERIES["score_mllib"](spark, sf_small)
    rows = df.collect()
    assert len(rows) == QUERIES["conform"](spark, sf_small).where("review_text IS NOT NULL AND rating IS NOT NULL").count()
    assert {r["bert_sentiment"] for r in rows} <= {"positive", "negative", "neutral"}
    assert all(1 / 3 - 1e-6 <= r["bert_confidence"] <= 1 for r in rows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"problem_type", "count", "percentage", "avg_rating", "avg_confidence"}
    assert df.count() > 0
