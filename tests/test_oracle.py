"""Every registered query with an oracle equals its DuckDB SQL (sf0.001 fixture).

The same comparison runs at sf0.01 with ``python tools/oracle_check.py``.
"""

import pytest

from feedpulse.plans.compare import connect_duckdb, rows_of, spark_types
from feedpulse.plans.registry import ORACLE, QUERIES, load_all

from paths import SF_SMALL

load_all()
# model fits are rows-only (no oracle) and slow; they have their own property tests
SLOW = {"topic_model_scores", "email_model_scores", "email_epoch_log", "rating_model_scores",
        "sentiment_model_scores", "nightly_sentiment", "nightly_topic"}


@pytest.fixture(scope="module")
def con():
    return connect_duckdb(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    got = rows_of(cols, [tuple(r) for r in df.collect()])
    rel = con.sql(ORACLE[name])
    assert spark_types(df) == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    assert got == rows_of(ocols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0
