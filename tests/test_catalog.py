"""Registered queries against their SQL in DuckDB on sf0.001 (fast subset)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FAST = ["profile_columns_orders", "split_stratified", "kfold_assign", "fold_snapshots", "partition_digest",
        "standardize_events", "onehot_long", "fold_local_stats", "metrics_classification", "dummy_cv_metrics",
        "dataset_digest", "check_finite", "class_distribution_quality", "target_summary_quality"]


def _norm(rows):
    def f(v):
        return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(f(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_sql_key_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 6


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    recs = cur.fetchall()
    assert _norm(df.select(*cols).collect()) == _norm([tuple(r[dcols.index(c)] for c in cols) for r in recs])
