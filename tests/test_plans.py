"""Structural checks on physical plans: the properties the scale design relies on."""

import re

from tessera import catalog
from tessera.functions.digest import multiset_digest, value_token
from tessera.operators import profile as P

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scanned_columns(plan: str) -> set[str]:
    cols = set()
    for m in re.finditer(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan):
        cols |= {c.split("#")[0] for c in m.group(1).split(",")}
    return cols


def test_split_ranks_inside_hash_buckets_with_pruned_scan(spark):
    plan = plan_of(catalog.REGISTRY["kfold_assign"][0](spark, SF))
    # Rows are shuffled by (class, bucket) for the rank window.
    assert re.search(r"hashpartitioning\(o_orderstatus#\d+, _bkt#\d+L?", plan)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    # At most one single-partition exchange: the per-class totals (one row per class).
    assert plan.count("SinglePartition") <= 1
    assert scanned_columns(plan) == {"o_orderkey", "o_orderstatus"}


def test_split_scan_reads_only_needed_columns(spark):
    plan = plan_of(catalog.REGISTRY["split_stratified"][0](spark, SF))
    assert scanned_columns(plan) == {"event_id", "event_type"}


def test_profile_has_no_distinct_expansion(spark):
    plan = plan_of(P.column_profiles(spark.read.parquet(f"{SF}/orders.parquet")))
    assert "Expand" not in plan


def test_digest_is_a_plain_two_phase_aggregation(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    plan = plan_of(multiset_digest(orders, value_token(orders)))
    assert "partial_sum" in plan
    assert "Window" not in plan and "Sort" not in plan and "collect_list" not in plan


def test_class_distribution_is_top_k_not_window(spark):
    plan = plan_of(P.class_distribution(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderpriority"))
    assert "TakeOrderedAndProject" in plan or "Limit" in plan
    assert "NestedLoopJoin" not in plan
