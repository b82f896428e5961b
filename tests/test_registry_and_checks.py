import json
import os

import pytest

from tessera.config import PredictionSchemaError
from tessera.operators import profile as P
from tessera.plans.registry import Registry, export_json, new_id, now
from tessera.plans.scoring import check_prediction_count


def test_registry_list_read_and_json_export(spark, scratch):
    reg = Registry(spark, os.path.join(scratch, "reg"))
    ids = []
    for i in range(3):
        rid = new_id()
        ids.append(rid)
        reg.write("models", {"schema_version": 1, "model_id": rid, "lineage_kind": "run", "lineage_id": f"r{i}",
                             "task": "classification", "target": "t", "categorical_fill_value": "m",
                             "features": [{"name": "x", "dtype": "int", "role": "numeric"}], "model_path": "p"})
    assert sorted(r["model_id"] for r in reg.list("models").collect()) == sorted(ids)
    assert reg.read("models", ids[1])["lineage_id"] == "r1"
    with pytest.raises(KeyError):
        reg.read("models", "missing")
    out = export_json(reg, "models", os.path.join(scratch, "models_json"))
    lines = [json.loads(line) for f in os.listdir(out) if f.endswith(".json")
             for line in open(os.path.join(out, f)) if line.strip()]
    assert len(lines) == 3
    assert reg.table("runs").count() == 0  # empty table reads as empty


def test_prediction_count_check(spark):
    preds = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "k int, prediction double")
    with pytest.raises(PredictionSchemaError, match="infinite"):
        check_prediction_count(preds, 2)
    with pytest.raises(PredictionSchemaError, match="number of rows"):
        check_prediction_count(preds.limit(1), 2)


def test_approximate_distinct_profile_mode(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    exact = {r["column_name"]: r["unique_count"] for r in P.column_profiles(df).collect()}
    approx = {r["column_name"]: r["unique_count"] for r in P.column_profiles(df, exact_distinct=False).collect()}
    for name, n in exact.items():
        assert abs(approx[name] - n) <= max(3, 0.1 * n)


def test_digests_tell_apart_what_differs(spark):
    from tessera.functions.digest import table_fingerprint as fp

    def of(rows, schema="a string, b string"):
        return fp(spark.createDataFrame(rows, schema))
    assert of([("a|b", "c")]) != of([("a", "b|c")])
    assert of([(None, "c")]) != of([("\\N", "c")]) and of([(None, "c")]) != of([("-", "c")])
    assert of([("a", "b")]) != of([("a", "b")], "a string, z string")
    assert of([(1e-7,)], "x double") != of([(3e-7,)], "x double")
    assert of([(0.1 + 0.2,)], "x double") != of([(0.3,)], "x double")
    assert of([(0.0,)], "x double") == of([(-0.0,)], "x double")
    assert of([("a", "b"), ("c", "d")]) == of([("c", "d"), ("a", "b")])


def test_a_damaged_table_is_not_an_empty_one(spark, scratch):
    reg = Registry(spark, os.path.join(scratch, "reg"))
    os.makedirs(os.path.join(scratch, "reg", "runs", "id=x"))
    with open(os.path.join(scratch, "reg", "runs", "id=x", "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        reg.table("runs").collect()
