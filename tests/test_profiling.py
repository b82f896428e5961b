import pytest

from tessera.operators import profile as P
from tessera.operators.quantile import column_medians, exact_medians


def test_quality_counts_and_duplicates(spark):
    df = spark.createDataFrame([(1, 1.5, "k", "a"), (1, 1.5, "k", "a"), (2, None, "k", None)],
                               "id int, value double, constant string, target string")
    prof = P.profile_dataset(df, "target")
    assert prof.duplicate_row_count == 1
    assert prof.missing_cell_count == 2 and prof.missing_cell_ratio == pytest.approx(2 / 12, abs=1e-6)
    assert prof.column("constant")["is_constant"] is True
    assert "Dataset contains 2 missing cells." in prof.warnings
    assert "Target column 'target' contains missing values." in prof.warnings


def test_infinite_values_counted_but_not_summarised(spark):
    df = spark.createDataFrame([(float("inf"), 1), (float("-inf"), 0), (None, 1)], "value double, target int")
    col = P.profile_dataset(df, "target").column("value")
    assert col["infinite_count"] == 2 and col["minimum"] is None and col["median"] is None
    assert col["unique_count"] == 2 and col["missing_count"] == 1


def test_task_hints(spark):
    reg = spark.createDataFrame([(i, i / 10) for i in range(25)], "feature int, target double")
    assert P.target_summary(reg, "target").first()["task_hint"] == "regression"
    cls = spark.createDataFrame([(i, i % 3) for i in range(25)], "feature int, target int")
    assert P.target_summary(cls, "target").first()["task_hint"] == "classification"
    none = spark.createDataFrame([(1, None), (2, None)], "feature int, target string")
    t = P.target_summary(none, "target").first()
    assert t["task_hint"] == "undetermined"


def test_identifier_high_cardinality_and_imbalance(spark):
    rows = [(i, f"code-{i}", "minority" if i < 5 else "majority") for i in range(60)]
    df = spark.createDataFrame(rows, "record_id int, external_code string, target string")
    prof = P.profile_dataset(df, "target")
    assert prof.column("record_id")["is_likely_identifier"] is True
    assert prof.column("external_code")["is_high_cardinality"] is True
    assert prof.target["imbalance_warning"] is True
    assert [d["value"] for d in prof.class_distribution] == ["majority", "minority"]


def test_medians_in_memory_and_bucketed_paths_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    long = df.selectExpr("'q' AS g", "l_extendedprice AS v").unionByName(
        df.selectExpr("'d' AS g", "l_discount AS v"))
    fast = {r["g"]: r["median"] for r in exact_medians(long, ["g"], "v").collect()}
    slow = {r["g"]: r["median"] for r in exact_medians(long, ["g"], "v", in_memory_limit=0, buckets=16).collect()}
    exact = {g: float(long.filter(f"g = '{g}'").selectExpr("median(v)").first()[0]) for g in ("q", "d")}
    assert fast == pytest.approx(exact) and slow == pytest.approx(exact)


def test_profile_json_is_deterministic(spark):
    import json

    df = spark.createDataFrame([(1, float("inf"), "a"), (2, 2.0, "b"), (3, None, "a")],
                               "id int, value double, target string")
    text = P.profile_dataset(df, "target").to_json()
    assert json.loads(text)["columns"][1]["infinite_count"] == 1
    assert text == P.profile_dataset(df, "target").to_json()


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_bucketed_median_exact_with_heavy_ties(spark, n):
    from pyspark.sql import functions as F

    # A third of the rows share one value; the rest spread around it.
    rows = [("g", 5.0)] * (n // 3 + 1) + [("g", float(i % 11)) for i in range(n)] + [("h", float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    bucketed = {r["g"]: r["median"] for r in exact_medians(df, ["g"], "v", in_memory_limit=0, buckets=8).collect()}
    exact = {r["g"]: float(r["m"]) for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert bucketed == pytest.approx(exact)


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
@pytest.mark.parametrize("bracket_rows", [30, 1_000_000])
def test_column_medians_are_exact_wherever_the_bracket_lies(spark, n, bracket_rows):
    from pyspark.sql import functions as F

    df = spark.range(n).select(
        (F.col("id") % 11).cast("double").alias("tied"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 7).alias("spread"),
        F.when(F.col("id") % 3 == 0, -F.col("id").cast("double")).alias("some"),
        F.lit(None).cast("double").alias("none"))
    got = column_medians(df, {c: F.col(c) for c in df.columns}, n, bracket_rows=bracket_rows)
    exact = df.agg(*[F.median(c).alias(c) for c in df.columns]).first().asDict()
    assert got == pytest.approx({c: m for c, m in exact.items() if m is not None})


def test_rows_of_different_hash_are_not_digested(spark):
    """Only rows whose hash repeats are spelled and digested."""
    from pyspark.sql import functions as F

    rows = spark.range(50).select((F.col("id") / 4).alias("v"), F.col("id").cast("string").alias("t"))
    plan = P.duplicate_row_count(rows)
    assert plan.first()["duplicate_rows"] == 0 and "sha2" not in plan._jdf.queryExecution().toString()
    zeros = spark.createDataFrame([(0.0, None, "a"), (-0.0, None, "a"), (0.0, "a", None), (float("nan"), None, "a"),
                                   (float("nan"), None, "a")], "v double, s string, t string")
    assert P.duplicate_row_count(rows.union(rows.limit(7))).first()["duplicate_rows"] == 7
    assert P.duplicate_row_count(zeros).first()["duplicate_rows"] == 2


def test_exact_text_is_that_of_the_format(spark):
    from pyspark.sql import functions as F

    from tessera.functions.digest import exact_text

    values = [0.1, -1.5, 1e300, 5e-324, 2.2250738585072014e-308, float("inf"), float("-inf"), float("nan"), 123456.78]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    assert df.filter(exact_text(F.col("d")) != F.format_string("%a", "d")).isEmpty()


def test_fingerprint_is_that_of_the_row_tokens(spark):
    import hashlib

    from pyspark.sql import functions as F

    from tessera.functions.digest import multiset_digest, table_fingerprint, value_token

    df = spark.range(40).select("id", (F.col("id") / 7 - 2).alias("d"),
                                F.when(F.col("id") % 3 > 0, F.lit("x:1")).alias("t"),
                                F.to_date(F.lit("2020-02-29")).alias("day"), (F.col("id") > 9).alias("b"))
    head = "".join(f"{len(part)}:{part}" for column in df.dtypes for part in column)
    token = multiset_digest(df, value_token(df)).first()["digest"]
    assert table_fingerprint(df) == hashlib.sha256(f"{head}|{token}".encode()).hexdigest()
