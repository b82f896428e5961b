"""Append-only registry tables (runs, benchmarks, cv_benchmarks, final_models, models).

Each record is one row written create-only under ``<root>/<table>/id=<uuid>``
(``mode('errorifexists')``); reading a table reads every record directory.
The root should be shared storage (the same place as checkpoints on a
cluster).
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

METRIC = "struct<name:string,value:double,higher_is_better:boolean>"
FAILURE = "struct<error_type:string,message:string>"
SPLIT = "struct<train_rows:bigint,validation_rows:bigint,feature_count:int,stratified:boolean,partition_sha256:string>"
DATASET = "struct<source:string,fingerprint:string,row_count:bigint,column_count:int,target:string>"
CONFIGURATION = (
    "struct<task:string,estimator:string,validation_fraction:double,random_seed:bigint,"
    "stratify_requested:boolean,numeric_imputation:string,scale_numeric:boolean,"
    "categorical_fill_value:string,numeric_overrides:array<string>,categorical_overrides:array<string>,"
    "estimator_parameters:array<struct<name:string,value:string>>>"
)

CV_CONFIGURATION = (
    "struct<numeric_imputation:string,scale_numeric:boolean,categorical_fill_value:string,"
    "numeric_overrides:array<string>,categorical_overrides:array<string>,fold_count:int,random_seed:bigint,"
    "forest:struct<trees:int,max_depth:int,max_bins:int,memory_mb:int>>"
)

SCHEMAS = {
    "runs": (
        f"schema_version int, run_id string, status string, started_at string, completed_at string, "
        f"configuration {CONFIGURATION}, dataset {DATASET}, environment map<string,string>, split {SPLIT}, "
        f"metrics array<{METRIC}>, warnings array<string>, failure {FAILURE}"
    ),
    "benchmarks": (
        f"schema_version int, benchmark_id string, status string, started_at string, completed_at string, "
        f"primary_metric string, dataset {DATASET}, split {SPLIT}, higher_is_better boolean, "
        f"entries array<struct<estimator:string,run_id:string,status:string,duration_seconds:double,"
        f"rank:int,primary_metric_value:double,failure:{FAILURE}>>"
    ),
    "cv_benchmarks": (
        f"schema_version int, benchmark_id string, status string, started_at string, completed_at string, "
        f"primary_metric string, random_seed bigint, configuration {CV_CONFIGURATION}, dataset {DATASET}, "
        f"fold_plan_sha256 string, "
        f"folds array<struct<fold_number:int,train_rows:bigint,validation_rows:bigint,partition_sha256:string>>, "
        f"warnings array<string>, entries array<struct<estimator:string,parameters:array<struct<name:string,value:string>>,"
        f"status:string,rank:int,primary_metric_mean:double,primary_metric_standard_deviation:double,"
        f"metrics:array<struct<name:string,fold_values:array<double>,mean:double,standard_deviation:double,"
        f"higher_is_better:boolean>>,duration_seconds:double,failure_fold:int,"
        f"failure_partition_sha256:string,failure:{FAILURE}>>"
    ),
    "final_models": (
        f"schema_version int, final_model_id string, status string, started_at string, completed_at string, "
        f"selection struct<benchmark_id:string,record_sha256:string,estimator:string,primary_metric:string,"
        f"mean:double,standard_deviation:double,fold_count:int,fold_plan_sha256:string,stored_sha256:string>, "
        f"dataset {DATASET}, configuration {CV_CONFIGURATION}, fit_scope string, training_rows bigint, "
        f"feature_count int, "
        f"model_path string, model_sha256 string, warnings array<string>, failure {FAILURE}"
    ),
    "models": (
        "schema_version int, model_id string, lineage_kind string, lineage_id string, task string, "
        "target string, categorical_fill_value string, "
        "features array<struct<name:string,dtype:string,role:string>>, model_path string, "
        "files array<struct<file:string,bytes:bigint,sha256:string>>, files_sha256 string, contract_sha256 string"
    ),
}

ID_FIELD = {"runs": "run_id", "benchmarks": "benchmark_id", "cv_benchmarks": "benchmark_id",
            "final_models": "final_model_id", "models": "model_id"}


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def new_id() -> str:
    return str(uuid.uuid4())


class Registry:
    """Create-only record tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def write(self, table: str, record: dict) -> str:
        """Append one record; an existing id is an error, never overwritten."""
        rid = record[ID_FIELD[table]]
        path = f"{self.root}/{table}/id={rid}"
        df = self.spark.createDataFrame([record], schema=SCHEMAS[table])
        df.coalesce(1).write.mode("errorifexists").parquet(path)
        return path

    def table(self, name: str) -> DataFrame:
        """All records of a table; empty only if none was ever written.  A
        folder that cannot be read is an error, not an empty table."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/id=*")

    def read(self, name: str, rid: str) -> dict:
        """One record by id; the id must equal the key."""
        rows = self.table(name).filter(F.col(ID_FIELD[name]) == rid).collect()
        if len(rows) != 1:
            raise KeyError(f"No unique {name} record {rid!r}.")
        return rows[0].asDict(recursive=True)

    def digests(self, name: str) -> DataFrame:
        """``(id, stored_sha256)``: a digest of every stored record."""
        held = self.table(name)
        return held.select(F.col(ID_FIELD[name]).alias("id"), F.sha2(F.to_json(F.struct("*")), 256).alias("stored_sha256"))

    def list(self, name: str) -> DataFrame:
        """Chronological listing by (started_at, id)."""
        order = ["started_at", ID_FIELD[name]] if name != "models" else [ID_FIELD[name]]
        return self.table(name).orderBy(*order)


def export_json(registry: "Registry", name: str, path: str) -> str:
    """A registry table as JSON lines (create-only)."""
    registry.table(name).write.mode("errorifexists").json(path)
    return path


def record_sha256(record: dict) -> str:
    """Digest of a stored record (sorted-key JSON)."""
    import hashlib

    return hashlib.sha256(json.dumps(record, sort_keys=True, default=str).encode()).hexdigest()
