"""Model persistence (A1-A4): Spark ML writer + a metadata row in ``models``.

The fitted ``PipelineModel`` is saved with Spark's own (create-only)
writer; the feature contract lives in the ``models`` registry table so it
can be inspected without loading the model.  The table also holds a digest of
every model file, which ``load`` takes anew: a file that was changed, lost or
added since is refused by name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ArtifactError
from ..operators.estimators import FittedModel
from ..operators.features import FeatureStats
from .registry import SCHEMA_VERSION, Registry, new_id, record_sha256


@dataclass
class Artifact:
    metadata: dict
    model: PipelineModel

    @property
    def feature_names(self) -> list[str]:
        return [f["name"] for f in self.metadata["features"]]


def feature_contract(df: DataFrame, stats: FeatureStats) -> list[dict]:
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = set(stats.schema.numeric)
    return [{"name": n, "dtype": fields[n], "role": "numeric" if n in numeric else "categorical"}
            for n in stats.schema.all_features]


def model_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes, sha256)`` of every file below ``path``, read and hashed
    on the executors."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = store.makeQualified(hadoop).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.expr(f"substring(path, {len(root) + 2})").alias("file"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def _listed(files: DataFrame) -> list[dict]:
    return sorted((r.asDict() for r in files.collect()), key=lambda f: f["file"])


def files_sha256(files: list[dict]) -> str:
    text = "".join(f"{f['file']}:{f['bytes']}:{f['sha256']}\n" for f in files)
    return hashlib.sha256(text.encode()).hexdigest()


def contract_sha256(meta: dict) -> str:
    """Digest of what a model expects and predicts."""
    return record_sha256({k: meta[k] for k in ("task", "target", "categorical_fill_value", "features")})


def save(registry: Registry, fitted: FittedModel, stats: FeatureStats, df: DataFrame, *, task: str,
         target: str, lineage_kind: str, lineage_id: str) -> dict:
    """A1: contract checked first, then create-only model write + metadata row."""
    contract = feature_contract(df, stats)
    if [c["name"] for c in contract] != list(stats.schema.all_features):
        raise ArtifactError("Model feature contract does not match the fitted features.")
    model_id = new_id()
    path = f"{registry.root}/model_files/{lineage_kind}/{lineage_id}"
    fitted.model.write().save(path)  # fails if the path exists
    meta = {
        "schema_version": SCHEMA_VERSION, "model_id": model_id, "lineage_kind": lineage_kind,
        "lineage_id": lineage_id, "task": task, "target": target,
        "categorical_fill_value": stats.config.categorical_fill_value, "features": contract,
        "model_path": path, "files": _listed(model_files(registry.spark, path)),
    }
    meta |= {"files_sha256": files_sha256(meta["files"]), "contract_sha256": contract_sha256(meta)}
    registry.write("models", meta)
    return meta


def inspect(registry: Registry, lineage_id: str) -> dict:
    """A2: metadata only, no model load."""
    rows = registry.table("models").filter(F.col("lineage_id") == lineage_id).collect()
    if len(rows) != 1:
        raise ArtifactError(f"No unique model for {lineage_id!r}.")
    return rows[0].asDict(recursive=True)


def load(registry: Registry, lineage_id: str) -> Artifact:
    """A3: the model, after its files and its contract were found to be those
    that were saved."""
    meta = inspect(registry, lineage_id)
    problems = file_changes(registry.spark, meta)
    if problems:
        raise ArtifactError(f"Model files of {lineage_id!r} are not those that were saved: " + "; ".join(problems) + ".")
    if meta["contract_sha256"] != contract_sha256(meta):
        raise ArtifactError(f"The feature contract of {lineage_id!r} changed since it was saved.")
    model = PipelineModel.load(meta["model_path"])
    if not any(s.__class__.__name__ == "VectorAssembler" for s in model.stages):
        raise ArtifactError("Saved model has no feature assembler.")
    return Artifact(meta, model)


def file_changes(spark: SparkSession, meta: dict) -> list[str]:
    """Differences between a model's recorded files and those in its folder."""
    if not meta["files"] or meta["files_sha256"] != files_sha256(meta["files"]):
        return ["no valid file digests are recorded"]
    known = {f["file"]: f for f in meta["files"]}
    found = {f["file"]: f for f in _listed(model_files(spark, meta["model_path"]))}
    return ([f"{n} is missing" for n in sorted(known.keys() - found.keys())]
            + [f"{n} was added" for n in sorted(found.keys() - known.keys())]
            + [f"{n} was changed" for n in sorted(known.keys() & found.keys()) if known[n] != found[n]])


def lineage_violations(spark: SparkSession, registry: Registry) -> DataFrame:
    """A4: ``(model_id, lineage_id, problem)`` for every broken link from a
    model to its run, or to its final model and on to the cross-validation
    that selected it: records that are missing, failed or changed since, other
    model files, another winner."""
    models = registry.table("models").select("model_id", "lineage_kind", "lineage_id", "files_sha256")
    runs = registry.table("runs").filter(F.col("status") == "succeeded").select(F.col("run_id").alias("lineage_id"))
    finals = registry.table("final_models").filter(F.col("status") == "succeeded").select(
        F.col("final_model_id").alias("lineage_id"), "model_sha256", "selection")
    won = registry.table("cv_benchmarks").select(
        F.col("benchmark_id").alias("id"),
        F.filter("entries", lambda e: e["rank"] == 1)[0]["estimator"].alias("winner"))
    selections = won.join(registry.digests("cv_benchmarks"), "id")
    of_runs = (models.filter("lineage_kind = 'run'").join(runs.withColumn("held", F.lit(True)), "lineage_id", "left")
               .withColumn("problem", F.when(F.col("held").isNull(), "no successful run")))
    of_finals = (
        models.filter("lineage_kind <> 'run'").join(finals, "lineage_id", "left")
        .join(selections, F.col("selection.benchmark_id") == F.col("id"), "left")
        .withColumn("problem", F.when(F.col("selection").isNull(), "no successful final model")
                    .when(~F.col("model_sha256").eqNullSafe(F.col("files_sha256")), "other model files")
                    .when(F.col("id").isNull(), "no selection record")
                    .when(F.col("selection.stored_sha256") != F.col("stored_sha256"), "changed selection record")
                    .when(~F.col("winner").eqNullSafe(F.col("selection.estimator")), "another estimator won")))
    held = ["model_id", "lineage_id", "problem"]
    return of_runs.select(*held).unionByName(of_finals.select(*held)).filter(F.col("problem").isNotNull())
