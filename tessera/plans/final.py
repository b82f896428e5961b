"""All-row refit of a cross-validation winner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SelectionError, Task
from ..functions.columns import compact_message
from ..functions.digest import table_fingerprint
from ..operators import estimators as E
from ..operators import features as FE
from ..operators import profile as P
from . import artifacts as A
from .crossval import configuration_from
from .registry import SCHEMA_VERSION, Registry, new_id, now, record_sha256
from .train import expected_failure, keyed_table, merge_warnings


@dataclass
class FinalModelResult:
    record: dict
    model: E.FittedModel
    stats: FE.FeatureStats


def dataset_identity(df: DataFrame, target: str) -> dict:
    """The identity fields a selection records about its dataset."""
    return {
        "fingerprint": table_fingerprint(df),
        "row_count": df.count(),
        "column_count": len(df.columns),
        "target": target,
    }


def mismatched_fields(df: DataFrame, target: str, expected: dict) -> list[str]:
    """Names of the identity fields that differ from ``expected``."""
    current = dataset_identity(df, target)
    return [k for k, v in current.items() if expected.get(k) != v]


def identity_mismatches(df: DataFrame, target: str, expected: dict) -> list[str]:
    """G2 as messages: ``field: expected ..., found ...``."""
    current = dataset_identity(df, target)
    return [f"{k}: expected {expected.get(k)!r}, found {v!r}" for k, v in current.items()
            if expected.get(k) != v]


def fit_selected_model(
    df: DataFrame,
    selection: dict,
    *,
    target: str,
    key: list[str] | None = None,
    registry: Registry | None = None,
    save_model: bool = True,
) -> FinalModelResult:
    """G1: verify selection and data, then fit the winner on every row with
    the preprocessing and feature roles it was selected with."""
    # The selection record must be unchanged in the registry and have a winner.
    if registry is not None:
        stored = registry.read("cv_benchmarks", selection["benchmark_id"])
        if record_sha256(stored) != record_sha256(selection):
            raise SelectionError("The selection record differs from the stored cross-validation record.")
    winner = next((e for e in selection["entries"] if e["rank"] == 1), None)
    if winner is None or selection["status"] == "failed":
        raise SelectionError("The cross-validation record has no winning estimator.")
    # The estimator configured today must equal the one that was evaluated.
    seed = selection.get("random_seed")
    seed = 42 if seed is None else seed
    if not selection.get("configuration"):
        raise SelectionError("The cross-validation record holds no configuration to refit with.")
    cfg, overrides, forest = configuration_from(selection["configuration"])
    if winner.get("parameters") and list(winner["parameters"]) != E.static_parameters(
            winner["estimator"], seed, forest):
        raise SelectionError("Estimator parameters changed since the cross-validation record was written.")
    # G2
    problems = identity_mismatches(df, target, selection["dataset"])
    if problems:
        raise SelectionError("Dataset does not match the selection: " + "; ".join(problems) + ".")
    final_id, started = new_id(), now()
    selection_block = {
        "benchmark_id": selection["benchmark_id"], "record_sha256": record_sha256(selection),
        "estimator": winner["estimator"], "primary_metric": selection["primary_metric"],
        "mean": winner["primary_metric_mean"], "standard_deviation": winner["primary_metric_standard_deviation"],
        "fold_count": len(selection["folds"]), "fold_plan_sha256": selection["fold_plan_sha256"],
        "stored_sha256": None if registry is None else registry.digests("cv_benchmarks").filter(
            F.col("id") == selection["benchmark_id"]).first()["stored_sha256"],
    }
    try:
        profile = P.profile_dataset(df, target)
        keyed, key, features = keyed_table(df, target, key)
        schema = FE.infer_feature_schema(df, features, overrides)
        FE.validate_preprocessing_inputs(df, schema, cfg, part_col=None)  # F12 checks
        stats = FE.fit_feature_stats(df, schema, cfg)
        fitted = E.fit_estimator(keyed, stats, target=target, estimator=winner["estimator"],
                                 task=Task.CLASSIFICATION, seed=seed, key=key, forest_config=forest)
    except Exception as error:  # G6
        if not expected_failure(error):
            raise
        record = {
            "schema_version": SCHEMA_VERSION, "final_model_id": final_id, "status": "failed",
            "started_at": started, "completed_at": now(), "selection": selection_block,
            "dataset": selection["dataset"], "configuration": selection["configuration"],
            "fit_scope": "all_rows", "training_rows": None,
            "feature_count": None, "model_path": None, "model_sha256": None, "warnings": [],
            "failure": {"error_type": type(error).__name__, "message": compact_message(error)},
        }
        if registry is not None:
            registry.write("final_models", record)
        raise
    record = {
        "schema_version": SCHEMA_VERSION, "final_model_id": final_id, "status": "succeeded",
        "started_at": started, "completed_at": now(), "selection": selection_block,
        "dataset": selection["dataset"], "configuration": selection["configuration"],
        "fit_scope": "all_rows", "training_rows": stats.training_rows,
        "feature_count": len(schema.all_features), "model_path": None, "model_sha256": None,
        "warnings": merge_warnings(profile.warnings, fitted.warnings),
        "failure": None,
    }
    if registry is not None:
        # The model first, so that the stored record names its files.
        if save_model:
            meta = A.save(registry, fitted, stats, df, task="classification", target=target,
                          lineage_kind="final_model", lineage_id=final_id)
            record |= {"model_path": meta["model_path"], "model_sha256": meta["files_sha256"]}
        registry.write("final_models", record)
    return FinalModelResult(record, fitted, stats)
