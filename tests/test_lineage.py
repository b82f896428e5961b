"""Stored models: changed files, contracts and broken links are refused."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.config import ArtifactError, FoldConfig
from tessera.operators import estimators as E
from tessera.plans import artifacts as A
from tessera.plans import crossval as CV
from tessera.plans import final as G
from tessera.plans.registry import Registry


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """(folder of a registry with one selected, refitted model, its id)."""
    root = str(tmp_path_factory.mktemp("lineage") / "registry")
    rows = spark.range(90).select("id", (F.col("id") % 5).cast("double").alias("x"),
                                  F.when(F.col("id") % 5 < 2, "a").otherwise("b").alias("y"))
    reg = Registry(spark, root)
    cfg = CV.CrossValidationConfig(estimators=(E.DUMMY_CLASSIFIER, E.LOGISTIC_REGRESSION), folds=FoldConfig(2, 7))
    cv = CV.cross_validate(rows, cfg, target="y", key=["id"], registry=reg)
    final = G.fit_selected_model(rows, cv.record, target="y", key=["id"], registry=reg)
    return root, final.record


def test_whole_lineage_holds(spark, stored):
    root, record = stored
    reg = Registry(spark, root)
    assert A.load(reg, record["final_model_id"]).feature_names == ["id", "x"]
    assert A.lineage_violations(spark, reg).collect() == []
    meta = A.inspect(reg, record["final_model_id"])
    assert record["model_sha256"] == meta["files_sha256"] and len(meta["files"]) > 5


def _moved(meta, root, copy):
    return dict(meta, model_path=meta["model_path"].replace(root, copy))


def test_one_changed_byte_a_lost_and_an_added_file_are_named(spark, stored, scratch):
    root, record = stored
    meta = A.inspect(Registry(spark, root), record["final_model_id"])
    assert A.file_changes(spark, meta) == []
    data = [f["file"] for f in meta["files"] if f["file"].endswith(".parquet")][0]

    def change(path):
        folder, name = os.path.split(path)
        os.remove(f"{folder}/.{name}.crc")  # the local store would notice by itself
        with open(path, "r+b") as f:
            f.write(b"X")

    for reason, spoil in (("changed", change), ("missing", os.remove),
                          ("added", lambda p: shutil.copy(p, p + "2"))):
        copy = os.path.join(scratch, reason)
        shutil.copytree(root, copy)
        spoil(os.path.join(_moved(meta, root, copy)["model_path"], data))
        name = data + "2" if reason == "added" else data
        assert any(name in p and reason in p for p in A.file_changes(spark, _moved(meta, root, copy)))
    forged = dict(meta, files=[dict(f, sha256="0") for f in meta["files"]])
    assert A.file_changes(spark, forged) == ["no valid file digests are recorded"]


def _with(spark, root, copy, table, change):
    """A copy of the registry whose records of one table are changed."""
    shutil.copytree(root, copy)
    reg = Registry(spark, copy)
    changed = [change(r.asDict(recursive=True)) for r in reg.table(table).collect()]
    shutil.move(f"{copy}/{table}", f"{copy}-{table}-before")
    for record in changed:
        if record is not None:
            reg.write(table, record)
    return reg


def test_broken_links_are_found(spark, stored, scratch):
    root, record = stored
    cases = {
        "no successful final model": ("final_models", lambda r: dict(r, status="failed")),
        "other model files": ("models", lambda r: dict(r, files_sha256="0")),
        "no selection record": ("cv_benchmarks", lambda r: None),
        "changed selection record": ("cv_benchmarks", lambda r: dict(r, random_seed=1)),
    }
    for i, (problem, (table, change)) in enumerate(cases.items()):
        reg = _with(spark, root, os.path.join(scratch, str(i)), table, change)
        got = A.lineage_violations(spark, reg).collect()
        assert [(r["lineage_id"], r["problem"]) for r in got] == [(record["final_model_id"], problem)]
    other = _with(spark, root, os.path.join(scratch, "t"), "models", lambda r: dict(r, target="z"))
    with pytest.raises(ArtifactError, match="contract"):
        A.load(other, record["final_model_id"])
