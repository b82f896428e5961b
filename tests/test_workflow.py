"""End-to-end: CSV -> 3-fold cross-validation -> all-row refit -> CSV scoring."""

import os

import pytest

from tessera.config import FoldConfig
from tessera.plans import artifacts as A
from tessera.plans import crossval as CV
from tessera.plans import final as G
from tessera.plans.registry import Registry
from tessera.plans.scoring import predict_csv
from tessera.sources.csv import load_csv

OFFERS = "floor_area,rent,room\n22,210.0,loft\n70,661.5,attic\n"
ROOMS = ("loft", "cellar", "studio")


def rental_csv(n: int) -> str:
    """Rentals with a gap in ``rent`` every seventh row; large rooms are let."""
    lines = ["floor_area,rent,room,let"]
    for i in range(n):
        area = 18 + 7 * i % 61
        rent = "" if i % 7 == 3 else f"{9.5 * area + i % 4:.2f}"
        lines.append(f"{area},{rent},{ROOMS[i % 3]},{'open' if area < 48 else 'let'}")
    return "\n".join(lines) + "\n"


def test_rental_workflow(spark, scratch):
    data = os.path.join(scratch, "rentals.csv")
    scoring = os.path.join(scratch, "offers.csv")
    with open(data, "w") as f:
        f.write(rental_csv(24))
    with open(scoring, "w") as f:
        f.write(OFFERS)
    df, spec = load_csv(spark, data, target="let")
    assert dict(df.dtypes) == {"floor_area": "int", "rent": "double", "room": "string", "let": "string"}
    reg = Registry(spark, os.path.join(scratch, "registry"))
    cv = CV.cross_validate(df, CV.CrossValidationConfig(folds=FoldConfig(3, 42)), target="let", registry=reg)
    entries = {e["estimator"]: e for e in cv.record["entries"]}
    # The prior dummy predicts the majority class everywhere: balanced accuracy 0.5 +/- 0.
    assert entries["dummy-classifier"]["primary_metric_mean"] == 0.5
    assert entries["dummy-classifier"]["primary_metric_standard_deviation"] == 0.0
    assert sorted(e["rank"] for e in entries.values()) == [1, 2, 3]
    assert sum(f["validation_rows"] for f in cv.record["folds"]) == 24
    stored = reg.read("cv_benchmarks", cv.record["benchmark_id"])
    final = G.fit_selected_model(df, stored, target="let", registry=reg)
    assert final.record["training_rows"] == 24
    artifact = A.load(reg, final.record["final_model_id"])
    preds = predict_csv(spark, artifact, scoring).collect()
    assert len(preds) == 2 and {p["prediction"] for p in preds} <= {"open", "let"}
    with pytest.raises(Exception):
        G.fit_selected_model(df.limit(23), stored, target="let", registry=reg)
