import json
import os
import subprocess
import sys

from test_workflow import OFFERS, rental_csv

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(*args):
    out = subprocess.run([sys.executable, "-m", "tessera", "--master", "local[4]", *args], cwd=REPO,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_cli_profile_benchmark_finalize_predict(scratch):
    data, scoring = os.path.join(scratch, "rentals.csv"), os.path.join(scratch, "new.csv")
    with open(data, "w") as f:
        f.write(rental_csv(24))
    with open(scoring, "w") as f:
        f.write(OFFERS)
    reg = os.path.join(scratch, "registry")
    profile = json.loads(run("profile", data, "--target", "let"))
    assert profile["target"]["task_hint"] == "classification"
    cv = json.loads(run("benchmark", data, "--target", "let", "--cross-validation-folds", "2",
                        "--estimators", "dummy-classifier", "logistic-regression", "--registry", reg))
    final = json.loads(run("finalize", data, "--target", "let", "--benchmark-id", cv["benchmark_id"],
                           "--registry", reg))
    out = json.loads(run("predict", scoring, "--registry", reg, "--model", final["final_model_id"],
                         "--output", os.path.join(scratch, "pred")))
    assert out["rows"] == 2
