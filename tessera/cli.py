"""Command line: the library's entry points over CSV or Parquet input.

    python -m tessera profile data.csv --target churn
    python -m tessera train data.csv --target churn --estimator logistic-regression --registry runs/
    python -m tessera benchmark data.csv --target churn --cross-validation-folds 3 --registry runs/
    python -m tessera finalize data.csv --target churn --benchmark-id ID --registry runs/
    python -m tessera predict new.csv --registry runs/ --model LINEAGE_ID --output predictions/

Every command builds one Spark session (``--master``, default from the
environment or ``local[*]``) and prints JSON to stdout.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from .config import FoldConfig, SplitConfig, TesseraError
from .operators import estimators as E


def _session(master: str | None):
    from .session import build_session, checkpoint_dir

    spark = build_session(master or os.environ.get("SPARK_MASTER") or "local[*]")
    checkpoint_dir(spark)
    return spark


def _load(spark, path: str, target: str | None, key: list[str] | None, delimiter: str, encoding: str):
    if path.endswith(".parquet"):
        from .sources.csv import load_table

        return load_table(spark, path, target=target, key=key or [])[0]
    from .sources.csv import CsvOptions, load_csv

    return load_csv(spark, path, target=target, key=key, options=CsvOptions(encoding=encoding, delimiter=delimiter))[0]


def _print(obj) -> None:
    print(json.dumps(obj, sort_keys=True, default=str, indent=2))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--master", default=None)
    sub = parser.add_subparsers(dest="command", required=True)

    def data_args(p, target=True):
        p.add_argument("path")
        if target:
            p.add_argument("--target", required=True)
        p.add_argument("--key", nargs="*", default=None, help="unique row key columns (default: content key)")
        p.add_argument("--delimiter", default=",")
        p.add_argument("--encoding", default="utf-8-sig")

    p = sub.add_parser("profile")
    data_args(p)
    p = sub.add_parser("train")
    data_args(p)
    p.add_argument("--estimator", required=True, choices=sorted(E.ESTIMATOR_TASKS))
    p.add_argument("--validation-fraction", type=float, default=0.2)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--registry", default=None)
    p.add_argument("--save-model", action="store_true")
    p = sub.add_parser("benchmark")
    data_args(p)
    p.add_argument("--estimators", nargs="*", default=list(E.DEFAULT_CLASSIFIERS))
    p.add_argument("--metric", default="balanced_accuracy")
    p.add_argument("--cross-validation-folds", type=int, default=None)
    p.add_argument("--validation-fraction", type=float, default=0.2)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--registry", default=None)
    p = sub.add_parser("finalize")
    data_args(p)
    p.add_argument("--benchmark-id", required=True)
    p.add_argument("--registry", required=True)
    p = sub.add_parser("predict")
    data_args(p, target=False)
    p.add_argument("--registry", required=True)
    p.add_argument("--model", required=True, help="run id or final-model id the model was saved under")
    p.add_argument("--output", required=True)

    args = parser.parse_args(argv)
    spark = _session(args.master)
    try:
        from .plans.registry import Registry

        registry = Registry(spark, args.registry) if getattr(args, "registry", None) else None
        if args.command == "predict":
            from .plans import artifacts as A
            from .plans.scoring import number_rows, predict_frame, write_predictions_csv

            df = _load(spark, args.path, None, args.key, args.delimiter, args.encoding)
            artifact = A.load(registry, args.model)
            keyed = df
            if not args.key:
                from .functions.frames import ROW_KEY, with_row_key

                keyed, key = with_row_key(df), [ROW_KEY]
            else:
                key = args.key
            predictions = number_rows(predict_frame(artifact, keyed, key=key), key)
            write_predictions_csv(predictions, args.output)
            _print({"output": args.output, "rows": predictions.count()})
            return 0
        df = _load(spark, args.path, args.target, args.key, args.delimiter, args.encoding)
        if args.command == "profile":
            from .operators.profile import profile_dataset

            print(profile_dataset(df, args.target).to_json())
        elif args.command == "train":
            from .plans import artifacts as A
            from .plans.train import TrainingConfig, train

            task = E.ESTIMATOR_TASKS[args.estimator]
            res = train(df, TrainingConfig(task, args.estimator, SplitConfig(args.validation_fraction, args.seed)),
                        target=args.target, key=args.key, registry=registry, source=args.path)
            if args.save_model and registry is not None:
                A.save(registry, res.model, res.stats, df, task=task.value, target=args.target,
                       lineage_kind="run", lineage_id=res.record["run_id"])
            _print(res.record)
        elif args.command == "benchmark":
            if args.cross_validation_folds:
                from .plans import crossval as CV

                cfg = CV.CrossValidationConfig(tuple(args.estimators), args.metric,
                                               FoldConfig(args.cross_validation_folds, args.seed))
                _print(CV.cross_validate(df, cfg, target=args.target, key=args.key, registry=registry,
                                         source=args.path).record)
            else:
                from .plans import benchmark as B

                cfg = B.BenchmarkConfig(tuple(args.estimators), args.metric,
                                        SplitConfig(args.validation_fraction, args.seed))
                _print(B.benchmark(df, cfg, target=args.target, key=args.key, registry=registry,
                                   source=args.path).record)
        elif args.command == "finalize":
            from .plans import final as G

            selection = registry.read("cv_benchmarks", args.benchmark_id)
            _print(G.fit_selected_model(df, selection, target=args.target, key=args.key, registry=registry).record)
        return 0
    except TesseraError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    finally:
        spark.stop()

