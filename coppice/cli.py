"""Command line: train, predict, dataset, importance, version, help."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from . import __version__
from .model import Forest
from .operators.predict import check_columns, predict
from .operators.selection import chosen, select_features
from .params import CoppiceError, DataError, Params
from .plans.train import bin_dataset, binned_scores, fit, prepare, train
from .operators.binning import assign_bins
from .sources import bundles
from .sources.tables import read_table, write_predictions
from .store import store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="coppice")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("train", "dataset"):
        p = sub.add_parser(name)
        add = p.add_argument
        add("--data", required=True)
        add("--label", default="label")
        add("--valid")
        add("--output", default="model.json" if name == "train" else "dataset")
        add("--objective", default="regression")
        add("--num-classes", type=int, default=1)
        add("--alpha", type=float, default=0.9)
        add("--tweedie-power", type=float, default=1.5)
        add("--scale-pos-weight", type=float, default=1.0)
        add("--subsample", type=float, default=1.0)
        add("--feature-fraction", type=float, default=1.0)
        add("--monotone")
        add("--metric")
        add("--weight-column")
        add("--init-model")
        add("--trees", type=int, default=100)
        add("--depth", type=int)
        add("--leaves", type=int)
        add("--learning-rate", type=float, default=0.1)
        add("--lambda", dest="reg_lambda", type=float, default=1.0)
        add("--min-child-weight", type=float, default=1.0)
        add("--min-split-gain", type=float, default=0.0)
        add("--bins", type=int, default=256)
        add("--categorical", default="")
        add("--goss", action="store_true")
        add("--goss-top-rate", type=float, default=0.2)
        add("--goss-other-rate", type=float, default=0.1)
        add("--feature-selection", action="store_true")
        add("--selection-rounds", type=int, default=20)
        add("--selection-trees", type=int)
        add("--early-stopping", type=int, default=0)
        add("--format", default="auto")
        add("--save-dataset")
    p = sub.add_parser("predict")
    p.add_argument("--model", required=True)
    p.add_argument("--data", required=True)
    p.add_argument("--output", default="predictions.csv")
    p.add_argument("--format", default="auto")
    p.add_argument("--raw", action="store_true")
    p = sub.add_parser("importance")
    p.add_argument("--model", required=True)
    sub.add_parser("version")
    sub.add_parser("help")
    return top


def params_of(a: argparse.Namespace) -> Params:
    return Params.make(
        n_estimators=a.trees, max_depth=a.depth or (12 if a.leaves else 6), num_leaves=a.leaves, learning_rate=a.learning_rate, reg_lambda=a.reg_lambda, min_child_weight=a.min_child_weight,
        min_split_gain=a.min_split_gain, max_bin=a.bins, categorical_features=[c for c in a.categorical.split(",") if c], early_stopping_rounds=a.early_stopping, goss=a.goss,
        goss_top_rate=a.goss_top_rate, goss_other_rate=a.goss_other_rate, objective=a.objective, num_class=a.num_classes, alpha=a.alpha, tweedie_variance_power=a.tweedie_power,
        scale_pos_weight=a.scale_pos_weight, subsample=a.subsample, colsample_bytree=a.feature_fraction, monotone_constraints=[int(x) for x in a.monotone.split(",")] if a.monotone else [],
        metric=a.metric, selection_rounds=a.selection_rounds, selection_estimators=a.selection_trees,
    )


def importance_table(forest: Forest) -> str:
    """Features by gain, the highest first."""
    gain, split = forest.importance("gain"), forest.importance("split")
    rows = sorted(zip(forest.features, gain, split), key=lambda r: -r[1])
    return "\n".join(f"{c:<24} {g:>16.4f} {int(s):>8}" for c, g, s in rows)


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "help":
        parser().print_help()
        return 0
    if a.command == "importance":
        print(importance_table(Forest.load(a.model)))
        return 0
    spark = spark or SparkSession.builder.appName("coppice").getOrCreate()
    try:
        if a.command == "predict":
            forest = Forest.load(a.model)
            df = read_table(spark, a.data, a.format)
            check_columns(df, forest.features)
            out = predict(forest, df, raw=a.raw)
            if a.raw or forest.objective not in ("binary", "multiclass"):
                write_predictions(out, a.output, forest.classes)
            elif forest.objective == "binary":
                write_predictions(out.select(F.col("probability")[1].alias("prediction")), a.output)
            else:
                write_predictions(out, a.output, forest.classes, "probability")
            return 0
        params = params_of(a)
        valid = read_table(spark, a.valid, a.format) if a.valid else None
        init = Forest.load(a.init_model) if a.init_model else None
        try:
            data, df = bundles.load(spark, a.data), None
        except DataError:
            df = read_table(spark, a.data, a.format)
            check_columns(df, [a.label])
            names = [c for c in df.columns if c not in (a.label, a.weight_column)]
            data = bin_dataset(df, names, a.label, params, a.weight_column)
        if a.command == "dataset":
            bundles.save(data, a.output)
            return 0
        if a.save_dataset:
            bundles.save(data, a.save_dataset)
        if a.feature_selection:
            params = params.but(allowed_features=tuple(chosen(select_features(data, params))))
        if init is not None and df is not None:
            forest, _ = train(df, data.features, a.label, params, a.weight_column, valid=valid, init=init)
        else:
            own = params.but(max_bin=data.params.max_bin, categorical_features=data.params.categorical_features)
            checked = start = valid_start = None
            if init is not None:
                start = store(binned_scores(init, data, data.rows), "start")
            if valid is not None:
                rows, _ = prepare(valid, data.features, a.label, None, own, None)
                checked = assign_bins(rows, data.features, data.edges, own, ["rid", "label", "weight"]).persist()
                if init is not None:
                    valid_start = store(binned_scores(init, data, checked), "start")
            forest, _ = fit(data, own, checked, init, start, valid_start)
            if checked is not None:
                checked.unpersist()
        forest.save(a.output)
        return 0
    except CoppiceError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
