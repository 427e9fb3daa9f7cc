"""Checks of a training table in one aggregate pass, and warnings."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from ..params import DataError, Params


def label_rules(params: Params) -> dict[str, Column]:
    """What each rule calls a bad row of (rid, label, weight), by message."""
    y, w = F.col("label"), F.col("weight")
    infinite = y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    rules = {"label is not a finite number": infinite, "weight is not a finite number of 0 or more": w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))}
    if params.objective == "binary":
        rules["label is neither 0 nor 1"] = ~infinite & ~y.isin(0.0, 1.0)
    if params.objective in ("poisson", "tweedie"):
        rules["label is negative under a log link"] = ~infinite & (y < 0)
    if params.objective == "multiclass":
        rules["label is no class id"] = ~infinite & ((y != F.rint(y)) | (y < 0) | (y >= params.num_class))
    return rules


def category_rules(features: list[str], params: Params) -> dict[str, Column]:
    out = {}
    for c in params.categorical_features:
        v = F.col(f"`{c}`").cast("double")
        known = v.isNotNull() & ~F.isnan(v)
        out[f"category of {c} is not an id from 0 to {params.bins - 1}"] = known & ((F.rint(v) != v) | (v < 0) | (v > params.bins - 1))
    return out


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n, first_row): bad rows of each rule that has any, in one pass."""
    names = list(rules)
    flat = df.agg(*[x for i, r in enumerate(names) for x in (F.count_if(F.coalesce(rules[r], F.lit(False))).alias(f"n{i}"), F.min(F.when(rules[r], F.col("rid"))).alias(f"r{i}"))])
    packed = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("first_row")) for i, r in enumerate(names)])
    return flat.select(F.explode(packed).alias("x")).select("x.*").where("n > 0")


def check_rows(df: DataFrame, features: list[str], params: Params) -> None:
    if not features:
        raise DataError("no features")
    if missing := [c for c in params.categorical_features if c not in features]:
        raise DataError(f"categorical features {missing} are not among the features")
    if params.monotone_constraints and len(params.monotone_constraints) != len(features):
        raise DataError("there must be one monotone constraint for each feature")
    if params.allowed_features is not None and (not params.allowed_features or set(params.allowed_features) - set(features)):
        raise DataError("allowed_features must name some of the features")
    for r in violations(df, label_rules(params) | category_rules(features, params)).collect():
        raise DataError(f"{r.rule}: {r.n} rows, the first is {r.first_row}")


def leakage(df: DataFrame, features: list[str], rows: int) -> DataFrame:
    """(f, r): correlation of each feature with the label on every (rows / 4096)-th
    row. The label's mean is over all of these, a feature's over its finite ones."""
    step = max(1, rows // 4096)
    packed = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(features)])
    sample = df.where(F.col("rid") % step == 0).select(F.col("label").cast("double").alias("y"), F.explode(packed).alias("p")).select("y", "p.f", "p.x")
    fine = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    mean = sample.groupBy("f").agg(F.avg("y").alias("ym"), F.avg(F.when(fine, F.col("x"))).alias("xm"), F.count_if(fine).alias("n"))
    d = sample.where(fine).join(F.broadcast(mean.where("n >= 50")), "f").select("f", (F.col("x") - F.col("xm")).alias("dx"), (F.col("y") - F.col("ym")).alias("dy"))
    sums = d.groupBy("f").agg(F.sum(F.col("dx") * F.col("dy")).alias("xy"), F.sum(F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("dy") * F.col("dy")).alias("yy"))
    return sums.where("xx > 0 and yy > 0").select("f", (F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("r"))


def warn(df: DataFrame, features: list[str], params: Params, rows: int) -> list[str]:
    """Warnings about leaking features and about too many bins for the rows."""
    out = [f"feature {features[r.f]} correlates with the label at |r| = {abs(r.r):.4f}; does it hold the label?" for r in leakage(df, features, rows).where(F.abs("r") > 0.999).collect()]
    if params.max_bin > 64 and rows / params.max_bin < 64:
        out.append(f"{rows} rows are few for {params.max_bin} bins; fewer bins train faster and about as well")
    for w in out:
        warnings.warn(w, UserWarning, stacklevel=3)
    return out
