"""Scores of a forest: by an Arrow UDF over the features, or as an expression."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.objectives import link, probability
from ..model import CATEGORICAL, MISSING_LEFT, Forest, Tree
from ..params import DataError
from .binning import number


def check_columns(df: DataFrame, names: list[str]) -> None:
    if missing := [c for c in names if c not in df.columns]:
        raise DataError(f"columns {missing} are missing")


def _matrix(columns) -> np.ndarray:
    return np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])


def raw_scores(forest: Forest, df: DataFrame) -> Column:
    """ARRAY<DOUBLE>, the raw score of each class. The UDF takes only the model's
    features, so that filters and column pruning still reach the scan."""
    check_columns(df, forest.features)

    @pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(forest.raw(_matrix(columns))))

    return score(*[F.col(f"`{c}`").cast("double") for c in forest.features])


def leaf_ids(forest: Forest, df: DataFrame) -> Column:
    """ARRAY<INT>, the leaf that a row reaches in each tree."""
    check_columns(df, forest.features)

    @pandas_udf("array<int>")
    def leaves(*columns: pd.Series) -> pd.Series:
        x = _matrix(columns)
        found = [t.leaves(x, forest.bins) for t in forest.trees]
        return pd.Series(list(np.array(found, np.int32).reshape(len(forest.trees), len(x)).T))

    return leaves(*[F.col(f"`{c}`").cast("double") for c in forest.features])


def predict(forest: Forest, df: DataFrame, raw: bool = False) -> DataFrame:
    """``df`` with ``prediction``: the raw score, the mean of a log link, or for the
    classifiers the most likely label; with ``probability`` for the latter."""
    scored = df.withColumn("_raw", raw_scores(forest, df))
    if raw:
        return scored.withColumn("prediction", F.col("_raw") if forest.classes > 1 else F.col("_raw")[0]).drop("_raw")
    if forest.objective not in ("binary", "multiclass"):
        return scored.withColumn("prediction", link(forest.objective, F.col("_raw")[0])).drop("_raw")
    out = scored.withColumn("probability", probability(forest.objective, F.col("_raw")))
    at = F.array_position("probability", F.array_max("probability"))
    labels = forest.labels or list(range(max(2, forest.classes)))
    return out.withColumn("prediction", F.element_at(F.array(*[F.lit(x) for x in labels]), at.cast("int"))).drop("_raw")


def walk(tree: Tree, values: Column, max_bin: int) -> Column:
    """The leaf that an array of raw values reaches, as an expression."""
    table = [{"f": int(f), "t": float(t), "m": bool(k & MISSING_LEFT), "c": bool(k & CATEGORICAL), "l": tree.left.get(i, [])} for i, (f, t, k) in enumerate(zip(tree.feature, tree.threshold, tree.flags))]
    nodes = F.from_json(F.lit(json.dumps(table)), "array<struct<f:int,t:double,m:boolean,c:boolean,l:array<int>>>")

    def step(n: Column, _: Column) -> Column:
        x = nodes[n]
        v = values[F.greatest(x["f"], F.lit(0))]
        inside = (F.rint(v) >= 0) & (F.rint(v) < max_bin - 1)
        category = F.when(v.isNotNull() & inside, F.rint(v).cast("int")).otherwise(max_bin - 1)
        left = F.when(x["c"], F.array_contains(x["l"], category)).when(v.isNull(), x["m"]).otherwise(v <= x["t"])
        return F.when(x["f"] < 0, n).otherwise(2 * n + F.when(left, 1).otherwise(2))

    return F.aggregate(F.sequence(F.lit(1), F.lit(tree.depth)), F.lit(0), step) if tree.depth else F.lit(0)


def raw_expression(forest: Forest) -> Column:
    """Raw scores as a pure expression, for small forests and for SQL."""
    values = F.array(*[number(F.col(f"`{c}`")) for c in forest.features])
    out = [F.lit(b) for b in forest.base]
    for t, tree in enumerate(forest.trees):
        leaf = F.from_json(F.lit(json.dumps(tree.leaf.tolist())), "array<double>")
        out[t % forest.classes] = out[t % forest.classes] + leaf[walk(tree, values, forest.max_bin)]
    return F.array(*out)
