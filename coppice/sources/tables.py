"""CSV, TSV, LibSVM and columnar tables of features; prediction files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..params import DataError

_NUMBER = r"^[+-]?(?:nan|inf(?:inity)?|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)"


def read_csv(spark: SparkSession, path: str, strings: list[str] = ()) -> DataFrame:
    """A CSV or TSV file with a header (a tab in it makes it TSV), without quoting.
    Values are doubles: the number a field begins with, NULL if none; columns in
    ``strings`` stay text. Blank lines are skipped, further fields dropped; a row
    with too few fields is an error that names it."""
    lines = spark.read.text(path)
    head = lines.where(F.trim("value") != "").limit(1).collect()
    if not head:
        raise DataError(f"{path} has no header")
    header = head[0].value
    sep = "\t" if "\t" in header else ","
    names = [c.strip() for c in header.split(sep)]
    body = lines.where((F.trim("value") != "") & (F.col("value") != header)).withColumn("x", F.split("value", sep))
    if bad := body.where(F.size("x") < len(names)).limit(1).collect():
        raise DataError(f"{path}: the row {bad[0].value!r} has {len(bad[0].x)} of {len(names)} fields")

    def value(i: int, name: str):
        text = F.trim(F.col("x")[i])
        if name in strings:
            return text.alias(name)
        found = F.regexp_extract(F.lower(text), _NUMBER, 0).try_cast("double")
        return F.when(F.isnan(found), None).otherwise(found).alias(name)

    return body.select(*[value(i, c) for i, c in enumerate(names)])


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """label, f0, f1, ... of a LibSVM file: absent values are 0; indices count from 0
    or 1, whichever the lowest says; qid tokens and comments are passed over."""
    lines = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("line")).where("line <> ''")
    tokens = lines.select(F.split("line", r"\s+").alias("t"))
    pairs = F.filter(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda x: x.rlike(r"^\d+:"))
    parsed = tokens.select(F.col("t")[0].try_cast("double").alias("label"), F.transform(pairs, lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("i"), F.split(x, ":")[1].try_cast("double").alias("v"))).alias("p"))
    low, high = parsed.agg(F.min(F.array_min(F.transform("p", lambda x: x["i"]))), F.max(F.array_max(F.transform("p", lambda x: x["i"])))).first()
    if low is None:
        raise DataError(f"{path} has no features")
    base = 0 if low == 0 else 1
    m = parsed.select("label", F.map_from_entries("p").alias("m"))
    return m.select("label", *[F.coalesce(F.col("m")[i + base], F.lit(0.0)).alias(f"f{i}") for i in range(high - base + 1)])


def read_table(spark: SparkSession, path: str, kind: str = "auto", strings: list[str] = ()) -> DataFrame:
    """By format: auto (from the extension), csv, tsv, libsvm, parquet, orc, json."""
    if kind == "auto":
        end = os.path.splitext(path.rstrip("/"))[1].lower()
        kind = {".svm": "libsvm", ".libsvm": "libsvm", ".parquet": "parquet", ".orc": "orc", ".json": "json"}.get(end, "csv")
    if kind == "libsvm":
        return read_libsvm(spark, path)
    if kind in ("parquet", "orc", "json"):
        return spark.read.format(kind).load(path)
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, strings)
    raise DataError(f"unknown format {kind!r}")


def from_arrays(spark: SparkSession, x, y=None, names: list[str] | None = None) -> DataFrame:
    """A table from a two-dimensional array and labels."""
    import numpy as np
    import pandas as pd

    x = np.asarray(x, float)
    out = pd.DataFrame(x, columns=names or [f"f{i}" for i in range(x.shape[1])])
    if y is not None:
        out["label"] = y
    out["rid"] = np.arange(len(out))
    return spark.createDataFrame(out)


def write_predictions(df: DataFrame, path: str, classes: int = 1, column: str = "prediction") -> None:
    """CSV with a header: ``prediction``, or ``class_0`` ... of an array."""
    if classes > 1:
        df = df.select(*[F.col(column)[i].alias(f"class_{i}") for i in range(classes)])
    else:
        df = df.select(F.col(column).alias("prediction"))
    df.write.mode("overwrite").option("header", True).csv(path)
