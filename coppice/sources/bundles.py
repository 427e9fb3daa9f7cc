"""Binned data sets on disk: rows, edges and meta data."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..params import DataError, Params
from ..plans.train import Binned

VERSION = 1


def save(data: Binned, path: str) -> None:
    spark = data.rows.sparkSession
    data.rows.write.mode("overwrite").parquet(f"{path}/rows")
    meta = {"version": VERSION, "edges": data.edges, "features": data.features, "params": data.params.as_dict(), "n": data.n}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Binned:
    """Raises DataError if the folder is no bundle of this version."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    except Exception as e:
        raise DataError(f"{path} is no binned data set") from e
    if meta.get("version") != VERSION:
        raise DataError(f"{path}: version {meta.get('version')} is not supported")
    params = Params(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["params"].items()})
    rows = spark.read.parquet(f"{path}/rows")
    if rows.count() != meta["n"]:
        raise DataError(f"{path}: rows are missing")
    return Binned(rows, meta["edges"], meta["features"], params, meta["n"])
