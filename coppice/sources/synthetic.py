"""Tables of the Friedman function, as expressions over a range."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import wang


def _uniform(column: int, seed: int):
    mixed = F.col("rid").bitwiseXOR(F.lit((seed * 2654435761 + column * 40503) & 0xFFFFFFFF)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.shiftrightunsigned(wang(wang(mixed)), 8) + 0.5) / float(1 << 24)


def friedman(spark: SparkSession, rows: int, columns: int = 10, noise: float = 1.0, seed: int = 1) -> DataFrame:
    """rid, f0 ..., label = 10 sin(pi f0 f1) + 20 (f2 - 1/2)^2 + 10 f3 + 5 f4 + noise;
    the same for any partitioning."""
    df = spark.range(rows).withColumnRenamed("id", "rid")
    df = df.select("rid", *[_uniform(i, seed).alias(f"f{i}") for i in range(max(columns, 5))])
    normal = F.sqrt(-2 * F.log(_uniform(1001, seed))) * F.cos(2 * math.pi * _uniform(1002, seed))
    x = [F.col(f"f{i}") for i in range(5)]
    return df.withColumn("label", 10 * F.sin(math.pi * x[0] * x[1]) + 20 * (x[2] - 0.5) ** 2 + 10 * x[3] + 5 * x[4] + noise * normal)


def mixed(spark: SparkSession, rows: int, columns: int = 8, categories: int = 5, missing: float = 0.1, seed: int = 1) -> DataFrame:
    """Friedman rows with a categorical ``cat`` that adds to the label, and with
    missing values put into f0 after the label was made."""
    df = friedman(spark, rows, columns, 1.0, seed).withColumn("cat", F.floor(_uniform(2001, seed) * categories).cast("double"))
    df = df.withColumn("label", F.col("label") + F.when(F.col("cat") == 2, 3.0).otherwise(0.0))
    return df.withColumn("f0", F.when(_uniform(2002, seed) >= missing, F.col("f0")))
