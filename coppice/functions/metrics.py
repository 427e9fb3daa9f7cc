"""Metrics of raw scores as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .objectives import sigmoid, softmax

TINY = 1e-12


def loss(metric: str, score: Column, label: Column, alpha: float = 0.9, rho: float = 1.5, log_link: bool = False) -> Column:
    """The loss of one row; the metric is its mean (rmse: the root of it).

    rmse and mae compare the mean that a log link gives, not the raw score."""
    f = F.exp(score) if log_link else score
    if metric == "rmse":
        return (f - label) * (f - label)
    if metric == "mae":
        return F.abs(f - label)
    if metric == "pinball":
        d = label - score
        return F.when(d >= 0, alpha * d).otherwise((alpha - 1.0) * d)
    if metric == "logloss":
        p = F.greatest(F.lit(TINY), F.least(F.lit(1.0 - TINY), sigmoid(score)))
        return -F.when(label > 0.5, F.log(p)).otherwise(F.log(1.0 - p))
    mu = F.exp(score)
    if metric == "poisson":
        return 2.0 * (F.when(label > 0, label * F.log(label / mu)).otherwise(0.0) - (label - mu))
    if metric == "tweedie":
        return 2.0 * (F.pow(label, 2.0 - rho) / ((1.0 - rho) * (2.0 - rho)) - label * F.pow(mu, 1.0 - rho) / (1.0 - rho) + F.pow(mu, 2.0 - rho) / (2.0 - rho))
    raise ValueError(metric)


def auc(df: DataFrame) -> DataFrame:
    """Area under the curve of (score, label), as ``value``: rank sum with average
    ranks for ties, 0.5 if a class is empty. Scores are pre-aggregated; the ranks
    come from counts per distinct score, cumulated range by range."""
    counts = df.groupBy("score").agg(F.sum((F.col("label") > 0.5).cast("long")).alias("pos"), F.count("*").alias("n"))
    parts = counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()).persist()
    sums = parts.groupBy("part").agg(F.sum("n").alias("m"))
    before = sums.withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = parts.withColumn("below", below).join(F.broadcast(before), "part")
    total = ranked.agg(F.sum(F.col("pos") * (F.col("before") + F.col("below") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return total.select(F.when((p > 0) & (q > 0), (F.col("ranks") - p * (p + 1) / 2.0) / (p * q)).otherwise(0.5).alias("value"))


def evaluate(df: DataFrame, metric: str, alpha: float = 0.9, rho: float = 1.5, log_link: bool = False) -> DataFrame:
    """One row, ``value``, from (score, label); for multi_logloss score is an array."""
    if metric == "auc":
        return auc(df)
    score, label = F.col("score"), F.col("label")
    if metric == "multi_logloss":
        p = F.element_at(softmax(score), label.cast("int") + 1)
        return df.agg(F.avg(-F.log(F.greatest(p, F.lit(TINY)))).alias("value"))
    mean = F.avg(loss(metric, score, label, alpha, rho, log_link))
    return df.agg((F.sqrt(mean) if metric == "rmse" else mean).alias("value"))


def higher_is_better(metric: str) -> bool:
    return metric == "auc"
