"""Row and column sampling of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import keep, wang_int
from ..params import Params

BUCKETS = 1024


def bagged(rows: DataFrame, rate: float, tree: int) -> DataFrame:
    """Rows drawn for one tree, each with chance ``rate``."""
    return rows if rate >= 1 else rows.where(keep(F.col("rid"), tree + 1, rate))


def goss_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, n): rows by |g| over the largest |g|, in 1024 buckets."""
    top = rows.agg(F.max(F.abs("g")).alias("top"))
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.abs("g") / F.col("top") * BUCKETS))
    return rows.join(F.broadcast(top)).where("top > 0").groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.first("top").alias("top"))


def goss_threshold(rows: DataFrame, top_rate: float, n: int) -> DataFrame:
    """One row, ``threshold``: the lower edge of the bucket in which the largest
    |g| reach ``top_rate`` of the ``n`` rows, counted from the top bucket."""
    w = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    found = goss_buckets(rows).withColumn("cum", F.sum("n").over(w)).where(F.col("cum") >= int(n * top_rate))
    return found.agg(F.max("bucket").alias("b"), F.max("top").alias("top")).select((F.coalesce("b", F.lit(0)) / BUCKETS * F.coalesce("top", F.lit(0.0))).alias("threshold"))


def goss(rows: DataFrame, params: Params, n: int, tree: int) -> DataFrame:
    """Rows of large |g|, and a hashed sample of the others with g and h scaled up."""
    a, b = params.goss_top_rate, params.goss_other_rate
    return goss_rows(rows, float(goss_threshold(rows, a, n).first()[0]), a, b, tree)


def goss_rows(rows: DataFrame, cut: float, a: float, b: float, tree: int) -> DataFrame:
    """Rows with |g| of ``cut`` or more, the share ``a``, and of the others a hashed
    sample, the share ``b`` of all rows, with g and h scaled up."""
    large = F.abs("g") >= cut
    scale = F.when(large, 1.0).otherwise((1 - a) / b)
    return rows.where(large | keep(F.col("rid"), tree + 1, b / (1 - a) if a < 1 else 1.0)).withColumns({"g": F.col("g") * scale, "h": F.col("h") * scale})


def sampled_features(allowed: list[int], rate: float, tree: int) -> list[int]:
    """Features of one tree: each allowed one with chance ``rate`` by a hash of the
    tree and the feature, one at least (of the smallest hash)."""
    if rate >= 1:
        return allowed
    drawn = {f: wang_int(wang_int(tree + 1) ^ f) >> 8 for f in allowed}
    return [f for f in allowed if drawn[f] < rate * (1 << 24)] or [min(allowed, key=drawn.get)]
