"""Bin edges by nearest rank, and bins of values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..params import Params


def number_rows(df: DataFrame, rid: str = "rid", order: list[str] | None = None) -> DataFrame:
    """Add dense row numbers 0 .. n - 1 in the order of ``order`` (all columns by
    default; equal rows are numbered in any order). Ranges are sorted each for
    itself; only one count a range comes together."""
    cols = order or df.columns
    sorted_ = df.repartitionByRange(*[F.col(f"`{c}`") for c in cols]).sortWithinPartitions(*[F.col(f"`{c}`") for c in cols])
    parts = sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).persist()
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", "_first", before.alias("_before"))
    return parts.join(F.broadcast(starts), "_part").withColumn(rid, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def number(value: Column) -> Column:
    """A feature as double, NaN as null."""
    v = value.cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def bin_edges(df: DataFrame, features: list[str], params: Params) -> DataFrame:
    """(f, k, edge): upper edges of the numeric features' bins but the last. Edge k
    is the value at rank floor((k + 1) m / bins) of a feature's m values that aren't
    missing. All rows count: equal values are counted first, so that none gathers in
    one task, then ranges of the distinct ones are sorted each for itself; only one
    count a range and the edges come together."""
    spark = df.sparkSession
    schema = "f int, k int, edge double"
    numeric = [(i, c) for i, c in enumerate(features) if c not in params.categorical_features]
    if not numeric:
        return spark.createDataFrame([], schema)
    values = F.array(*[F.struct(F.lit(i).alias("f"), number(F.col(f"`{c}`")).alias("v")) for i, c in numeric])
    counted = df.select(F.explode(values).alias("x")).select("x.f", "x.v").where("v is not null").groupBy("f", "v").agg(F.count("*").alias("c"))
    parts = counted.repartitionByRange("f", "v").sortWithinPartitions("f", "v").withColumn("part", F.spark_partition_id()).persist()
    try:
        before: dict[tuple[int, int], int] = {}
        m: dict[int, int] = {}
        for r in sorted(parts.groupBy("part", "f").agg(F.sum("c").alias("n")).collect()):
            before[r.part, r.f] = m.get(r.f, 0)
            m[r.f] = m.get(r.f, 0) + r.n
        ranks = {f: np.arange(1, params.bins, dtype=np.int64) * n // params.bins for f, n in m.items()}

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: dict[int, int] = {}
            for batch in batches:
                fs, v, c, part = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
                for f in np.unique(fs).tolist():
                    own = fs == f
                    low = done.get(f, before[int(part[0]), f])
                    up = low + np.cumsum(c[own])
                    done[f] = int(up[-1])
                    first, end = np.searchsorted(ranks[f], (low, done[f]))
                    edge = v[own][np.searchsorted(up, ranks[f][first:end], "right")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), f, np.int32)), pa.array(np.arange(first, end, dtype=np.int32)), pa.array(edge)], names=["f", "k", "edge"])

        return spark.createDataFrame(parts.mapInArrow(work, schema).collect(), schema)
    finally:
        parts.unpersist()


def collect_edges(edges: DataFrame, features: int) -> list[list[float]]:
    """Edges by feature; at most features x bins numbers."""
    out: list[list[float]] = [[] for _ in range(features)]
    for r in edges.orderBy("f", "k").collect():
        out[r.f].append(r.edge)
    return out


def bin_column(value: Column, edges: list[float], categorical: bool, bins: int) -> Column:
    """Bin of a value as an expression: edges below it, or the category's id;
    missing values have bin ``bins``."""
    v = number(value)
    if categorical:
        found = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.rint(v).cast("int")))
    else:
        found = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < v))
    return F.when(v.isNull(), F.lit(bins)).otherwise(found).cast("int")


def assign_bins(df: DataFrame, features: list[str], edges: list[list[float]], params: Params, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``bins``, an array with one bin for each feature."""
    own = df.select(*keep, *[number(F.col(f"`{c}`")).alias(f"_x{i}") for i, c in enumerate(features)])
    kind = [c in params.categorical_features for c in features]
    b = params.bins
    schema = T.StructType([*own.select(*keep).schema.fields, T.StructField("bins", T.ArrayType(T.ShortType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [np.asarray(e, float) for e in edges]
        for batch in batches:
            out = np.empty((batch.num_rows, len(features)), np.int16)
            for i in range(len(features)):
                v = batch.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(float)
                missing = np.isnan(v)
                out[:, i] = np.clip(np.rint(np.where(missing, 0, v)), 0, b - 1) if kind[i] else np.searchsorted(cuts[i], v, "left")
                out[missing, i] = b
            bins = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, max(len(features), 1), dtype=np.int32)[: batch.num_rows + 1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], bins], names=[*keep, "bins"])

    return own.mapInArrow(work, schema)
