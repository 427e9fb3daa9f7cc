"""Importance resampling of documents towards a target of good ones.

Hashed word unigrams and bigrams give two bags of buckets, one of the target's
texts and one of all texts. A document's weight is the ratio of the two generative
models over its buckets; Gumbel noise on the log weight and a cut at the k-th key
draw k documents without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import flat
from .common import extended, hashed_unit, materialise

_RUN = 1 << 21


def _buckets(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows [a, b): bucket and row of every unigram and bigram."""
    data, offsets = flat.text_bytes(batch.column("text"))
    for a, b in flat.row_runs(offsets, _RUN):
        own = offsets[a : b + 1]
        with np.errstate(over="ignore"):
            h, r = flat.words(data[own[0] : own[-1]], own - own[0], flat.BY_MARK, flat.SMALL)
            h2, r2 = flat.ngrams(h, r, 2)
        yield a, b, (np.r_[h, h2] % np.uint64(buckets)).astype(np.int64), np.r_[r, r2]


def log_ratios(texts: DataFrame, buckets: int, smoothing: float) -> np.ndarray:
    """Log of the target's over the raw probability of each bucket, from counts over
    all rows of ``texts`` (text, target: whether the row also is in the target)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.asarray(batch.column("target").to_pylist(), bool)
            for a, b, bucket, row in _buckets(batch, buckets):
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[a:b][row]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    counts = texts.select("text", "target").mapInArrow(work, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    share = lambda x: np.log((x + smoothing) / (x.sum() + smoothing * buckets))
    return share(target) - share(raw)


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column, by histograms that narrow down on
    it; only counts of 1024 buckets come to the driver. None if k < 1 or the
    column has no values."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    if k >= n:
        return low
    while high > low and n > 50_000:
        width = (high - low) / 1024
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(1023))
        counts = dict(df.where(F.col(column).between(low, high)).groupBy(at.alias("at")).agg(F.count("*")).collect())
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                break
            k -= counts[b]
        inside = df.where(F.col(column).between(low, high) & (at == b)).agg(F.min(column), F.max(column), F.count("*")).first()
        low, high, n = inside
    if high == low:
        return low
    return df.where(F.col(column).between(low, high)).orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]


def resample(df: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int | None = None, share: float | None = None, buckets: int = 1 << 14, smoothing: float = 1.0, max_target: int = 100_000, seed: int = 1) -> DataFrame:
    """(doc_id, log_weight, sample_key, kept) for every row of ``df``.

    ``target_ids`` (one column ``doc_id``) names the good documents; at most
    ``max_target`` of them, the first by a hash of the id, make the target model.
    The raw model counts every row. ``k`` rows are drawn, or ``share`` of all rows
    that have a word. Rows that repeat a doc_id and text share their noise and
    are drawn together, which may exceed k.

    Null texts and texts without a word have no weight and are not kept. A null
    doc_id is drawn like any other. Without target rows all weights are alike,
    and the draw is uniform. Other columns of ``df`` don't matter.
    """
    ids = target_ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)
    ids = ids.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_good"))
    texts = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    flagged = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("_good", F.lit(False)).alias("target"))
    ratio = log_ratios(flagged, buckets, smoothing)
    if not target_ids.limit(1).count():
        ratio = np.zeros(buckets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b, bucket, row in _buckets(batch, buckets):
                weight[a:b] = np.bincount(row, ratio[bucket], b - a)
                words[a:b] = np.bincount(row, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight, mask=words == 0)], names=["doc_id", "log_weight"])

    schema = extended(texts.select("doc_id"), log_weight="double")
    u = hashed_unit(F.col("doc_id"), F.lit(seed)) + F.lit(2.0**-53)
    keyed = materialise(texts.mapInArrow(work, schema).withColumn("sample_key", F.col("log_weight") - F.log(-F.log(u))), "keys")
    if k is None:
        k = round((1.0 if share is None else share) * keyed.where(F.col("sample_key").isNotNull()).count())
    cut = kth_largest(keyed, "sample_key", k)
    kept = F.lit(False) if cut is None else F.coalesce(F.col("sample_key") >= F.lit(cut), F.lit(False))
    return keyed.select(F.col("doc_id").alias(doc_id), "log_weight", "sample_key", kept.alias("kept"))
