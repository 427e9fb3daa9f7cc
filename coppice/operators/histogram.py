"""Gradient histograms of nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Sums are made of multiples of this if they must not depend on the order of rows.
GRAIN = float(1 << 20)


def add_cells(cells: np.ndarray, slot: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Add rows of one feature to ``cells`` (slots x bins x (g, h, c))."""
    slots, width = cells.shape[:2]
    at = slot * width + bins if slots > 1 else bins
    cells[..., 0] += np.bincount(at, g, slots * width).reshape(slots, width)
    cells[..., 1] += np.bincount(at, h, slots * width).reshape(slots, width)
    cells[..., 2] += np.bincount(at, minlength=slots * width).reshape(slots, width)


def histogram(rows: DataFrame, features: list[int] | None = None, deterministic: bool = False) -> DataFrame:
    """(node, f, bin, g, h, c) from (node, bins, g, h): sums and counts. Each task sums
    its rows by ``add_cells`` before the shuffle; ``features`` masks features out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            g, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in "gh")
            if deterministic:
                g, h = (np.sign(x) * np.floor(np.abs(x) * GRAIN + 0.5) for x in (g, h))
            nodes, slot = np.unique(batch.column("node").to_numpy(), return_inverse=True)
            for f in range(bins.shape[1]) if features is None else features:
                cells = np.zeros((len(nodes), int(bins[:, f].max()) + 1, 3))
                add_cells(cells, slot, bins[:, f].astype(np.int64), g, h)
                for n, own in zip(nodes.tolist(), cells):
                    old = total.get((n, f))
                    if old is not None and len(old) > len(own):
                        own, old = old, own
                    if old is not None:
                        own[: len(old)] += old
                    total[n, f] = own
        for (n, f), x in total.items():
            b = np.flatnonzero(x[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), n, np.int32)), pa.array(np.full(len(b), f, np.int32)), pa.array(b.astype(np.int32)), pa.array(x[b, 0]), pa.array(x[b, 1]), pa.array(x[b, 2].astype(np.int64))], names=["node", "f", "bin", "g", "h", "c"])

    own = rows.select(F.col("node").cast("int").alias("node"), "bins", F.col("g").cast("double").alias("g"), F.col("h").cast("double").alias("h"))
    partial = own.mapInArrow(work, "node int, f int, bin int, g double, h double, c long")
    total = lambda c: (F.sum(c) / GRAIN if deterministic else F.sum(c)).alias(c)
    return partial.groupBy("node", "f", "bin").agg(total("g"), total("h"), F.sum("c").alias("c"))


def subtract(parent: DataFrame, sibling: DataFrame, node: int) -> DataFrame:
    """The histogram of the other child: the parent's less its sibling's."""
    s = sibling.select("f", "bin", F.col("g").alias("sg"), F.col("h").alias("sh"), F.col("c").alias("sc"))
    z = lambda c: F.coalesce(c, F.lit(0))
    joined = parent.join(s, ["f", "bin"], "left")
    out = joined.select(F.lit(node).alias("node"), "f", "bin", (F.col("g") - z("sg")).alias("g"), (F.col("h") - z("sh")).alias("h"), (F.col("c") - z("sc")).alias("c"))
    return out.where("c > 0")
