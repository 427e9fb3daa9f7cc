"""Binned rows packed in blocks, and what training does with them.

A block is one row that holds some ten thousand rows as arrays: bins feature by
feature, one or two bytes each, and labels, weights, scores and gradients as doubles.
The engine moves a few large values instead of arrays of small ones, and each task
sums its histograms with numpy before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.hashing import keep_array
from ..model import CATEGORICAL, MISSING_LEFT, Tree
from .histogram import GRAIN, add_cells

#: Rows of a block.
ROWS = 16_384
#: Partial histograms of so many bytes in all go to the driver as they are; more are
#: summed by a shuffle first.
DIRECT = 64 << 20
SCHEMA = "n int, rid binary, label binary, weight binary, bins binary, raw binary, g binary, h binary, live binary"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


class Block:
    """One block's arrays; ``raw`` is (classes x rows), ``bins`` (features x rows)."""

    def __init__(self, **arrays):
        self.__dict__.update(dict.fromkeys(NAMES) | arrays)

    @staticmethod
    def read(batch: pa.RecordBatch, i: int, kind: str) -> "Block":
        n = batch.column("n")[i].as_py()

        def array(name: str, dtype: str, rows: int = 0):
            value = batch.column(name)[i]
            if not value.is_valid:
                return None
            flat = np.frombuffer(value.as_buffer(), dtype)
            return flat.reshape(-1, n) if rows else flat

        return Block(n=n, rid=array("rid", "i8"), label=array("label", "f8"), weight=array("weight", "f8"), bins=array("bins", kind, 1), raw=array("raw", "f8", 1), g=array("g", "f8"), h=array("h", "f8"), live=array("live", "?"))

    def write(self) -> pa.RecordBatch:
        values = [None if getattr(self, c) is None else np.ascontiguousarray(getattr(self, c)).tobytes() for c in NAMES[1:]]
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=NAMES)


def kind_of(bins: int) -> str:
    """Type of a bin, the missing one included."""
    return "u1" if bins < 256 else "u2"


def each(blocks: DataFrame, bins: int, work: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over the blocks of each task."""
    kind = kind_of(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(Block.read(b, i, kind) for b in batches for i in range(b.num_rows))

    return blocks.mapInArrow(run, schema)


def changed(blocks: DataFrame, bins: int, change: Callable[[Block], None]) -> DataFrame:
    """The blocks after ``change``, which sets arrays of each."""

    def work(own: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for b in own:
            change(b)
            yield b.write()

    return each(blocks, bins, work, SCHEMA)


def pack(rows: DataFrame, bins: int, base: list[float] | None = None) -> DataFrame:
    """Blocks of rows (rid, bins and, if there, label, weight, raw, g, h). Without
    ``raw`` scores start at ``base``."""
    there = [c for c in ("rid", "label", "weight", "raw", "g", "h") if c in rows.columns]
    kind = kind_of(bins)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def emit() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            n = table.num_rows
            flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T
            out = Block(n=n, bins=flat("bins").astype(kind))
            for c in there:
                setattr(out, c, flat(c) if c == "raw" else table.column(c).to_numpy())
            if out.raw is None and base is not None:
                out.raw = np.repeat(np.array(base, float)[:, None], n, 1)
            return out.write()

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                if size + part.num_rows > ROWS and waiting:
                    yield emit()
                    waiting, size = [], 0
                waiting.append(part)
                size += part.num_rows
        if size:
            yield emit()

    return rows.select("bins", *there).mapInArrow(work, SCHEMA)


def spread(blocks: DataFrame) -> DataFrame:
    """The blocks over as many tasks as there are cores at least."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(cores) if blocks.rdd.getNumPartitions() < cores else blocks


def walk(tree: Tree, bins: np.ndarray, last: int) -> np.ndarray:
    """The node that each row's bins (features x rows) reach in a (partly grown) tree."""
    node = np.zeros(bins.shape[1], np.int32)
    rows = np.arange(bins.shape[1])
    size = len(tree.feature)
    tables = {n: np.isin(np.arange(last + 1), tree.left.get(n, [])) for n in range(size) if tree.feature[n] >= 0 and tree.flags[n] & CATEGORICAL}
    while True:
        f = tree.feature[node]
        at = np.flatnonzero(f >= 0)
        if not len(at):
            return node
        own = node[at]
        b = bins[f[at], rows[at]]
        left = np.where(b == last, (tree.flags[own] & MISSING_LEFT) > 0, b <= tree.bin[own])
        for n, table in tables.items():
            here = own == n
            left[here] = table[b[here]]
        node[at] = 2 * own + np.where(left, 1, 2)


def histograms(blocks: DataFrame, tree: Tree, nodes: list[int], features: list[int], width: int, bins: int, deterministic: bool = False, tasks: int = 1 << 20) -> dict[int, np.ndarray]:
    """Of each node (features x bins x (g, h, c)), rows that are not live left out.
    The driver's share is bounded: nodes x features x bins, from as many tasks at once
    as ``DIRECT`` has room for."""
    partial = partials(blocks, tree, nodes, features, bins, deterministic)
    if tasks * len(nodes) * len(features) * (bins + 1) * 24 > DIRECT:
        partial = summed(partial)
    out = {n: np.zeros((width, bins + 1, 3)) for n in nodes}
    for n, f, cells in zip(*partial.toArrow().to_pydict().values()):
        out[n][f] += np.frombuffer(cells).reshape(-1, 3)
    return out


def partials(blocks: DataFrame, tree: Tree, nodes: list[int], features: list[int], bins: int, deterministic: bool) -> DataFrame:
    """(node, f, cells) of each task: its rows' sums."""
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))

    def work(own: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        cells = None
        for b in own:
            at = slot[walk(tree, b.bins, bins)]
            rows = np.flatnonzero((at >= 0) if b.live is None else (at >= 0) & b.live)
            if not len(rows):
                continue
            whole = len(rows) == b.n
            g, h = (b.g, b.h) if whole else (b.g[rows], b.h[rows])
            if deterministic:
                g, h = (np.sign(x) * np.floor(np.abs(x) * GRAIN + 0.5) for x in (g, h))
            if cells is None:
                cells = np.zeros((len(features), len(nodes), bins + 1, 3))
            for i, f in enumerate(features):
                add_cells(cells[i], at[rows], b.bins[f] if whole else b.bins[f][rows], g, h)
        if cells is not None:
            if deterministic:
                cells[..., :2] /= GRAIN
            for k, n in enumerate(nodes):
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(features), pa.int32()), pa.array(features, pa.int32()), pa.array([cells[i, k].tobytes() for i in range(len(features))], pa.binary())], names=["node", "f", "cells"])

    return each(blocks, bins, work, "node int, f int, cells binary")


def summed(partial: DataFrame) -> DataFrame:
    """(node, f, cells): the sums over all tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for n, f, cells in zip(*batch.to_pydict().values()):
                found = np.frombuffer(cells)
                total[n, f] = total[n, f] + found if (n, f) in total else found
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)] + [pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["node", "f", "cells"])

    return partial.repartition("node", "f").mapInArrow(work, partial.schema)


def cells_table(partial: DataFrame) -> DataFrame:
    """(node, f, bin, g, h, c) of the cells that hold rows, from ``summed`` partials."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, f, cells in zip(*batch.to_pydict().values()):
                x = np.frombuffer(cells).reshape(-1, 3)
                b = np.flatnonzero(x[:, 2])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), n, np.int32)), pa.array(np.full(len(b), f, np.int32)), pa.array(b.astype(np.int32)), *[pa.array(x[b, j]) for j in (0, 1)], pa.array(x[b, 2].astype(np.int64))], names=["node", "f", "bin", "g", "h", "c"])

    return partial.mapInArrow(work, "node int, f int, bin int, g double, h double, c long")


def rows_of(blocks: DataFrame, bins: int, schema: str, pick: Callable[[Block], list[np.ndarray]]) -> DataFrame:
    """Plain rows of the columns that ``pick`` gives for each block."""
    names = [x.split()[0] for x in schema.split(", ")]

    def work(own: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for b in own:
            columns = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(x), dtype=np.int32)), pa.array(x.T.ravel())) if x.ndim == 2 else pa.array(x) for x in pick(b)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return each(blocks, bins, work, schema)


def nodes(blocks: DataFrame, tree: Tree, bins: int) -> DataFrame:
    """(rid, node) of every row."""
    return rows_of(blocks, bins, "rid long, node int", lambda b: [b.rid, walk(tree, b.bins, bins)])


def sample(b: Block, seed: int, rate: float) -> None:
    """Rows drawn for one tree, as ``sampling.bagged`` draws them."""
    b.live = keep_array(b.rid, seed, rate)


def one_side(b: Block, cut: float, top: float, other: float, seed: int) -> None:
    """Rows of large |g|, and a sample of the others scaled up, as ``sampling.goss_rows``
    takes them."""
    large = np.abs(b.g) >= cut
    b.live = large | keep_array(b.rid, seed, other / (1 - top) if top < 1 else 1.0)
    scale = np.where(large, 1.0, (1 - top) / other)
    b.g, b.h = b.g * scale, b.h * scale
