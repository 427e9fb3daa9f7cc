"""Boosting: the driver loop over trees and the jobs that each level needs.

Rows are binned once and packed in blocks. Each tree makes one pass that adds the
former tree to the scores and takes gradients, whose result is kept in memory or on
disk. A level of a tree is one job: histograms of the smaller child of each split, from
which the larger one's follows by subtraction. Every ``REFRESH`` trees the blocks are
written to the shared store and the former copy is removed: one write in the time of
some hundred passes, so that lineage stays short and a lost executor costs no more
than the trees since.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions import metrics
from ..functions.objectives import base_scores, gradient_arrays
from ..model import CATEGORICAL, MISSING_LEFT, Forest, Tree
from ..operators import blocks as packed, sampling, splits
from ..operators.binning import assign_bins, bin_edges, collect_edges, number_rows
from ..operators.guards import check_rows, warn
from ..operators.predict import raw_scores
from ..params import ModelError, Params
from ..store import discard, store

log = logging.getLogger("coppice")
REFRESH = 16
#: Up to so many cells a level's histogram (nodes x features x bins) is searched on
#: the driver; larger ones are by window functions, and one row a node comes back.
LOCAL_CELLS = 1_000_000
#: A leaf's quantile is taken from every (rows / RENEWAL)-th row.
RENEWAL = 262_144


@dataclass
class Binned:
    """A binned table (rid, label, weight, bins, raw) and what binned it."""

    rows: DataFrame
    edges: list[list[float]]
    features: list[str]
    params: Params
    n: int
    warnings: list[str] = field(default_factory=list)


def prepare(df: DataFrame, features: list[str], label: str, weight: str | None, params: Params, rid: str | None) -> tuple[DataFrame, int]:
    """(rid, label, weight, features) with dense row numbers."""
    if rid is None:
        df, rid = number_rows(df, "_rid"), "_rid"
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    out = df.select(F.col(f"`{rid}`").cast("long").alias("rid"), F.col(f"`{label}`").cast("double").alias("label"), w.alias("weight"), *[F.col(f"`{c}`") for c in features])
    n = out.count()
    check_rows(out, features, params)
    return out, n


def bin_dataset(df: DataFrame, features: list[str], label: str, params: Params, weight: str | None = None, rid: str | None = None) -> Binned:
    """Validate, take edges and bin; the result can serve many fits."""
    rows, n = prepare(df, features, label, weight, params, rid)
    told = warn(rows, features, params, n)
    edges = collect_edges(bin_edges(rows, features, params), len(features))
    return Binned(store(assign_bins(rows, features, edges, params, ["rid", "label", "weight"]), "bins"), edges, features, params, n, told)


class Grower:
    """Grows one tree on blocks with gradients, or on rows (rid, bins, g, h)."""

    def __init__(self, rows: DataFrame, data: Binned, params: Params, allowed: list[int], tasks: int = 1 << 20):
        self.data, self.params, self.allowed, self.tasks = data, params, allowed, tasks
        self.blocks = rows if "live" in rows.columns else packed.pack(rows, params.bins)
        self.categorical = [i for i, c in enumerate(data.features) if c in params.categorical_features]
        self.monotone = {i: s for i, s in enumerate(params.monotone_constraints) if s}
        self.tree = Tree.empty(params.max_depth)
        self.sums: dict[int, tuple[float, float, int]] = {}
        self.bounds: dict[int, tuple[float, float]] = {0: (-np.inf, np.inf)}
        self.cells: dict[int, np.ndarray] = {}

    def value(self, node: int) -> float:
        g, h, _ = self.sums[node]
        lo, hi = self.bounds[node]
        return min(max(-g / (h + self.params.reg_lambda), lo), hi) if h + self.params.reg_lambda > 0 else 0.0

    def find(self, nodes: list[int]) -> dict[int, object]:
        """Best split of each of the nodes that has one."""
        if not nodes:
            return {}
        p, width = self.params, len(self.data.features)
        if len(nodes) * width * p.max_bin > LOCAL_CELLS:
            return self.find_by_windows(nodes)
        # Of two children the one with fewer rows is counted, the other subtracted.
        larger = {}
        for n in nodes:
            other = n + 1 if n % 2 else n - 1
            if n and other in nodes and (n - 1) // 2 in self.cells and n not in larger.values() and other not in larger:
                big, small = (n, other) if (self.sums[n][2], n) > (self.sums[other][2], other) else (other, n)
                larger[big] = small
        counted = [n for n in nodes if n not in larger]
        cells = packed.histograms(self.blocks, self.tree, counted, self.allowed, width, p.bins, p.deterministic, self.tasks)
        for big, small in larger.items():
            rest = self.cells[(big - 1) // 2] - cells[small]
            rest[rest[..., 2] == 0] = 0.0
            cells[big] = rest
        for n in nodes:  # a parent is needed no longer once both children are there
            self.cells.pop((n - 1) // 2, None)
        self.cells |= cells
        if 0 in nodes:
            g, h, c = cells[0][self.allowed[0]].sum(0)
            self.sums[0] = (float(g), float(h), int(c))
        found = [splits.search(cells[n], n, p, self.categorical, self.monotone, self.bounds[n]) for n in nodes]
        return {s.node: s for s in found if s is not None}

    def find_by_windows(self, nodes: list[int]) -> dict[int, object]:
        """The same where the histograms are too large for the driver."""
        p = self.params
        hist = packed.cells_table(packed.summed(packed.partials(self.blocks, self.tree, nodes, self.allowed, p.bins, p.deterministic)))
        if 0 in nodes:
            g, h, c = hist.where(F.col("f") == self.allowed[0]).agg(F.sum("g"), F.sum("h"), F.sum("c")).first()
            self.sums[0] = (g or 0.0, h or 0.0, c or 0)
        bounds = None
        if self.monotone:
            bounds = hist.sparkSession.createDataFrame([(n, *map(float, self.bounds[n])) for n in nodes], "node int, lo double, hi double")
        found = splits.best(splits.candidates(hist, p, self.categorical, self.monotone, bounds)).collect()
        return {r.node: r for r in found}

    def apply(self, r) -> list[int]:
        """Split a node; its children."""
        t, n = self.tree, r.node
        t.feature[n], t.gain[n], t.bin[n] = r.f, r.gain, r.bin
        if r.left_bins is not None:
            t.left[n] = list(r.left_bins)
            t.flags[n] = CATEGORICAL | (MISSING_LEFT if self.params.bins in r.left_bins else 0)
        else:
            edges = self.data.edges[r.f]
            t.threshold[n] = edges[r.bin] if r.bin < len(edges) else np.inf
            t.flags[n] = MISSING_LEFT if r.missing_left else 0
        a, b = 2 * n + 1, 2 * n + 2
        self.sums[a], self.sums[b] = (r.gl, r.hl, r.cl), (r.gr, r.hr, r.cr)
        lo, hi = self.bounds[n]
        self.bounds[a] = self.bounds[b] = (lo, hi)
        if r.left_bins is None and (sign := self.monotone.get(r.f)):
            mid = min(max((self.value(a) + self.value(b)) / 2, lo), hi)
            self.bounds[a], self.bounds[b] = ((lo, mid), (mid, hi)) if sign > 0 else ((mid, hi), (lo, mid))
        return [a, b]

    def levels(self) -> None:
        live = [0]
        for _ in range(self.params.max_depth):
            found = self.find(live)
            live = [k for n in live if n in found for k in self.apply(found[n])]
            if not live:
                return

    def leaves(self) -> None:
        """Best first: always the open leaf of highest gain, the lowest on ties."""
        p = self.params
        open_, count = self.find([0]), 1
        while open_ and count < p.num_leaves:
            n = min(open_, key=lambda k: (-open_[k].gain, k))
            kids = self.apply(open_.pop(n))
            count += 1
            if count < p.num_leaves:
                open_ |= self.find([k for k in kids if int(np.log2(k + 1)) < p.max_depth])

    def grow(self) -> Tree:
        self.leaves() if self.params.num_leaves else self.levels()
        self.cells.clear()
        for n, (_, _, c) in self.sums.items():
            self.tree.cover[n] = c
            if self.tree.feature[n] < 0:
                self.tree.leaf[n] = self.params.learning_rate * self.value(n)
        return self.tree


def renew(blocks: DataFrame, tree: Tree, bounds: dict[int, tuple[float, float]], params: Params, n: int) -> None:
    """Leaves of mae and quantile losses: the residuals' quantile, where a leaf has
    four of them. Residuals are those before the tree, of the rows that it grew on."""
    step = max(1, n // RENEWAL)

    def pick(b: packed.Block) -> list[np.ndarray]:
        own = b.rid % step == 0
        if b.live is not None:
            own &= b.live
        return [b.rid[own], (b.label - b.raw[0])[own], packed.walk(tree, b.bins, params.bins)[own]]

    rows = packed.rows_of(blocks, params.bins, "rid long, residual double, node int", pick)
    for r in residual_quantiles(rows, 0.5 if params.objective == "mae" else params.alpha, n).collect():
        lo, hi = bounds.get(r.node, (-np.inf, np.inf))
        tree.leaf[r.node] = params.learning_rate * min(max(r.value, lo), hi)


def residual_quantiles(rows: DataFrame, q: float, n: int) -> DataFrame:
    """(node, value): the residual at rank min(m - 1, floor(m q)) of a node's m."""
    from pyspark.sql import Window

    w = Window.partitionBy("node")
    ranked = rows.where(F.col("rid") % max(1, n // RENEWAL) == 0).select("node", "residual", (F.row_number().over(w.orderBy("residual")) - 1).alias("i"), F.count("*").over(w).alias("m"))
    return ranked.where("m >= 4").where(F.col("i") == F.least(F.col("m") - 1, F.floor(F.col("m") * q))).select("node", F.col("residual").alias("value"))


def best_round(history: list[float], higher: bool) -> tuple[int, int]:
    """Index of the first best metric, and how many rounds came after it."""
    best = 0
    for r, value in enumerate(history):
        if value > history[best] if higher else value < history[best]:
            best = r
    return best, len(history) - 1 - best


def fit(data: Binned, params: Params, valid: DataFrame | None = None, init: Forest | None = None, start: DataFrame | None = None, valid_start: DataFrame | None = None) -> tuple[Forest, list[float]]:
    """Boost on a binned table. ``valid``: binned rows of an evaluation set;
    ``start``: (rid, raw) scores that boosting goes on from. Returns the forest,
    cut to its best round if it stopped early, and the metric by round."""
    k, last = params.classes, params.bins
    base = list(init.base) if init else base_scores(data.rows, params, data.n)
    rows = packed.pack(data.rows.join(start, "rid") if start is not None else data.rows, last, base)
    blocks = store(packed.spread(rows), "blocks")
    tasks = blocks.rdd.getNumPartitions()
    checked = None if valid is None else store(packed.pack(valid.join(valid_start, "rid") if valid_start is not None else valid, last, base), "valid")
    categorical = [i for i, c in enumerate(data.features) if c in params.categorical_features]
    forest = Forest(params.objective, params.max_bin, base, data.features, categorical, list(init.trees) if init else [], init.labels if init else None)
    allowed = [i for i, c in enumerate(data.features) if params.allowed_features is None or c in params.allowed_features]
    history: list[float] = []
    best = 0
    kept: list[DataFrame] = []  # cached blocks, the former ones until the new ones are there
    last_trees: list[tuple[int, Tree]] = []  # of the scores that the next pass adds

    def advance(table: DataFrame, trees: list[tuple[int, Tree]], grade: int | None = None, cut: float | None = None, tree: int = 0) -> DataFrame:
        """Blocks with the trees added to their scores and, of class ``grade``, gradients
        and the rows that one tree grows on."""

        def change(b: packed.Block) -> None:
            if trees:
                b.raw = b.raw.copy()
            for c, t in trees:
                b.raw[c] += t.leaf[packed.walk(t, b.bins, last)]
            b.live = None
            if grade is not None:
                b.g, b.h = gradient_arrays(params, b.raw, b.label, b.weight, grade)
                if cut is not None:
                    packed.one_side(b, cut, params.goss_top_rate, params.goss_other_rate, tree + 1)
                elif not params.goss and params.subsample < 1:
                    packed.sample(b, tree // k + 1, params.subsample)

        return packed.changed(table, last, change)

    def cached(table: DataFrame) -> DataFrame:
        kept.append(table.persist(StorageLevel.MEMORY_AND_DISK))
        return table

    def release(but: int) -> None:
        while len(kept) > but:
            kept.pop(0).unpersist()

    warm = -(-1 // params.learning_rate) if params.goss else 0
    for r in range(params.n_estimators):
        grown: list[tuple[int, Tree]] = []
        if r and r % REFRESH == 0:
            new = store(advance(blocks, last_trees), "blocks")
            release(0)
            discard(stored)
            blocks, last_trees = new, []
        if r % REFRESH == 0:
            stored = blocks
        for c in range(k):
            t = r * k + c
            now = cached(advance(blocks, last_trees, c, None, t))
            if params.goss and r >= warm:
                plain = packed.rows_of(now, last, "g double", lambda b: [b.g])
                cut = float(sampling.goss_threshold(plain, params.goss_top_rate, data.n).first()[0])
                now = cached(advance(now, [], c, cut, t))
            grower = Grower(now, data, params, sampling.sampled_features(allowed, params.colsample_bytree, t), tasks)
            tree = grower.grow()
            if params.objective in ("mae", "quantile"):
                renew(now, tree, grower.bounds, params, data.n)
            release(1)
            # Later classes of the round are graded by the scores before it.
            blocks, last_trees = now, []
            grown.append((c, tree))
            forest.trees.append(tree)
        last_trees = grown
        if checked is not None:
            former, checked = checked, advance(checked, grown).persist(StorageLevel.MEMORY_AND_DISK)
            shown = packed.rows_of(checked, last, "label double, score " + ("array<double>" if k > 1 else "double"), lambda b: [b.label, b.raw if k > 1 else b.raw[0]])
            value = metrics.evaluate(shown, params.shown_metric, params.alpha, params.tweedie_variance_power, params.objective in ("poisson", "tweedie")).first()[0]
            former.unpersist()
            if (r + 1) % REFRESH == 0:
                former, checked = checked, store(checked, "valid")
                former.unpersist()
            history.append(value)
            if params.verbose:
                log.info("[%d] %s %.6f", r + 1, params.shown_metric, value)
            best, stale = best_round(history, metrics.higher_is_better(params.shown_metric))
            if params.early_stopping_rounds and stale >= params.early_stopping_rounds:
                break
    release(0)
    if checked is not None:
        checked.unpersist()
    discard(stored)
    if params.early_stopping_rounds and history:
        forest = forest.cut((len(init.trees) // k if init else 0) + best + 1)
    forest.extra |= {"params": params.as_dict(), "bestIteration": best + 1 if history else None, "history": history}
    return forest, history


def binned_scores(forest: Forest, data: Binned, rows: DataFrame) -> DataFrame:
    """(rid, raw): a forest's scores of binned rows, whose edges its thresholds are."""
    if forest.features != data.features or forest.max_bin != data.params.max_bin:
        raise ModelError("the model to go on from has other features or another binning")
    for tree in forest.trees:
        for n in tree.reachable():
            f = int(tree.feature[n])
            if f < 0 or tree.flags[n] & CATEGORICAL:
                continue
            edges = np.asarray(data.edges[f])
            tree.bin[n] = np.searchsorted(edges, tree.threshold[n])
            if np.isfinite(tree.threshold[n]) and (tree.bin[n] >= len(edges) or edges[tree.bin[n]] != tree.threshold[n]):
                raise ModelError(f"the model to go on from splits {data.features[f]} at {tree.threshold[n]}, which is no edge of the binned rows")
    last, k = data.params.bins, forest.classes

    def score(b: packed.Block) -> list[np.ndarray]:
        raw = np.repeat(np.array(forest.base, float)[:, None], b.n, 1)
        for t, tree in enumerate(forest.trees):
            raw[t % k] += tree.leaf[packed.walk(tree, b.bins, last)]
        return [b.rid, raw]

    return packed.rows_of(packed.pack(rows, last), last, "rid long, raw array<double>", score)


def train(df: DataFrame, features: list[str], label: str, params: Params, weight: str | None = None, rid: str | None = None, valid: DataFrame | None = None, init: Forest | None = None) -> tuple[Forest, list[float]]:
    """Fit on a table of raw values."""
    if init is not None:
        same = (init.objective, init.classes, init.features, init.max_bin, sorted(init.categorical)) == (params.objective, params.classes, features, params.max_bin, sorted(features.index(c) for c in params.categorical_features))
        if not same:
            raise ModelError("the model to go on from has another objective, width, binning or features")
    data = bin_dataset(df, features, label, params, weight, rid)
    start = checked = valid_start = None
    if valid is not None:
        numbered, _ = prepare(valid, features, label, None, params, rid)
        checked = store(assign_bins(numbered, features, data.edges, params, ["rid", "label", "weight"]), "valid")
    if init is not None:
        prepared, _ = prepare(df, features, label, weight, params, rid)
        start = store(prepared.select("rid", raw_scores(init, prepared).alias("raw")), "start")
        if valid is not None:
            valid_start = store(numbered.select("rid", raw_scores(init, numbered).alias("raw")), "start")
    return fit(data, params, checked, init, start, valid_start)
