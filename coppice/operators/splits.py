"""Best split of each node from its histogram, by window prefixes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import Params


def _gain(params: Params) -> Column:
    lam = params.reg_lambda
    side = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + lam)
    return side("gl", "hl") + side("gr", "hr") - side("ng", "nh")


def candidates(hist: DataFrame, params: Params, categorical: list[int], monotone: dict[int, int] | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Every admissible split: (node, f, bin, missing_left, left_bins, gain, gl, hl,
    cl, gr, hr, cr). For a numeric feature, bins up to ``bin`` go left, and the
    missing ones if ``missing_left``; for a categorical one ``left_bins`` do.
    ``bounds`` (node, lo, hi) limits the children's values where splits are
    monotone."""
    last = params.bins
    per = Window.partitionBy("node", "f")
    # A numeric feature's bin 0 has a candidate even if it is empty.
    numeric = ~F.col("f").isin(categorical) if categorical else F.lit(True)
    zero = hist.where(numeric).select("node", "f").distinct().select("node", "f", F.lit(0).alias("bin"), F.lit(0.0).alias("g"), F.lit(0.0).alias("h"), F.lit(0).cast("long").alias("c"))
    dense = hist.select("node", "f", "bin", "g", "h", "c").where(numeric).unionByName(zero).groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("c").alias("c"))
    total = lambda x, w=per: F.sum(x).over(w)
    missing = lambda x: F.sum(F.when(F.col("bin") == last, F.col(x)).otherwise(0)).over(per)
    known = dense.select("*", total("g").alias("ng"), total("h").alias("nh"), total("c").alias("nc"), missing("g").alias("mg"), missing("h").alias("mh"), missing("c").alias("mc"))
    prefix = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = known.where(F.col("bin") < last).select("*", *[F.sum(x).over(prefix).alias(f"p{x}") for x in "ghc"]).where(F.col("bin") < last - 1)
    sides = F.array(F.lit(False), F.lit(True))
    both = run.withColumn("missing_left", F.explode(sides)).where("not missing_left or mh > 0")
    left = lambda p, m: F.when(F.col("missing_left"), F.col(p) + F.col(m)).otherwise(F.col(p))
    number = both.select("node", "f", "bin", "missing_left", F.lit(None).cast("array<int>").alias("left_bins"), left("pg", "mg").alias("gl"), left("ph", "mh").alias("hl"), left("pc", "mc").alias("cl"), "ng", "nh", "nc")
    out = number
    if categorical:
        own = hist.where(F.col("f").isin(categorical)).where("h > 0")
        order = per.orderBy(F.col("g") / (F.col("h") + params.cat_smooth), "bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = own.select("node", "f", (F.count("*").over(order) - 1).cast("int").alias("bin"), F.lit(False).alias("missing_left"), F.collect_list("bin").over(order).alias("left_bins"), *[F.sum(x).over(order).alias(f"{x}l") for x in "ghc"], *[F.sum(x).over(per).alias(f"n{x}") for x in "ghc"], F.count("*").over(per).alias("m"))
        out = out.unionByName(ranked.where("bin < m - 1").drop("m").withColumn("left_bins", F.array_sort("left_bins")))
    out = out.select("*", *[(F.col(f"n{x}") - F.col(f"{x}l")).alias(f"{x}r") for x in "ghc"]).withColumn("gain", _gain(params))
    out = out.where((F.col("hl") >= params.min_child_weight) & (F.col("hr") >= params.min_child_weight) & (F.col("cl") > 0) & (F.col("cr") > 0))
    out = out.where(~F.isnan("gain") & (F.col("gain") > params.min_split_gain) & (F.col("gain") < float("inf")))
    if monotone and any(monotone.values()):
        sign = F.lit(0)
        for f, s in monotone.items():
            sign = F.when(F.col("f") == f, s).otherwise(sign)
        lam = params.reg_lambda
        if bounds is not None:
            out = out.join(F.broadcast(bounds), "node", "left")
        clamp = lambda v: F.greatest(F.coalesce(F.col("lo"), F.lit(float("-inf"))), F.least(F.coalesce(F.col("hi"), F.lit(float("inf"))), v)) if bounds is not None else v
        vl, vr = clamp(-F.col("gl") / (F.col("hl") + lam)), clamp(-F.col("gr") / (F.col("hr") + lam))
        is_cat = F.col("f").isin(categorical) if categorical else F.lit(False)
        out = out.where(is_cat | (sign * (vr - vl) >= 0))
    return out.select("node", "f", "bin", "missing_left", "left_bins", "gain", *[f"{x}{s}" for s in "lr" for x in "ghc"])


def best(found: DataFrame) -> DataFrame:
    """The split of highest gain of each node; of equal ones that of the lowest
    feature, then of the lowest bin, then with missing values right."""
    order = Window.partitionBy("node").orderBy(F.desc("gain"), "f", "bin", "missing_left")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


@dataclass
class Split:
    """A node's split, with the fields of a row of ``best``."""

    node: int
    f: int
    bin: int
    missing_left: bool
    left_bins: list[int] | None
    gain: float
    gl: float
    hl: float
    cl: int
    gr: float
    hr: float
    cr: int


def search(hist: np.ndarray, node: int, params: Params, categorical: list[int], monotone: dict[int, int], bounds: tuple[float, float]) -> Split | None:
    """The split that ``best`` of ``candidates`` finds, from one node's histogram as
    an array (features x bins x (g, h, c)); features without rows are masked out."""
    last, lam = params.bins, params.reg_lambda
    features = len(hist)
    seen = hist[:, :, 2].sum(1) > 0
    if not seen.any():
        return None
    total = hist[:, : last + 1].sum(1)  # of each feature: g, h, c
    gain = np.full((features, last, 2), -np.inf)
    left = np.zeros((features, last, 2, 3))
    run = np.cumsum(hist[:, : last - 1], 1)
    left[:, : last - 1, 0] = run
    left[:, : last - 1, 1] = run + hist[:, last][:, None]
    open_ = np.zeros(gain.shape, bool)
    open_[:, : last - 1, 0] = True
    open_[:, : last - 1, 1] = (hist[:, last, 1] > 0)[:, None]
    orders = {}
    for f in categorical:
        open_[f] = False
        bins = np.flatnonzero(hist[f, :, 1] > 0)
        order = bins[np.lexsort((bins, hist[f, bins, 0] / (hist[f, bins, 1] + params.cat_smooth)))]
        orders[f] = order
        n = len(order) - 1
        if n > 0:
            left[f, :n, 0] = np.cumsum(hist[f, order], 0)[:n]
            open_[f, :n, 0] = True
            total[f] = hist[f, order].sum(0)
    right = total[:, None, None] - left
    with np.errstate(all="ignore"):
        value = left[..., 0] ** 2 / (left[..., 1] + lam) + right[..., 0] ** 2 / (right[..., 1] + lam) - (total[:, 0] ** 2 / (total[:, 1] + lam))[:, None, None]
        ok = open_ & seen[:, None, None] & (left[..., 1] >= params.min_child_weight) & (right[..., 1] >= params.min_child_weight) & (left[..., 2] > 0) & (right[..., 2] > 0) & np.isfinite(value) & (value > params.min_split_gain)
        for f, sign in monotone.items():
            if sign and f not in orders:
                a, b = (np.clip(-s[f, ..., 0] / (s[f, ..., 1] + lam), *bounds) for s in (left, right))
                ok[f] &= sign * (b - a) >= 0
    gain[ok] = value[ok]
    f, b, m = np.unravel_index(int(gain.argmax()), gain.shape)
    if not np.isfinite(gain[f, b, m]):
        return None
    (gl, hl, cl), (gr, hr, cr) = left[f, b, m], right[f, b, m]
    chosen = sorted(orders[f][: b + 1].tolist()) if f in orders else None
    return Split(node, int(f), int(b), bool(m), chosen, float(gain[f, b, m]), float(gl), float(hl), int(cl), float(gr), float(hr), int(cr))
