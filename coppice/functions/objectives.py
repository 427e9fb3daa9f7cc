"""Losses as column expressions: gradients, base scores and links."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..params import DataError, Params

LEAST_HESSIAN = 1e-6


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def gradient(params: Params, score: Column, label: Column, weight: Column | None = None) -> tuple[Column, Column]:
    """First and second derivative of a single-output loss at a raw score."""
    o, a, rho = params.objective, params.alpha, params.tweedie_variance_power
    one = F.lit(1.0)
    if o == "regression":
        g, h = score - label, one
    elif o == "binary":
        p = sigmoid(score)
        spw = F.when(label > 0.5, params.scale_pos_weight).otherwise(1.0)
        g, h = (p - label) * spw, F.greatest(p * (1.0 - p), F.lit(LEAST_HESSIAN)) * spw
    elif o == "mae":
        g, h = F.when(score > label, 1.0).otherwise(-1.0), one
    elif o == "huber":
        g, h = F.greatest(F.lit(-a), F.least(F.lit(a), score - label)), one
    elif o == "quantile":
        g, h = F.when(score > label, 1.0 - a).otherwise(-a), one
    elif o == "poisson":
        mu = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score)))
        g, h = mu - label, F.greatest(mu, F.lit(LEAST_HESSIAN))
    elif o == "tweedie":
        up, down = F.exp((2.0 - rho) * score), F.exp((1.0 - rho) * score)
        g, h = up - label * down, F.greatest((2.0 - rho) * up - (1.0 - rho) * label * down, F.lit(LEAST_HESSIAN))
    else:
        raise ValueError(o)
    return (g, h) if weight is None else (g * weight, h * weight)


def softmax(scores: Column) -> Column:
    """Probabilities of an array of raw scores, shifted by the largest."""
    return F.transform(F.array(scores), lambda s: F.transform(F.array(F.transform(s, lambda x: F.exp(x - F.array_max(s)))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0])[0]


def class_gradient(scores: Column, label: Column, k: int, weight: Column | None = None) -> tuple[Column, Column]:
    """Derivatives of the softmax loss for class ``k``."""
    p = softmax(scores)[k]
    g, h = p - F.when(label == k, 1.0).otherwise(0.0), F.greatest(2.0 * p * (1.0 - p), F.lit(LEAST_HESSIAN))
    return (g, h) if weight is None else (g * weight, h * weight)


def gradient_arrays(params: Params, raw: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``gradient`` (or, of several classes, ``class_gradient``) of raw scores as an
    array (classes x rows)."""
    o, a, rho, score = params.objective, params.alpha, params.tweedie_variance_power, raw[0]
    h = np.ones(len(label))
    with np.errstate(over="ignore"):
        if o == "multiclass":
            e = np.exp(raw - raw.max(0))
            p = e[k] / e.sum(0)
            g, h = p - (label == k), np.maximum(2.0 * p * (1.0 - p), LEAST_HESSIAN)
        elif o == "binary":
            p = 1.0 / (1.0 + np.exp(-score))
            spw = np.where(label > 0.5, params.scale_pos_weight, 1.0)
            g, h = (p - label) * spw, np.maximum(p * (1.0 - p), LEAST_HESSIAN) * spw
        elif o == "poisson":
            mu = np.exp(np.clip(score, -30.0, 30.0))
            g, h = mu - label, np.maximum(mu, LEAST_HESSIAN)
        elif o == "tweedie":
            up, down = np.exp((2.0 - rho) * score), np.exp((1.0 - rho) * score)
            g, h = up - label * down, np.maximum((2.0 - rho) * up - (1.0 - rho) * label * down, LEAST_HESSIAN)
        elif o == "huber":
            g = np.clip(score - label, -a, a)
        elif o in ("mae", "quantile"):
            up, down = (1.0, -1.0) if o == "mae" else (1.0 - a, -a)
            g = np.where(score > label, up, down)
        elif o == "regression":
            g = score - label
        else:
            raise ValueError(o)
    return g * weight, h * weight


def nearest_rank(df: DataFrame, value: str, q: float, rows: int, rid: str = "rid", cap: int = 200_000) -> float:
    """The value at rank min(n - 1, floor(n q)) of every (rows / cap)-th row."""
    step = max(1, rows // cap)
    sample = df.where(F.col(rid) % step == 0).select(F.col(value).alias("v")).where("v is not null")
    n = sample.count()
    if not n:
        raise DataError("no labels")
    at = min(n - 1, math.floor(n * q))
    return sample.orderBy("v").limit(at + 1).agg(F.max("v")).first()[0]


def base_scores(df: DataFrame, params: Params, rows: int) -> list[float]:
    """Raw score before the first tree, from (rid, label, weight); one per class."""
    o = params.objective
    if o == "multiclass":
        found = dict(df.groupBy(F.col("label").cast("int")).agg(F.sum("weight")).collect())
        total = sum(found.values())
        return [math.log((found.get(k, 0.0) + 1.0) / (total + params.num_class)) for k in range(params.num_class)]
    if o in ("mae", "quantile"):
        return [nearest_rank(df, "label", 0.5 if o == "mae" else params.alpha, rows)]
    spw = F.when(F.col("label") > 0.5, params.scale_pos_weight).otherwise(1.0) if o == "binary" else F.lit(1.0)
    top, bottom = df.agg(F.sum(F.col("weight") * spw * F.col("label")), F.sum(F.col("weight") * spw)).first()
    if not bottom:
        raise DataError("weights sum to nothing")
    mean = top / bottom
    if o == "binary":
        p = min(max(mean, 1e-6), 1 - 1e-6)
        return [math.log(p / (1 - p))]
    if o in ("poisson", "tweedie"):
        if mean <= 0:
            raise DataError("a log link needs a positive mean label")
        return [math.log(mean)]
    return [mean]


def link(objective: str, score: Column) -> Column:
    """Predictions of raw scores: means for log links, raw scores otherwise."""
    return F.exp(score) if objective in ("poisson", "tweedie") else score


def probability(objective: str, scores: Column) -> Column:
    """Class probabilities of an array of raw scores (binary: of one)."""
    if objective == "binary":
        p = sigmoid(scores[0])
        return F.array(1.0 - p, p)
    return softmax(scores)
