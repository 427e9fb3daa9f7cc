"""Exact Shapley values of trees by their leaf paths, vectorised over rows.

On the path to a leaf, feature i lets a row through or not (o_i), and a share z_i
of the training rows. A leaf of value v gives feature i
v (o_i - z_i) sum_S |S|! (m - 1 - |S|)! / m! prod_{j in S} o_j prod_{j not in S} z_j
over the subsets S of the other features; the sums over subsets of a size are the
coefficients of prod_j (z_j + o_j t).
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..model import Forest, Tree
from .predict import _matrix, check_columns


def paths(tree: Tree) -> list[tuple[float, list[tuple[int, int, bool]]]]:
    """Value and steps (node, feature, left) of every leaf."""
    out, todo = [], [(0, [])]
    while todo:
        n, steps = todo.pop()
        f = int(tree.feature[n])
        if f < 0:
            out.append((float(tree.leaf[n]), steps))
            continue
        todo += [(2 * n + 1, [*steps, (n, f, True)]), (2 * n + 2, [*steps, (n, f, False)])]
    return out


def expected(forest: Forest) -> list[float]:
    """Bias of each class: its base score and its trees' cover-weighted leaves."""
    out = list(map(float, forest.base))
    for t, tree in enumerate(forest.trees):
        for n in tree.reachable():
            if tree.feature[n] < 0 and tree.cover[0] > 0:
                out[t % forest.classes] += tree.leaf[n] * tree.cover[n] / tree.cover[0]
    return out


def tree_contributions(tree: Tree, x: np.ndarray, bins: int) -> np.ndarray:
    """(rows x features) Shapley values of one tree."""
    phi = np.zeros(x.shape)
    left = {n: tree.step(np.full(len(x), n), x, bins) == 2 * n + 1 for n in tree.reachable() if tree.feature[n] >= 0}
    for value, steps in paths(tree):
        zero: dict[int, float] = {}
        one: dict[int, np.ndarray] = {}
        for n, f, is_left in steps:
            kid = 2 * n + (1 if is_left else 2)
            share = tree.cover[kid] / tree.cover[n] if tree.cover[n] > 0 else 0.5
            zero[f] = zero.get(f, 1.0) * share
            one[f] = one.get(f, np.ones(len(x))) * (left[n] == is_left)
        m = len(zero)
        for i in zero:
            poly = np.ones((1, len(x)))
            for j in zero:
                if j != i:
                    grown = np.zeros((len(poly) + 1, len(x)))
                    grown[:-1] = poly * zero[j]
                    grown[1:] += poly * one[j]
                    poly = grown
            weight = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
            phi[:, i] += value * (one[i] - zero[i]) * (weight @ poly)
    return phi


def contributions(forest: Forest, x: np.ndarray) -> np.ndarray:
    """(rows x classes (features + 1)): each class's values and its bias last."""
    n = len(forest.features)
    out = np.zeros((len(x), forest.classes, n + 1))
    out[:, :, n] = expected(forest)
    for t, tree in enumerate(forest.trees):
        out[:, t % forest.classes, :n] += tree_contributions(tree, x, forest.bins)
    return out.reshape(len(x), -1)


def contribution_column(forest: Forest, df: DataFrame) -> Column:
    """ARRAY<DOUBLE> of contributions; they sum to the raw score of each class."""
    check_columns(df, forest.features)

    @pandas_udf("array<double>")
    def shap(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(contributions(forest, _matrix(columns))))

    return shap(*[F.col(f"`{c}`").cast("double") for c in forest.features])
