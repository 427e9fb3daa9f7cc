"""The trained forest and its JSON file."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .params import OBJECTIVES, ModelError

MISSING_LEFT, CATEGORICAL = 1, 2
#: 32-bit words of a category set.
WORDS = 8


@dataclass
class Tree:
    """Heap arrays: the children of node n are 2n + 1 and 2n + 2; feature -1 marks a
    leaf. ``bin`` is the numeric split's bin, ``left`` the categories that go left."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    flags: np.ndarray
    left: dict[int, list[int]]
    gain: np.ndarray
    cover: np.ndarray
    bin: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        z = lambda kind: np.zeros(n, kind)
        return Tree(np.full(n, -1, np.int64), z(float), z(float), z(np.int64), {}, z(float), z(float), z(np.int64))

    @property
    def depth(self) -> int:
        return int(math.log2(len(self.feature) + 1)) - 1

    def reachable(self) -> list[int]:
        """Nodes from the root on, parents first."""
        out, todo = [], [0]
        while todo:
            n = todo.pop(0)
            out.append(n)
            if self.feature[n] >= 0:
                todo += [2 * n + 1, 2 * n + 2]
        return out

    def step(self, node: np.ndarray, x: np.ndarray, bins: int) -> np.ndarray:
        """The next node of each row of raw values (NaN: missing); leaves stay."""
        f = self.feature[node]
        v = x[np.arange(len(x)), np.maximum(f, 0)]
        flags = self.flags[node]
        missing = np.isnan(v)
        left = np.where(missing, (flags & MISSING_LEFT) > 0, v <= self.threshold[node])
        for n in np.unique(node[(flags & CATEGORICAL > 0) & (f >= 0)]):
            at = node == n
            c = v[at]
            known = np.isfinite(c)
            ids = np.where(known, np.rint(np.where(known, c, -1)), -1)
            ids = np.where((ids < 0) | (ids >= bins), bins, ids)  # others are missing
            left[at] = np.isin(ids, self.left.get(int(n), []))
        return np.where(f < 0, node, 2 * node + 2 - left)

    def leaves(self, x: np.ndarray, bins: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = self.step(node, x, bins)
        return node


@dataclass
class Forest:
    """Trees with the base scores; tree t belongs to class t mod K."""

    objective: str
    max_bin: int
    base: list[float]
    features: list[str]
    categorical: list[int]
    trees: list[Tree] = field(default_factory=list)
    labels: list | None = None
    extra: dict = field(default_factory=dict)

    @property
    def classes(self) -> int:
        return len(self.base)

    @property
    def bins(self) -> int:
        return self.max_bin - 1

    def cut(self, rounds: int) -> "Forest":
        return Forest(self.objective, self.max_bin, self.base, self.features, self.categorical, self.trees[: rounds * self.classes], self.labels, self.extra)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Raw scores (rows x classes) of an array of raw values."""
        out = np.tile(np.asarray(self.base, float), (len(x), 1))
        for t, tree in enumerate(self.trees):
            out[:, t % self.classes] += tree.leaf[tree.leaves(x, self.bins)]
        return out

    def importance(self, kind: str = "gain") -> list[float]:
        """Sum of gains, or number of splits, of each feature over reachable nodes."""
        out = [0.0] * len(self.features)
        for tree in self.trees:
            for n in tree.reachable():
                if tree.feature[n] >= 0:
                    out[tree.feature[n]] += float(tree.gain[n]) if kind == "gain" else 1.0
        return out

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The forest as a table of its reachable nodes."""
        rows = [(t, int(n), int(x.feature[n]), float(x.threshold[n]), float(x.leaf[n]), int(x.flags[n]), sorted(x.left.get(n, [])), float(x.gain[n]), float(x.cover[n])) for t, x in enumerate(self.trees) for n in x.reachable()]
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, leaf double, flags int, left_bins array<int>, gain double, cover double")

    def as_json(self) -> dict:
        def words(t: Tree) -> list[int]:
            out = [0] * (WORDS * len(t.feature))
            for n, ids in t.left.items():
                for i in ids:
                    out[n * WORDS + i // 32] |= 1 << (i % 32)
            return out

        trees = [{"feature": t.feature.tolist(), "threshold": t.threshold.tolist(), "leaf": t.leaf.tolist(), "flags": t.flags.tolist(), "catMask": words(t), "gain": t.gain.tolist(), "cover": t.cover.tolist()} for t in self.trees]
        extra = self.extra | ({"labels": self.labels} if self.labels is not None else {})
        return {"version": 1, "objective": OBJECTIVES.index(self.objective), "numBins": self.max_bin, "baseScore": self.base[0], "numFeatures": len(self.features), "categorical": self.categorical, "featureNames": self.features, "trees": trees, "numClasses": self.classes, "baseScores": self.base, "extra": extra}

    @staticmethod
    def from_json(d: dict) -> "Forest":
        if d.get("version") != 1:
            raise ModelError(f"model version {d.get('version')} is not supported")
        k = d.get("numClasses") or 1
        names = d.get("featureNames") or [f"f{i}" for i in range(d["numFeatures"])]
        trees = []
        for t in d["trees"]:
            n = len(t["feature"])
            left = {}
            for i in range(n):
                words = t["catMask"][i * WORDS : (i + 1) * WORDS]
                if ids := [w * 32 + b for w, word in enumerate(words) for b in range(32) if word >> b & 1]:
                    left[i] = ids
            a = lambda key, kind: np.array(t.get(key) or [0] * n, kind)
            trees.append(Tree(a("feature", np.int64), a("threshold", float), a("leaf", float), a("flags", np.int64), left, a("gain", float), a("cover", float), np.zeros(n, np.int64)))
        extra = dict(d.get("extra") or {})
        return Forest(OBJECTIVES[d["objective"]], d["numBins"], list(d.get("baseScores") or [d["baseScore"]] * k), names, list(d["categorical"]), trees, extra.pop("labels", None), extra)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.as_json(), f)

    @staticmethod
    def load(path: str) -> "Forest":
        try:
            with open(path, encoding="utf-8") as f:
                return Forest.from_json(json.load(f))
        except (KeyError, TypeError, IndexError, json.JSONDecodeError) as e:
            raise ModelError(f"{path} is no model file: {e}") from e
