"""Feature selection against shadows: permuted copies that can't carry signal."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import permuted, wang_int
from ..params import DataError, Params
from ..plans.train import Binned, fit
from ..store import store


@dataclass(frozen=True)
class Selection:
    confirmed: list[str]
    tentative: list[str]
    rejected: list[str]
    hits: list[int]
    rounds: int
    gain_ratio: list[float]


def tail(n: int, k: int) -> float:
    """P[B(n, 1/2) >= k]."""
    return sum(comb(n, i) for i in range(max(k, 0), n + 1)) / 2**n


def verdicts(hits: list[int], rounds: int, alpha: float) -> list[str]:
    """Two one-sided binomial tests of each feature, Bonferroni-corrected."""
    cut = alpha / len(hits)
    return ["confirmed" if tail(rounds, h) < cut else "rejected" if tail(rounds, rounds - h) < cut else "tentative" for h in hits]


def shadows(data: Binned, seed: int) -> DataFrame:
    """The binned rows with a permuted copy of every feature behind the real ones,
    each feature with a permutation of its own."""
    n, width = data.n, len(data.features)
    moved = F.array(*[F.struct(permuted(F.col("rid"), n, seed ^ wang_int(f + 1)).alias("rid"), F.lit(f).alias("f"), F.col("bins")[f].alias("b")) for f in range(width)])
    long = data.rows.select(F.explode(moved).alias("x")).select("x.*")
    wide = long.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "b"))), lambda x: x["b"]).alias("shadow"))
    return data.rows.join(wide, "rid").withColumn("bins", F.concat("bins", "shadow")).drop("shadow")


def select_features(data: Binned, params: Params) -> Selection:
    """``selection_rounds`` fits, each on real and freshly permuted features; a
    feature hits if its gain is above every shadow's."""
    features = data.features
    names = [*features, *[f"shadow {c}" for c in features]]
    cats = tuple(c for c in names if c.removeprefix("shadow ") in params.categorical_features)
    own = params.but(n_estimators=params.selection_estimators or min(params.n_estimators, 100), categorical_features=cats, monotone_constraints=(), allowed_features=None, early_stopping_rounds=0, feature_selection=False)
    hits, gains, best = [0] * len(features), [0.0] * len(features), 0.0
    for r in range(params.selection_rounds):
        rows = store(shadows(data, 0x5EED + 7919 * r), "shadows")
        forest, _ = fit(Binned(rows, data.edges * 2, names, own, data.n), own)
        gain = forest.importance("gain")
        top = max(gain[len(features) :])
        hits = [h + (g > top) for h, g in zip(hits, gain)]
        gains = [a + g for a, g in zip(gains, gain)]
        best += top
    said = verdicts(hits, params.selection_rounds, params.selection_alpha)
    pick = lambda v: [c for c, s in zip(features, said) if s == v]
    return Selection(pick("confirmed"), pick("tentative"), pick("rejected"), hits, params.selection_rounds, [g / best if best else 0.0 for g in gains])


def chosen(found: Selection) -> list[str]:
    """The features to keep: the confirmed, else the tentative ones."""
    if not (found.confirmed or found.tentative):
        raise DataError("feature selection rejected every feature")
    return found.confirmed or found.tentative
