"""Toxicity by class-conditional Kneser-Ney models of the letters of expressions.

Two models of the next letter after seven, one counted on toxic and one on ordinary
texts, interpolate by absolute discounting with the same lower orders, Kneser-Ney
continuation counts of both classes together. An n-gram that neither class has
seen thus backs off to the same probability in both, and rare expressions carry
little evidence. An expression (a word) scores its length-normalised log-likelihood under
the toxic model less that under the ordinary one; a text is judged by its three
highest expressions, its mean and its length, by a logistic function that is fitted
to texts as models see them that didn't count them. The whole text's mean alone, and
n-grams that run on over the spaces between words, give worse results (README).
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, crc_mod, held, mapped, slices, small_batches

ORDER = 8
#: Codes of letters; ``ORDER`` of them make one number below 2^63.
CODES = 232
_START, _END, _OTHER, _FIRST = 0, 1, 2, 3
_EDGE = "\"'`.,;:!?()[]{}<>«»„“”‘’…*#$%&|~_-+=/\\^"
FEATURES = 5


def expressions(text: str) -> list[str]:
    return text.lower().split()


def code_table(letters: str) -> np.ndarray:
    """Code of each code point: the most frequent letters have one of their own (of
    equals the first by code point), all others share one."""
    count = Counter(letters)
    frequent = sorted(count, key=lambda c: (-count[c], c))[: CODES - _FIRST]
    table = np.full(0x110000, _OTHER, np.uint8)
    table[np.array([ord(c) for c in frequent], np.int64)] = _FIRST + np.arange(len(frequent))
    return table


def grams(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``ORDER`` letters, as numbers, that end at each letter and at
    the end of each word; and the word of each."""
    words = [w.strip(_EDGE) or w for w in words]
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    room = size + ORDER
    ends = np.cumsum(room)
    code = np.full(int(ends[-1]) if len(ends) else 0, _START, np.int64)
    code[ends - 1] = _END
    owner = np.repeat(np.arange(len(words)), size)
    code[np.arange(len(points)) + ORDER * owner + ORDER - 1] = table[points]
    gram = np.zeros(max(len(code) - ORDER + 1, 0), np.int64)
    for j in range(ORDER):
        gram = gram * CODES + code[j : j + len(gram)]
    of = np.repeat(np.arange(len(words)), room)
    inside = of[: len(gram)] == of[ORDER - 1 :] if len(gram) else np.zeros(0, bool)
    return gram[inside], of[: len(gram)][inside]


def _runs(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys of a sorted array, and the sums of the values of each."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v, first, dtype=float) if len(keys) else np.zeros(0) for v in values]


def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


@dataclass
class Model:
    """Log-likelihood ratio of every n-gram that was counted, and of any other letter
    after every context that was seen; the logistic function over the features."""

    table: np.ndarray
    gram: np.ndarray
    ratio: np.ndarray
    context: np.ndarray
    unseen: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -1.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def fit(table: np.ndarray, gram: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, discount: float = 0.75) -> "Model":
        order = np.argsort(gram)
        gram, counts = gram[order], [np.asarray(c)[order] for c in (ordinary, toxic)]
        del order
        # Shared lower orders: continuation counts, from the shortest context up.
        levels = {}
        distinct = gram
        for n in range(ORDER - 1, 0, -1):
            levels[n] = distinct, _ = np.unique(distinct % CODES**n, return_counts=True)
        shared = np.full(len(gram), 1 / CODES)
        for n in range(1, ORDER):
            ending, kinds = levels.pop(n)
            context, total, branch = _runs(ending // CODES, kinds, np.ones(len(kinds)))
            # What the letter adds in this order, and what goes to the lower one.
            own = np.maximum(kinds - discount, 0)
            mine = gram % CODES**n
            shared *= _get(context, discount * branch / np.maximum(total, 1), mine // CODES)
            shared += _get(ending, own / np.repeat(np.maximum(total, 1), branch.astype(np.int64)), mine)
        logs, left = [], []
        for c in counts:
            context, total, branch = _runs(gram // CODES, c, c > 0)
            rest = np.where(total > 0, discount * branch / np.maximum(total, 1), 1.0)
            held_by = np.cumsum(np.r_[False, gram[1:] // CODES != gram[:-1] // CODES])[: len(gram)]
            own = np.maximum(c - discount, 0) / np.maximum(total, 1)[held_by]
            logs.append(np.log(own + rest[held_by] * shared).astype(np.float32))
            left.append(np.log(rest).astype(np.float32))
        return Model(table, gram, logs[1] - logs[0], context, left[1] - left[0])

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio per letter of each word."""
        gram, of = grams(words, self.table)
        if not len(self.gram) or not len(gram):
            return np.zeros(len(words))
        value = _get(self.gram, self.ratio, gram, np.nan)
        miss = np.flatnonzero(np.isnan(value))
        value[miss] = _get(self.context, self.unseen, gram[miss] // CODES)
        return np.bincount(of, value, len(words)) / np.bincount(of, minlength=len(words))

    def features(self, texts: list[str | None]) -> np.ndarray:
        memory = held(("toxicity", self.key), Words)
        cut = [expressions(t or "") for t in texts]
        new = memory.missing(set().union(*cut))
        memory.put(new, self.ratios(new).tolist())
        seen = memory.young
        out = np.zeros((len(texts), FEATURES))
        for i, words in enumerate(cut):
            if n := len(words):
                x = np.fromiter(map(seen.__getitem__, words), float, n)
                k = min(3, n)
                out[i, :k] = np.sort(np.partition(x, n - k)[n - k :])[::-1]
                out[i, 3:] = x.mean(), np.log(n)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        with np.errstate(over="ignore"):
            s = 1 / (1 + np.exp(-(self.features(texts) @ self.weights + self.bias)))
        return np.where([bool(t and t.strip()) for t in texts], s, 0.0)

    def calibrate(self, features: np.ndarray, toxic: np.ndarray, ridge: float = 0.01) -> None:
        """Fit the logistic function (Newton steps, a small ridge)."""
        if len(set(toxic.tolist())) < 2:
            self.weights, self.bias = np.zeros(FEATURES), 2.0 if len(toxic) and toxic[0] else -2.0
            return
        mean, scale = features.mean(0), features.std(0)
        scale[scale < 1e-6] = np.inf  # what is alike in all tells nothing
        x = np.c_[(features - mean) / scale, np.ones(len(features))]
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - toxic) + ridge * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
            w -= np.clip(step, -2, 2)
        self.weights, self.bias = w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_toxic: int = 6000, max_ordinary: int = 12000) -> Model:
    """Fit on labelled rows (``labels``: doc_id, toxic 0 or 1) whose crc32(doc_id)
    modulo 5 is not 0.

    At most ``max_toxic`` and ``max_ordinary`` rows are used, the first by a hash
    of doc_id, which bounds the model too: all their n-grams are counted, each once
    for every text that has it. The logistic function is fitted to both halves of the
    rows, each judged by models of the other half. A doc_id labelled twice is toxic
    if any label says so. Null labels, ids and texts are skipped; without both
    classes every score is the same.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    first = lambda t, n: marked.where(F.col("_toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(1, max_toxic).unionByName(first(0, max_ordinary)).withColumnRenamed("doc_id", "_id")
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", "_toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("_half"))
    small_batches(df.sparkSession)
    rows = rows.persist()
    names = ["c00", "c01", "c10", "c11"]  # by half and class

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "text"):
            found = Counter()
            for t in texts:
                found.update("".join(expressions(t)))
            yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in found], pa.int64()), pa.array(found.values(), pa.int64())], names=["point", "n"])

    often = rows.mapInArrow(letters, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(CODES - _FIRST).collect()
    table = code_table("".join(chr(r.point) for r in often))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            words = [Counter() for _ in names]
            for t, x, half in zip(texts, part.column("_toxic").to_pylist(), part.column("_half").to_pylist()):
                words[2 * half + bool(x)].update(set(expressions(t)))
            every = list(set().union(*words))
            gram, of = grams(every, table)
            n = [np.array([w[b] for b in every], float)[of] if every else np.zeros(0) for w in words]
            order = np.argsort(gram)
            keys, *c = _runs(gram[order], *[x[order] for x in n])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(x.astype(np.int32)) for x in c]], names=["gram", *names])

    counts = rows.mapInArrow(count, "gram long, " + ", ".join(f"{c} int" for c in names)).groupBy("gram").agg(*[F.sum(c).cast("int").alias(c) for c in names])
    found = counts.toArrow()
    gram, c00, c01, c10, c11 = (found.column(c).to_numpy() for c in ["gram", *names])
    del found

    def judged(half: int, model: Model) -> pa.Table:
        """Features of the rows of one half, as a model of the other sees them."""

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([part.column("_toxic"), *[pa.array(c) for c in model.features(texts).T]], names=["toxic", *[f"f{i}" for i in range(FEATURES)]])

        return rows.where(F.col("_half") == half).mapInArrow(judge, "toxic int, " + ", ".join(f"f{i} double" for i in range(FEATURES))).toArrow()

    # Each half is judged by the model that was counted on the other one; one model at
    # a time is in memory.
    seen = []
    for half, (o, t) in enumerate(((c10, c11), (c00, c01))):
        own = o + t > 0
        seen.append(judged(half, Model.fit(table, gram[own], o[own], t[own])))
    rows.unpersist()
    x = pa.concat_tables(seen)
    model = Model.fit(table, gram, c00 + c10, c01 + c11)
    model.calibrate(np.column_stack([x.column(f"f{i}").to_numpy() for i in range(FEATURES)]), x.column("toxic").to_numpy().astype(float))
    return model


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Null texts and texts of white space score 0. Whole texts are scored, very long
    ones alone. Other columns stay as they are, columns with the results' names are
    replaced; repeated rows score alike; an empty table gives an empty one.
    """

    def work(part: pa.RecordBatch, texts: list) -> list[pa.Array]:
        s = model.scores(texts)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return mapped(df, text, work, score="double", predicted="int")
