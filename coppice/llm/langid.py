"""Language of a text by a bidirectional gated recurrent network over bytes.

The network (one gate a unit: the minimal gated unit) reads running text in both
directions and labels every position with a language; a text pools the probabilities
of all its positions. It is trained in numpy by backpropagation through time. Texts
are read in windows that overlap: of each only the positions count that have
``EDGE`` bytes of their text, or its end, on both sides. Nothing is remembered
between texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, mapped, slices

#: Bytes of a window whose labels count, and those read before and after them.
CORE, EDGE = 200, 12
#: Windows that the network reads at once.
BATCH = 2048

_LETTER = re.compile(r"[^\W\d_]").search


def normal(text: str | None) -> bytes:
    """Small letters in UTF-8, white space as single spaces, one at either end."""
    return f" {' '.join((text or '').lower().split())} ".encode("utf-8", "surrogatepass").replace(b"\0", b" ")


def windows(texts: list[bytes], core: int = CORE, edge: int = EDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (steps x windows; 0 outside the text), how many positions of each count,
    and the text of each; the windows' cores cover every text exactly once."""
    size = np.array([len(t) for t in texts], np.int64)
    gap = edge + core
    data = np.frombuffer(b"\0" * edge + b"".join([t + b"\0" * gap for t in texts]), np.uint8)
    begin = edge + np.cumsum(size + gap) - (size + gap)
    n = -(-size // core)
    of = np.repeat(np.arange(len(texts)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[of] + core * step
    # Of the text after the core only ``edge`` bytes are read, of the next text none.
    at = start[None] + np.arange(-edge, core + edge)[:, None]
    return data[at], np.minimum(core, size[of] - core * step), of


@dataclass
class Network:
    """Weights by name. Per direction (f, b): input tables of the gate and of the new
    state (256 x hidden), recurrent matrices of both; an output layer over both."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(langs: list[str], hidden: int, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        normal_ = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        w = {}
        for d in "fb":
            w |= {f"z{d}": 0.5 + normal_(256, hidden, s=0.1), f"n{d}": normal_(256, hidden, s=0.3), f"u{d}": normal_(hidden, hidden, s=0.25 * hidden**-0.5), f"v{d}": normal_(hidden, hidden, s=hidden**-0.5)}
        w |= {"o": normal_(2 * hidden, len(langs), s=(2 * hidden) ** -0.5), "c": np.zeros(len(langs), np.float32)}
        return Network(langs, w)

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps x windows x hidden) over bytes in a direction's order. The
        gate is clipped to 0 .. 1 instead of squashed."""
        tz, tn, u, v = (self.w[k + d] for k in "znuv")
        states = np.empty((*x.shape, v.shape[0]), v.dtype)
        h = np.zeros(states.shape[1:], v.dtype)
        z, n, m = np.empty_like(h), np.empty_like(h), np.empty_like(h)
        for t in range(len(x)):
            np.take(tz, x[t], 0, out=z, mode="clip")
            np.matmul(h, u, out=m)
            z += m
            np.clip(z, 0, 1, out=z)
            np.multiply(z, h, out=m)
            np.take(tn, x[t], 0, out=n, mode="clip")
            n += m @ v
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z.copy(), n.copy()))
            n -= h
            n *= z
            np.add(h, n, out=states[t])
            h = states[t]
        return states

    def label(self, x: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States of both directions, and each position's probabilities."""
        f = self._run("f", x, None if keep is None else keep.setdefault("f", []))
        b = self._run("b", x[::-1], None if keep is None else keep.setdefault("b", []))[::-1]
        half = f.shape[2]
        p = f.reshape(-1, half) @ self.w["o"][:half]
        p += b.reshape(-1, half) @ self.w["o"][half:]
        p += self.w["c"]
        np.clip(p, -40, 40, out=p)
        np.exp(p, out=p)
        p /= p @ np.ones((p.shape[1], 1), p.dtype)
        return f, b, p.reshape(*x.shape, -1)

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Sum over each text's positions of each language's probability."""
        out = np.zeros((len(texts), len(self.langs)))
        x, size, of = windows(texts)
        for a in range(0, len(of), BATCH):
            part = slice(a, a + BATCH)
            p = self.label(np.ascontiguousarray(x[:, part]).astype(np.intp))[2][EDGE : EDGE + CORE]
            if (short := np.flatnonzero(size[part] < CORE)).size:
                p[:, short] *= (np.arange(CORE)[:, None] < size[part][short])[:, :, None]
            total = p.sum(0, dtype=np.float64)
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(of[part], total[:, k], len(texts))
        return out

    def step(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions within texts, and its gradients by
        backpropagation through time."""
        keep: dict = {}
        x = x.astype(np.intp)
        f, b, p = self.label(x, keep)
        live = (x > 0).astype(f.dtype)
        count = max(live.sum(), 1)
        columns = np.arange(x.shape[1])
        picked = p[:, columns, label]
        loss = float(-(np.log(picked + 1e-12) * live).sum() / count)
        d = p.copy()
        d[:, columns, label] -= 1
        d *= (live / count)[:, :, None]
        half = f.shape[2]
        flat = d.reshape(-1, d.shape[2])
        grad = {"o": np.concatenate([f.reshape(-1, half).T @ flat, b.reshape(-1, half).T @ flat]), "c": flat.sum(0)}
        for name, part, xs, back in (("f", slice(0, half), x, d), ("b", slice(half, None), x[::-1], d[::-1])):
            u, v, dh_all = self.w[f"u{name}"], self.w[f"v{name}"], back @ self.w["o"][part].T
            du, dv = np.zeros_like(u), np.zeros_like(v)
            dz_all, dn_all = np.empty_like(dh_all), np.empty_like(dh_all)
            dh = np.zeros_like(dh_all[0])
            for t in range(len(xs) - 1, -1, -1):
                h, z, n = keep[name][t]
                dh = dh + dh_all[t]
                dn = dh * z * (1 - n * n)
                dm = dn @ v.T
                dz = (dh * (n - h) + dm * h) * ((z > 0) & (z < 1))
                dv += (z * h).T @ dn
                du += h.T @ dz
                dz_all[t], dn_all[t] = dz, dn
                dh = dh * (1 - z) + dm * z + dz @ u.T
            order = np.argsort(xs.ravel(), kind="stable")
            byte = xs.ravel()[order]
            first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            for key, all_ in (("z", dz_all), ("n", dn_all)):
                table = np.zeros_like(self.w[key + name])
                table[byte[first]] = np.add.reduceat(all_.reshape(-1, half)[order], first)
                grad[key + name] = table
            grad |= {f"u{name}": du, f"v{name}": dv}
        return loss, grad

    def fit(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> float:
        """Adam over batches of windows drawn by weight; the last loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = np.nan
        for i, part in enumerate(rng.choice(x.shape[1], size=(steps, batch), p=weight / weight.sum()), 1):
            loss, grad = self.step(x[:, part], label[part])
            pace = rate * min(1.0, 2.0 * (1 - i / (steps + 1)))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.w[k] -= (pace * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(self.w[k].dtype)
        return loss

    def pool(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and pooled probability of each text; ``und`` and 0 for a null
        text or one without a letter, and if the network knows no language."""
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        own = [i for i, t in enumerate(texts) if t and _LETTER(t)] if self.langs else []
        read = [normal(texts[i]) for i in own]
        if own:
            total = self.sums(read)
            best = total.argmax(1)
            score[own] = np.minimum(1.0, total[np.arange(len(own)), best] / np.array([len(b) for b in read]))
            for i, k in zip(own, best.tolist()):
                lang[i] = self.langs[k]
        return lang, score


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 400, windows_per_doc: int = 8, span: int = 56, hidden: int = 8, steps: int = 150, batch: int = 256, rate: float = 0.02, seed: int = 1) -> Network:
    """Fit on rows with a text and a language whose crc32(doc_id) modulo 4 is not 2.

    The sample: documents of a language are drawn by a hash with the chance that
    gives ``docs_per_lang`` of them (all, if fewer), and of each ``windows_per_doc``
    windows of ``span`` bytes, spread evenly over the whole text. A batch draws all
    languages alike. Null languages, ids and texts are skipped; rows that repeat a
    doc_id are drawn by their texts; without any row all texts are ``und``.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null").where(crc_mod("doc_id", 4) != 2)
    counts = dict(rows.groupBy("lang").count().collect())
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))])[F.col("lang")] if counts else F.lit(0.0)
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(unit < chance).select("text", "lang")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found, label = [], []
            for t, l in zip(texts, part.column("lang").to_pylist()):
                if _LETTER(t):
                    b = b"\0" * EDGE + normal(t) + b"\0" * max(EDGE, span - len(t))
                    for a in sorted({round(k * (len(b) - span) / windows_per_doc) for k in range(windows_per_doc)}):
                        found.append(b[a : a + span])
                        label.append(l)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    table = drawn.mapInArrow(work, "lang string, window binary").toArrow().to_pandas().sort_values(["lang", "window"])
    langs = sorted(table.lang.unique())
    net = Network.fresh(langs, hidden, seed)
    if langs:
        x = np.frombuffer(b"".join(table.window), np.uint8).reshape(-1, span).T
        label = table.lang.map({l: i for i, l in enumerate(langs)}).to_numpy(np.int64)
        net.fit(np.ascontiguousarray(x), label, 1.0 / np.bincount(label)[label], steps, batch, rate, seed)
    return net


def identify(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (0 to 1) of each whole text.

    A null text, and one without a letter, is ``und`` with score 0; of equal sums the
    first language by name is taken. Very long texts are read whole, some MB at a
    time. Other columns stay as they are, columns with the results' names are
    replaced, repeated rows get the same, an empty table gives an empty one.
    """

    def work(part: pa.RecordBatch, texts: list) -> list[pa.Array]:
        lang, score = net.pool(texts)
        return [pa.array(lang, pa.string()), pa.array(score)]

    return mapped(df, text, work, lang_pred="string", score="double")
