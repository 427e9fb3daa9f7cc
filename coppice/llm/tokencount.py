"""Token counts as a sentencepiece BPE model gives them.

Method: rank-synchronous array merging. Distinct pre-tokens of a run of texts are
held as ragged arrays of symbols, every sequence applies its lowest-rank pair in
the same round (``bpe_core``), and the surviving symbols are counted. Texts are
cut before each run of spaces, which no merge of the model can cross.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_core import PairTable, merge
from .common import Words, held, mapped

#: The letter that stands for a space inside pieces.
BAR = "▁"


def counter(path: str) -> "Counter":
    """The counter of this Python worker: what it has counted serves later tasks."""
    return held(("tokens", path), lambda: Counter(path))


#: Texts whose normalised form shows whether the model's normaliser only marks spaces.
PROBES = ["a", " a  b ", "ﬁ Ａ́é　x", "A\tb\r\n\nc", "①­​\u0000\u001f.", "ẛ̣ ﷺ"]


class Counter:
    """Counts tokens of one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.normalise = model.normalize
        self.plain = all(model.normalize(p) == BAR + p.replace(" ", BAR) for p in PROBES)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in ids]
        if any(BAR in p.lstrip(BAR) for p in pieces):
            raise ValueError(f"{path}: pieces with a space inside are not supported")
        singles = sorted({c for p in pieces for c in p})
        number = {p: i for i, p in enumerate(dict.fromkeys([*singles, *pieces]))}
        known = set(pieces)
        # A single letter that is no piece of its own falls back to its bytes.
        self.cost = np.array([1 if p in known else len(p.encode()) for p in number], np.int64)
        scores = np.array([model.get_score(i) for i in ids])
        rank = np.unique(-scores, return_inverse=True)[1]
        left, right, ranks, merged = [], [], [], []
        for p, r in zip(pieces, rank.tolist()):
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    left.append(number[p[:k]])
                    right.append(number[p[k:]])
                    ranks.append(r)
                    merged.append(number[p])
        self.table = PairTable.build(left, right, ranks, merged, len(number))
        self.points = np.array([ord(c) for c in singles], np.int64)  # sorted; symbol i is the letter i
        line = "" if any("\n" in p for p in pieces) else "\n"
        self.split = re.compile(f"{BAR}+[^{BAR}{line}]*|[^{BAR}{line}]+" + (line and f"|{line}+")).findall
        self.memory = Words()

    def learn(self, words: set[str]) -> dict[str, int]:
        """Number of tokens of the words; what isn't remembered is merged."""
        new = self.memory.missing(words)
        if not new:
            return self.memory.young
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        known = self.points[at] == points
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        lengths = np.array([len(w) for w in new], np.int64)
        owner = np.repeat(np.arange(len(new)), lengths)
        total = np.bincount(owner[~known], size[~known], len(new)).astype(np.int64)
        symbols, kept = merge(self.table, np.where(known, at, -1), lengths)
        owner = np.repeat(np.arange(len(new)), kept)
        whole = symbols >= 0
        total += np.bincount(owner[whole], self.cost[symbols[whole]], len(new)).astype(np.int64)
        self.memory.put(new, total.tolist())
        return self.memory.young

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.split(BAR + text.replace(" ", BAR) if self.plain else self.normalise(text))

    def run(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text; null counts as empty."""
        cut = [self.words(t) for t in texts]
        known = self.learn(set().union(*cut))
        return [sum(map(known.__getitem__, words)) for words in cut]


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``)
    to every row of ``df``; the text itself is left out of the result.

    Null and empty texts have no bytes and no tokens. Very long texts are counted
    whole. Other columns stay as they are, columns with these names are replaced;
    repeated rows are kept; an empty table gives an empty one. The model file must be
    at ``path`` on every executor.
    """

    def work(part: pa.RecordBatch, texts: list) -> list[pa.Array]:
        n = np.array(counter(path).run(texts), np.int64)
        size = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64())
        return [size, pa.array(n), pa.array(n > limit)]

    return mapped(df, text, work, keep_text=False, n_bytes="long", n_tokens="long", over_limit="boolean")
