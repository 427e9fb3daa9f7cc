"""Byte-level BPE: encode whole texts to ids and decode them again.

Method: batched merge rounds (``bpe_core``). Texts are cut by the GPT-2 pattern;
each distinct piece is merged once for a run of texts and remembered within the
task (a bounded memory), and the texts are put together from these.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe_core import PairTable, merge
from .common import Words, held, mapped

#: Fixed value: the pattern that the byte-level pre-tokenizer splits text by; its
#: white space is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same pattern for texts of letters below U+0250 only, which the quicker
#: ``re`` can take: there \p{L}, \p{N} and White_Space are these ranges.
LATIN = ("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0")


def codec(path: str) -> "Codec":
    """The codec of this Python worker: what it has encoded serves later tasks."""
    return held(("bpe", path), lambda: Codec(path))


def latin_pattern() -> str:
    letter, number, space = LATIN
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """One byte-level BPE vocabulary, from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = {spec["model"]["type"], spec["pre_tokenizer"]["type"], spec["decoder"]["type"]}
        if kinds != {"BPE", "ByteLevel"} or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level BPE without a normaliser or prefix space is supported")
        vocab, letters = spec["model"]["vocab"], byte_letters()
        bytes_of = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.table = PairTable.build([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs], size)
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.token_bytes = [b""] * size
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(bytes_of[c] for c in t)
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.split_any, self.split_latin = regex.compile(PATTERN).findall, re.compile(latin_pattern()).findall
        self.beyond_latin = re.compile("[\u0250-\U0010ffff]").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.number_text = [str(i) for i in range(size)]
        self.memory = Words(value_bytes=220)

    def split(self, text: str) -> list[str]:
        return (self.split_any if self.beyond_latin(text) else self.split_latin)(text)

    def pieces(self, text: str) -> list[str]:
        """The text's pre-tokens; special strings stand alone."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split(text)
        return [p for part in self.cut(text) for p in ([part] if part in self.special else self.split(part))]

    def learn(self, words: set[str]) -> dict[str, tuple[str, bytes]]:
        """Ids and decoded bytes of the words; what isn't remembered is merged."""
        new = self.memory.missing(words)
        if new:
            raw = [b"" if w in self.special else w.encode("utf-8", "surrogatepass") for w in new]
            symbols, lengths = merge(self.table, self.first[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(r) for r in raw], np.int64))
            flat, ends = symbols.tolist(), np.cumsum(lengths).tolist()
            start, number, data, values = 0, self.number_text, self.token_bytes, []
            for w, end in zip(new, ends):
                ids = flat[start:end] or [self.special[w]]
                values.append((",".join([number[i] for i in ids]), b"".join([data[i] for i in ids])))
                start = end
            self.memory.put(new, values)
        return self.memory.young

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text; null counts as empty."""
        ids = next(self.run([text]))[1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")

    def run(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, ids as decimals joined by commas, and the
        text decoded from them."""
        cut = [self.pieces(t or "") for t in texts]
        known = self.learn(set().union(*cut))
        for words in cut:
            both = [known[w] for w in words]
            ids = ",".join([x for x, _ in both])
            yield ids.count(",") + 1 if ids else 0, ids, b"".join([x for _, x in both]).decode("utf-8", "replace")


def encode_documents(df: DataFrame, path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Add the encoding of ``text`` to every row of ``df``.

    Columns added: ``n_tokens`` and, with ``digest``, ``ids_sha256`` and
    ``decoded_sha256``; otherwise ``ids`` (array<int>) and ``decoded``.

    Null and empty texts have no ids and decode to ''. Very long texts are
    encoded whole; a run of texts is at most some MB unless one text is longer.
    Other columns stay as they are, columns with these names are replaced. Repeated
    rows are kept; an empty table gives an empty one. The vocabulary file must be at
    ``path`` on every executor.
    """
    kinds = {"n_tokens": "long"} | ({"ids_sha256": "string", "decoded_sha256": "string"} if digest else {"ids": "array<int>", "decoded": "string"})

    def work(part: pa.RecordBatch, texts: list) -> list[pa.Array]:
        n, ids, decoded = zip(*codec(path).run(texts))
        if digest:
            more = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded])]
        else:
            more = [pa.array([[int(i) for i in x.split(",")] if x else [] for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        return [pa.array(n, pa.int64()), *more]

    return mapped(df, text, work, **kinds)
