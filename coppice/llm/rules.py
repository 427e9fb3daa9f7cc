"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a boolean column, true where a text fails. On a sample of raw texts,
each rule's cost (time per row, with the measures it needs) and selectivity (share of
rows it rejects) are measured; the rules then stand in order of rejections per cost in
one CASE, which stops at the first that fails. The order changes the work, never the
verdict. Measures that are columns of the result are computed for every row all the
same: stopping early saves only what a rule computes beyond them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, unused

_GAP = r"[\x20\x09-\x0D]+"
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``needs``: the measures that ``fails`` reads."""

    name: str
    fails: Column
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejects: float


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP))


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more.

    Windows are sorted by hash with their position, so that equal ones are
    neighbours; each marked position adds the words that the one before doesn't
    cover. Works in n log n within the row."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(at, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(h: Column) -> Column:
        sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marks(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"]))
            marked = F.transform(F.filter(s, lambda x, k: same(k)), lambda x: x["i"])
            add = lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - p[F.greatest(k - 1, F.lit(0))]))), F.lit(0), lambda a, b: a + b)
            return let(F.sort_array(marked), add)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(sorted_, marks))

    return F.when(F.size(words) < 4, 0).otherwise(let(windows, covered))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all
    long) for whole texts; null counts as empty. Columns of these names are replaced."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    symbols = sum([F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in SYMBOLS], F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_counts = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeat")))
    w, l = unused(df, "_w", "_l")
    out = df.drop(*names).withColumns({w: word_counts, l: line_counts, "n_symbols": symbols.cast("long")})
    long = {"n_words": f"{w}.n", "word_chars": f"{w}.chars", "n_lines": f"{l}.n", "n_dup_lines": f"{l}.dup", "n_repeat_words": f"{w}.repeat"}
    return out.withColumns({k: F.col(v).cast("long") for k, v in long.items()}).drop(w, l)


def alone(text: str = "text") -> dict[str, Column]:
    """Each measure by itself, over the raw text."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_words": F.size(words_of(t)),
        "word_chars": F.length(F.array_join(words_of(t), "")),
        "n_symbols": sum([F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in SYMBOLS], F.lit(0)),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": let(words_of(t), repeated_words),
    }


def production_rules(text: str = "text") -> list[Rule]:
    """The rules of the cascade, over the columns of ``measures`` and the text."""
    n, chars = F.col("n_words"), F.col("word_chars")
    capitals = F.length(F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), r"\P{Lu}+", ""))
    return [
        Rule("few_words", n < 50, ("n_words",)),
        Rule("repeated_phrases", 100 * F.col("n_repeat_words") > 50 * n, ("n_repeat_words", "n_words")),
        Rule("many_symbols", 10 * F.col("n_symbols") > n, ("n_symbols", "n_words")),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), ("n_dup_lines", "n_lines")),
        Rule("short_words", chars < 2 * n, ("word_chars", "n_words")),
        Rule("long_words", chars > 15 * n, ("word_chars", "n_words")),
        Rule("capitals", 2 * capitals > chars, ("word_chars",)),
    ]


def measure(sample: DataFrame, rules: list[Rule], text: str = "text", runs: int = 3) -> list[Measured]:
    """Cost and selectivity of each rule on a (persisted, small) sample of raw texts:
    the least time of ``runs`` jobs with the rule's own measures, less that of a job
    without a rule."""
    n = max(sample.count(), 1)
    own = alone(text)

    def timed(r: Rule) -> tuple[float, int]:
        kept = sample.drop(*own).withColumns({k: own[k].cast("long") for k in r.needs}) if r.needs else sample
        job = kept.agg(F.sum(F.coalesce(r.fails, F.lit(False)).cast("long")))
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            rejected = job.first()[0] or 0
            took.append(time.perf_counter() - began)
        return min(took), rejected

    idle, _ = timed(Rule("", F.lit(False)))
    found = [(r, *timed(r)) for r in rules]
    return [Measured(r, max(took - idle, 1e-6) / n, rejected / n) for r, took, rejected in found]


def ordered(found: list[Measured]) -> list[Rule]:
    """Most rejections per cost first; by name where they are equal."""
    return [m.rule for m in sorted(found, key=lambda m: (-m.rejects / max(m.cost, 1e-12), m.rule.name))]


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that fails, null if none; later rules are then
    not evaluated. A rule that is null doesn't fail."""
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        out = out.when(r.fails, F.lit(r.name))
    return out


def cascade(df: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 400) -> DataFrame:
    """Add the measures and ``failed_rule`` (null: kept) by the rules in measured
    order. The sample, the first ``sample_rows`` rows of the first partitions that hold
    them (as ``take`` reads), only decides the order."""
    rows = df.take(sample_rows)
    sample = df.sparkSession.createDataFrame(rows, df.schema).repartition(2).persist()
    try:
        order = ordered(measure(sample, rules, text))
    finally:
        sample.unpersist()
    return measures(df, text).withColumn("failed_rule", verdict(order))


def quality(df: DataFrame, text: str = "text", sample_rows: int = 400) -> DataFrame:
    """``df`` with its measures, ``base_failed``, ``kept`` and ``failed_rule``.

    Null and empty texts have no words and fail. Which of several failing rules is
    named depends on the measured order; ``kept`` doesn't. Repeated rows get the
    same, very long texts are measured whole, an empty table gives an empty one.
    Columns with the names of the results are replaced, others stay. Two 3-word windows
    count as equal if their 64-bit hashes are.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = cascade(df.drop("base_failed", "kept", "failed_rule"), production_rules(text), text, sample_rows)
    return out.withColumns({"base_failed": base, "kept": F.col("failed_rule").isNull() & ~base})
