"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Every distinct word shingle of a text is a Poisson process. Arrivals fall on random
registers, a register keeps the shingle that arrives first, and a shingle stops as
soon as its next arrival is later than every register's. All rates are 1 however
often a shingle stands in a text: two texts then agree in a register with the
Jaccard similarity of their shingle sets, the one by which pairs are judged. Bands
of registers propose pairs, and the sets of a proposed pair are compared exactly.

No bucket is expanded into all its pairs. Texts with the same shingles are one
member, and buckets with the same members are one bucket. Each bucket is compared
with its central member and the links found are closed to classes. Buckets that
still hold several classes are cut into blocks of bounded size; a task compares two
blocks by sparse and dense products of their sets and hands on only a forest of the
links it finds. Two blocks of a bucket's largest class need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import flat
from .common import give_back, keep_ids, materialise, small_batches
from .graph import components

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_RUN = 1 << 21
#: Bytes of sets of shingles that a task of verification remembers.
_ROOM = 32 << 20
#: Shingles in more rows of a task than this are compared by products of matrices,
#: so many columns at a time.
_RARE, _COLUMNS = 24, 4096


def registers(rows: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int, seed: int = 1) -> np.ndarray:
    """The ProbMinHash registers (n x m, the winning shingles) of ``n`` rows; rows
    without shingles keep zeros. ``rows`` is sorted; the rate of a shingle is
    1 + ln(``count``)."""
    value = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    weight = 1.0 + np.log(count)
    size = np.bincount(rows, minlength=n)
    time, step = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
    with np.errstate(over="ignore"):
        while len(rows):
            # So many arrivals of each shingle at once that a row's registers fill.
            block = np.clip(-(-2 * m // np.maximum(size[rows], 1)), 1, 256)
            ends = np.cumsum(block)
            first = ends - block
            j = np.repeat(step - first, block) + np.arange(ends[-1])
            base = np.repeat(shingle, block)
            x = flat.mix(base + (j + 1 + (seed << 40)).astype(np.uint64) * _GOLD)
            gap = -np.log1p(-(x >> np.uint64(11)).astype(np.float64) * 2.0**-53) / np.repeat(weight, block)
            total = np.cumsum(gap)
            before = np.r_[0.0, total[ends[:-1] - 1]] if len(ends) > 1 else np.zeros(1)
            arrival = total - np.repeat(before - time, block)
            at = np.repeat(rows, block) * m + (flat.mix(x + _GOLD) % np.uint64(m)).astype(np.int64)
            np.minimum.at(value, at, arrival)
            won = arrival == value[at]
            winner[at[won]] = base[won]
            time, step = arrival[ends - 1], step + block
            open_rows = np.unique(rows)
            latest = np.zeros(n)
            latest[open_rows] = value.reshape(n, m)[open_rows].max(1)
            go_on = time < latest[rows]
            rows, shingle, weight, time, step = rows[go_on], shingle[go_on], weight[go_on], time[go_on], step[go_on]
            size = np.bincount(rows, minlength=n)
    return winner.reshape(n, m)


def signatures(df: DataFrame, doc_id: str, text: str, words: int, bands: int, width: int, seed: int) -> DataFrame:
    """(id, k1, k2, n_shingles, bands): the two halves of a hash of the set of
    shingles, its size, and the hash of each band. Null texts have null k1."""
    m = bands * width

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.text_bytes(batch.column(1))
            for a, b in flat.row_runs(offsets, _RUN):
                for a in range(a, b, 4096):
                    part = batch.slice(a, min(b - a, 4096))
                    n = part.num_rows
                    own = offsets[a : a + n + 1]
                    rows, shingle, _ = flat.shingles(*flat.words(data[own[0] : own[-1]], own - own[0]), words)
                    with np.errstate(over="ignore"):
                        k = np.zeros((2, n), np.uint64)
                        if len(rows):
                            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                            for i in (0, 1):
                                k[i][rows[starts]] = np.add.reduceat(flat.mix(shingle ^ np.uint64(0xA5A5A5A5 + i)), starts)
                        won = registers(rows, shingle, np.ones(len(rows)), n, m, seed).reshape(n, bands, width)
                        h = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                        for i in range(width):
                            h = flat.mix(h * _GOLD + won[:, :, i])
                    size = np.bincount(rows, minlength=n)
                    full = size > 0
                    missing = pc.is_null(part.column(1)).to_numpy(zero_copy_only=False)
                    ends = np.r_[0, np.cumsum(full * bands)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(k[0].view(np.int64), mask=missing), pa.array(k[1].view(np.int64), mask=missing), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[full].view(np.int64).ravel()))],
                        names=["id", "k1", "k2", "n_shingles", "bands"],
                    )
        give_back()

    return df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(work, "id long, k1 long, k2 long, n_shingles long, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of at least
    ``least``. ``texts``: (id, text)."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = keep_ids(texts, ends, "id")
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, np.ndarray] = {}  # the sets of latest texts; an id may have several texts
        size = 0

        def shingle_set(key: tuple, data: np.ndarray) -> np.ndarray:
            nonlocal size
            if key not in seen:
                if size > _ROOM:
                    seen.clear()
                    size = 0
                seen[key] = flat.shingles(*flat.words(data, np.array([0, len(data)])), words)[1]
                size += seen[key].nbytes + 200
            return seen[key]

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = [(batch.column(c).to_pylist(), *flat.text_bytes(batch.column(t))) for c, t in (("a", "x"), ("b", "y"))]
            for i in range(batch.num_rows):
                texts = [(ids[i], data[o[i] : o[i + 1]]) for ids, data, o in sides]
                one, two = (shingle_set((key, len(d), d[-32:].tobytes()), d) for key, d in texts)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep[i] = shared > 0 and shared >= least * (len(one) + len(two) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        give_back()

    return both.mapInArrow(work, "a long, b long").distinct()


def block_links(table: pa.Table, least: float) -> pa.Table:
    """A forest (a, b) of the links among the rows (rep, set) of ``table``: rows that
    can reach each other by pairs of a Jaccard similarity of ``least`` or more are
    named with the smallest rep of them."""
    rep = table.column("rep").to_numpy()
    sets = table.column("set").combine_chunks()
    sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
    n, values = np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy()
    count, rows = len(rep), np.repeat(np.arange(len(rep)), n)
    order = np.lexsort((rows, values))
    values, rows = values[order], rows[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    held = np.diff(np.r_[starts, len(values)])
    at, often = np.repeat(np.arange(len(starts)), held), np.repeat(held, held)
    # Rare shingles: all pairs of the rows that hold one, at most _RARE^2 / 2.
    shared = np.zeros(count * count)
    few, few_rows = at[often <= _RARE], rows[often <= _RARE]
    for k in range(1, min(_RARE, len(few))):
        same = few[k:] == few[:-k]
        if not same.any():
            break
        shared += np.bincount(few_rows[:-k][same] * count + few_rows[k:][same], minlength=count * count)
    shared = shared.reshape(count, count)
    # Frequent ones: products of 0/1 matrices, some columns at a time.
    many, many_rows = at[often > _RARE], rows[often > _RARE]
    column = np.cumsum(np.r_[False, many[1:] != many[:-1]]) if len(many) else many
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, (first, first + _COLUMNS)))
        dense = np.zeros((count, _COLUMNS), np.float32)
        dense[many_rows[part], column[part] - first] = 1
        shared += np.triu(dense @ dense.T, 1)
    near = (shared > 0) & (shared >= least * (n[:, None] + n[None] - shared))
    x, y = np.nonzero(near)
    order = np.argsort(rep, kind="stable")
    label = np.empty(count, np.int64)
    label[order] = np.arange(count)
    while True:
        before = label.copy()
        np.minimum.at(label, x, before[y])
        np.minimum.at(label, y, before[x])
        label = np.minimum(label, label[order[label]])
        if (label == before).all():
            break
    root = rep[order[label]]
    return pa.table({"a": root[root != rep], "b": rep[root != rep]})


def within_buckets(rest: DataFrame, texts: DataFrame, words: int, least: float, block: int) -> DataFrame:
    """Links (a, b) that connect, within each bucket of ``rest`` (h, rep, class,
    n_shingles), all that pairs of different classes connect."""
    # A block holds about ``block`` rows, fewer if their texts are long.
    rest = rest.withColumn("weight", 1 + F.col("n_shingles") / F.lit(2000.0))
    sizes = rest.groupBy("h", "class").agg(F.sum("weight").alias("k"))
    sizes = sizes.groupBy("h").agg(F.max(F.struct("k", "class")).alias("m"), F.sum("k").alias("all"))
    blocks = lambda weight: F.ceil(weight / block).cast("int")
    sizes = sizes.select("h", F.col("m.class").alias("main"), blocks(F.col("m.k")).alias("p"), blocks(F.col("all") - F.col("m.k")).alias("q"))
    draw = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    placed = rest.join(sizes, "h").where("q > 0").withColumn("own", F.when(F.col("class") == F.col("main"), draw("p")).otherwise(F.col("p") + draw("q")))
    # Blocks 0..p-1 are of the main class; the second block of a task is not.
    tasks = placed.select("h", "rep", F.col("own"), F.explode(F.when(F.col("own") < F.col("p"), F.sequence(F.col("p"), F.col("p") + F.col("q") - 1)).otherwise(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1))).alias("other"))
    tasks = tasks.select("h", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.text_bytes(batch.column(1))
            for a, b in flat.row_runs(offsets, _RUN):
                rows, shingle, _ = flat.shingles(*flat.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), words)
                ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=b - a))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle.view(np.int64)))], names=["rep", "set"])
        give_back()

    # An id with several texts: they are one document, and the links of each count.
    sets = keep_ids(texts, rest.select("rep").distinct().withColumnRenamed("rep", "id"), "id").mapInArrow(work, "rep long, set array<long>")
    sets = materialise(sets, "sets")
    return tasks.join(sets, "rep").groupBy("h", "i", "j").applyInArrow(lambda table: block_links(table, least), "a long, b long").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, bands: int = 40, width: int = 6, block: int = 512, seed: int = 1) -> DataFrame:
    """(doc_id, class_id, n_shingles) for every row of ``df``; class_id is the
    smallest doc_id of the row's class of near duplicates.

    Classes are the connected components of pairs whose sets of ``words``-word
    shingles have a Jaccard similarity of ``least`` or more, among the pairs that
    share a band. A pair of similarity s shares none with a chance of
    (1 - s^width)^bands, by default 5e-6 at 0.8 and 6e-9 at 0.85, however often its
    shingles repeat. White space separates words; case counts.

    A text of fewer than ``words`` words has one shingle, all its words. Texts
    without words are copies of each other; a null text is like no other; a null
    doc_id has a null class and links nothing. Rows that repeat a doc_id count as
    one document. Other columns of ``df`` don't matter, whatever their names.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id is not null and text is not null")
    signed = materialise(signatures(df, doc_id, text, words, bands, width, seed), "signatures")
    known = signed.where("id is not null and k1 is not null")
    # Copies, and texts of the same shingles, are one member from here on.
    members = materialise(known.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "members")
    held = members.select("rep", "n_shingles", F.explode("bands").alias("h"))
    # Of buckets with the same members one is enough.
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    alike = held.groupBy("h").agg(F.count("*").alias("n"), *marks).where("n > 1").groupBy("n", "x1", "x2").agg(F.min("h").alias("h")).select("h", "n")
    held = materialise(held.join(alike, "h"), "shared")
    # A bucket's centre is the member that meets most others in all its buckets: of
    # copies of one text that text, which is closer to each than they are together.
    met = held.groupBy("rep").agg(F.sum("n").alias("met"))
    top = F.max(F.struct(F.col("met"), (-F.col("rep")).alias("rep"), "n_shingles")).alias("top")
    centres = held.join(met, "rep").groupBy("h").agg(top).select("h", (-F.col("top.rep")).alias("centre"), F.col("top.n_shingles").alias("centre_n"))
    held = materialise(held.join(centres, "h").where("rep <> centre"), "buckets")

    def fits(a: str, b: str):
        """Sizes that allow the similarity."""
        return (F.col(a) >= least * F.col(b)) & (F.col(b) >= least * F.col(a))

    pairs = materialise(held.where(fits("n_shingles", "centre_n")).select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct(), "pairs")
    links = materialise(similarities(pairs, texts, words, least), "links")
    classes = materialise(components(links), "classes")
    # The centres have been compared with all others of their buckets; what is left
    # are buckets whose other members are of several classes.
    named = held.join(classes.select(F.col("id").alias("rep"), F.col("class_id").alias("class")), "rep", "left").select("h", "rep", "n_shingles", F.coalesce("class", "rep").alias("class"))
    several = named.groupBy("h").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).where("c1 <> c2").select("h")
    rest = materialise(named.join(several, "h"), "rest")
    more = materialise(within_buckets(rest, texts, words, least, block), "links")
    classes = materialise(components(links.unionByName(more)), "classes")
    return _named(signed, members, classes, doc_id)


def _named(signed: DataFrame, members: DataFrame, classes: DataFrame, doc_id: str) -> DataFrame:
    classed = members.select("k1", "k2", "n_shingles", F.col("rep").alias("id")).join(classes, "id", "left").select("k1", "k2", F.col("n_shingles").alias("n"), F.coalesce("class_id", "id").alias("class_id"))
    # A copy of a member that has a class; null texts are their own class.
    out = signed.drop("bands").join(classed, (signed.k1 == classed.k1) & (signed.k2 == classed.k2) & (signed.n_shingles == classed.n), "left")
    return out.select(F.col("id").alias(doc_id), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), "n_shingles")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay when one document of each class is kept, the one
    with the smallest doc_id; of rows that repeat its doc_id one stays. Rows with a
    null doc_id or a null text have no duplicates and stay."""
    classes = materialise(near_duplicates(df, doc_id, text, **options), "classes")
    kept = classes.where(F.col(doc_id) == F.col("class_id")).groupBy(doc_id).agg(F.count("*").alias("_rows"))
    kept = materialise(kept, "kept")
    once = keep_ids(df, kept.where("_rows = 1").select(doc_id), doc_id)
    again = keep_ids(df, kept.where("_rows > 1").select(doc_id), doc_id).dropDuplicates([doc_id])
    return once.unionByName(again).unionByName(df.where(F.col(doc_id).isNull()))
