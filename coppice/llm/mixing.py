"""Mixing sources to target weights by Poisson replication, in DataFrame
expressions only.

A source's repetition rate is its share of the target over its share of the text.
Each document's number of copies is a Poisson variable with that mean, inverted
at a uniform number that a hash of the document's id and the seed gives; copies
are then dealt and sorted by another hash, a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import hashed_unit

#: Up to so many sources, the table of rates (some 500 bytes each) is broadcast.
BROADCAST_SOURCES = 10_000
#: A Poisson mean above this is the sum of several smaller ones.
PART = 32.0
_SALTS = 64
#: Up to so many repeated ids are listed in the plan.
LISTED = 10_000


def rates(df: DataFrame, weights: dict[str | None, float] | None, epochs: float, source: str, text: str) -> DataFrame:
    """(_source, rate): the mean number of copies of a document of each source, so
    that the source's expected characters are its weight's part of ``epochs`` times
    all characters. Without ``weights`` all sources weigh the same; a source that
    they don't name gets 0, as does one without any text."""
    sizes = df.groupBy(F.col(f"`{source}`").alias("_source")).agg(F.sum(F.length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        table = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_name string, weight double")
        weighed = sizes.join(table, F.col("_source").eqNullSafe(F.col("_name")), "left").drop("_name").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    rate = F.col("weight") / F.col("all_weight") * F.lit(float(epochs)) * F.col("all_size").cast("double") / F.col("size").cast("double")
    return weighed.join(F.broadcast(total)).select("_source", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(0.0).alias("rate"))


def cumulative(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ... as an array, until what is
    left is below the step of the uniform numbers."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def more(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, more, lambda s: s["c"])


def draw_key(own: DataFrame, doc_id: str) -> Column:
    """The text by which a row draws: its id, where no other row has it; else the id and
    the row's place in the table as it is read. Beyond ``LISTED`` repeated ids every row
    draws by its place too."""
    again = own.groupBy(doc_id).agg(F.count("*").alias("n")).where("n > 1")
    found = [r[0] for r in again.select(doc_id).limit(LISTED + 1).collect()]
    plain = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    if not found:
        return plain
    placed = F.concat(plain, F.lit("#"), F.monotonically_increasing_id().cast("string"))
    if len(found) > LISTED:
        return placed
    named = [x for x in found if x is not None]
    repeated = F.col(doc_id).isin(named) if named else F.lit(False)
    if None in found:
        repeated = repeated | F.col(doc_id).isNull()
    return F.when(F.coalesce(repeated, F.lit(False)), placed).otherwise(plain)


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1) -> DataFrame:
    """The rows of ``df``, each as often as its Poisson count says, shuffled
    globally; with ``copy_no`` (1, 2, ...), ``rate`` and ``shuffle_key``.

    A null source is a source of its own. A document with a null or empty text is
    replicated like others of its source, a very long one too. Of rows that repeat a
    doc_id (or have none) each draws for itself, by its place in the table as well. An
    empty table gives an empty one. Columns of ``df`` named copy_no, rate or
    shuffle_key are replaced; others may have any names.
    """
    own = df.drop("copy_no", "rate", "shuffle_key")
    names = own.columns
    at = lambda c: f"c{next(i for i, n in enumerate(names) if n.lower() == c.lower())}"
    doc_id, source, text = at(doc_id), at(source), at(text)
    own = own.toDF(*[f"c{i}" for i in range(len(names))])
    shown = own.columns
    own = own.withColumn("_key", draw_key(own, doc_id))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    table = rates(own, weights, epochs, source, text).withColumn("_parts", parts).withColumn("_cdf", cumulative(F.col("rate") / F.col("_parts")))
    if table.count() <= BROADCAST_SOURCES:
        joined = own.join(F.broadcast(table), F.col(f"`{source}`").eqNullSafe(F.col("_source")))
    else:
        # Many sources: a shuffled join, over salts so that a large source is spread.
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        rows = own.withColumn("_row_salt", F.pmod(F.xxhash64("_key"), F.lit(_SALTS)).cast("int"))
        joined = rows.join(salted, F.col(f"`{source}`").eqNullSafe(F.col("_source")) & (F.col("_row_salt") == F.col("_salt"))).drop("_salt", "_row_salt")
    one = lambda j: F.size(F.filter(F.col("_cdf"), lambda c: c <= hashed_unit(F.col("_key"), F.lit(seed), j)))
    # One uniform number for a mean up to PART, one for each part beyond.
    u = hashed_unit(F.col("_key"), F.lit(seed), F.lit(1))
    single = F.aggregate(F.col("_cdf"), F.struct(u.alias("u"), F.lit(0).alias("n")), lambda s, c: F.struct(s["u"].alias("u"), (s["n"] + (c <= s["u"]).cast("int")).alias("n")), lambda s: s["n"])
    several = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_parts")), one), F.lit(0), lambda a, b: a + b)
    counted = joined.withColumn("_n", F.when(F.col("_parts") == 1, single).otherwise(several)).where("_n > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    keyed = copies.withColumn("shuffle_key", hashed_unit(F.col("_key"), F.lit(seed), F.lit("order"), F.col("copy_no")))
    out = keyed.select(*shown, "copy_no", "rate", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key").toDF(*names, "copy_no", "rate", "shuffle_key")
