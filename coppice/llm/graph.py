"""Connected components of a distributed list of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, class_id) for every id in ``links`` (columns a, b, both long); class_id
    is the smallest id that can be reached. Null ends are ignored, repeated links
    and loops do no harm.

    Each round hangs larger neighbours of an id on its smallest one (large star)
    and then smaller ones (small star), until each class is a star. Minima are
    pre-aggregated before the shuffle; the join back is left to the skew-aware
    shuffled join, so that an id with very many links is no single task. Rounds grow
    with the logarithm of the longest chain; a search that does not end within
    ``rounds`` raises, it never hands out split classes.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialise(edges, "edges")
    state = None
    for turn in range(rounds + 1):
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        if turn == rounds:
            raise RuntimeError(f"classes did not settle within {rounds} rounds")
        state = tuple(found)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = materialise(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges"
        )
    return edges.select(F.col("a").alias("id"), F.col("b").alias("class_id")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("class_id"))).distinct()
