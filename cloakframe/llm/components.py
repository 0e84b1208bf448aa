"""Connected components of a link table, distributed.

Alternating star contraction: in the large step every node's larger
neighbours, in the small step its smaller ones, are linked to the smallest
neighbour instead. The links stay no more than they were, hubs need no more
than a minimum per node (aggregated before the shuffle) and a join whose hot
keys adaptive execution splits, and every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cloakframe.llm.shared import written

ROUNDS = 60


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a written table, and their number and a sum of their hashes, both observed while they are written."""
    seen = Observation()
    links = links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    return written(links, "links"), tuple(seen.get.values())


def components(links: DataFrame) -> DataFrame:
    """(a, b) long links to (node, component): the smallest node that each linked node reaches.

    Nulls and self-links are ignored, repeated links count once; nodes without
    links aren't returned. Raises a RuntimeError if it doesn't settle, which
    takes a logarithmic number of rounds.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, state = _written(now)
    if not state[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        before = state
        now, state = _written(small)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError("components did not settle")
