"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are dealt into lists; an item's score is the sum of its scores
in the lists. First one block of rows in eight gathers the best entries of every
list and resolves those few exactly; the k-th best of them is a cutoff that
no item of the answer can be below, whichever rows it comes from. The cutoff goes
with its query to every block, and an item that reaches it must reach its m-th
part in one of the m lists: only such entries are collected, and only their
scores are summed up exactly.

Queries meet rows in blocks of bounded size, so a task holds one block of each.
The queries, a share of the rows, grow with the table, so they and their cutoffs
are dealt to the blocks by a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.shared import written

ROWS, QUERIES, AT_ONCE = 8192, 1024, 128
#: One block in so many gives the cutoff.
SHARE = 8
FIRST, LAST = -(2**63), 2**63 - 1


def usable(vector: str = "embedding") -> Column:
    """Whether a vector isn't null and holds finite components only."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vectors: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: floats while all sums of products are exact in them, else Python integers."""
    raw = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)
    with np.errstate(over="ignore"):
        out = np.floor(raw * scale)
    if out.size == 0 or np.abs(out).max() ** 2 * out.shape[1] < 2**52:
        return out
    return np.array([[math.floor(x * scale) if abs(x) < 1e15 else int(x) * scale for x in row] for row in raw], dtype=object)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, lists: int = 4) -> DataFrame:
    """The k best rows for each query: query_id, rank (from 1), vec_id, score.

    vectors has vec_id (long) and embedding; other columns are ignored. Vectors
    that are null or hold null or non-finite components, and rows without
    vec_id, take no part. Only vectors of one length are compared. A row with
    the query's vec_id is the query's own; of a query that repeats with other
    vectors the greatest is asked. Ties go to the smaller vec_id. Scores beyond a long are cut to its range.
    """
    rows = vectors.filter(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = written(rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.max("embedding").alias("embedding")), "queries")
    n = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    v, q = max(1, -(-n[0] // ROWS)), max(1, -(-n[1] // QUERIES))
    first = -(-v // SHARE)
    series = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    right = rows.select(F.size("embedding").alias("dim"), series(q).alias("qb"), F.pmod(F.xxhash64("vec_id"), F.lit(v)).cast("int").alias("vb"), "vec_id", "embedding")
    key = ["dim", "qb", "vb"]

    def resolve(left: pd.DataFrame, right: pd.DataFrame, phase: int) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            right = right.sort_values("vec_id", kind="stable")
            items, a, b = right.vec_id.to_numpy(), scaled(right.embedding, scale), scaled(left.asked, scale)
            if a.dtype != b.dtype or a.size and float(abs(a).max()) * float(abs(b).max()) * a.shape[1] >= 2**52:
                a, b = ([[int(x) for x in r] for r in m] for m in (a, b))
                a, b = np.array(a, dtype=object), np.array(b, dtype=object)
            dims = np.array_split(np.arange(a.shape[1]), lists)
            cut = left.cutoff.to_numpy() if phase else None
            for at in range(0, len(left), AT_ONCE):
                part = b[at : at + AT_ONCE]
                each = [part[:, d] @ a[:, d].T if len(d) else np.zeros((len(part), len(a))) for d in dims]
                for i in range(len(part)):
                    query = int(left.query_id.iloc[at + i])
                    others = items != query
                    if phase:
                        # score >= cutoff needs one list with m * partial >= cutoff
                        hit = np.zeros(len(items), bool)
                        for s in each:
                            hit |= (s[i] * lists >= int(cut[at + i])).astype(bool)
                        found = np.flatnonzero(hit & others)
                    else:
                        free = np.flatnonzero(others)
                        found = np.unique(np.concatenate([free[_best(s[i][free], k)] for s in each]))
                    total = sum(s[i][found] for s in each)
                    if total.dtype == object:
                        total = np.array([max(FIRST, min(LAST, x)) for x in total], dtype=object)
                    for j in _best(total, k):
                        score = int(total[j])
                        if not phase or score >= int(cut[at + i]):
                            out.append((query, int(items[found[j]]), score))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def phase(queries: DataFrame, number: int) -> DataFrame:
        left = queries.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(q)).cast("int").alias("qb"), series(v if number else first).alias("vb"), "query_id", F.col("embedding").alias("asked"), *["cutoff"][: number])
        own = right if number else right.filter(F.col("vb") < first)
        found = left.groupBy(*key).cogroup(own.groupBy(*key)).applyInPandas(lambda x, y: resolve(x, y, number), "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    kth = phase(asked, 0).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    cutoff = written(kth.select("query_id", F.when(F.col("n") == k, F.col("least")).otherwise(FIRST).alias("cutoff")), "cutoff")
    return phase(asked.join(cutoff, "query_id"), 1).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
