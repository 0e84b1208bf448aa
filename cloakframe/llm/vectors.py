"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with a cosine of t or more have a squared distance of at most
2(1 - t). They are rotated, so that every block of dimensions holds its share
of it, and split into blocks; in at least one block the squared distance is at
most that block's share of the budget. Each block is range-joined on a grid
over its first coordinate, pairs within the block's budget are verified on the
whole vectors, and a pair counts in the first block that finds it.

Equal vectors are one vector with a weight. Dense cells are dealt into tiles of
bounded size. A tile returns sums of links and a spanning forest of its links,
never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.components import components
from cloakframe.llm.shared import written
from cloakframe.llm.topk import usable

TILE = 2048
SLACK = 1e-6
#: What a squared distance in single precision may be off.
SINGLE = 1e-5


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches by the links (a, b)."""
    low = np.arange(n)
    while len(a):
        was = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == was).all():
            break
    return low


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, blocks: int = 8, within: str = "label") -> DataFrame:
    """Links rows of equal, non-null `within` whose vectors have a cosine of at least `threshold`, in double precision.

    vectors has vec_id (long), embedding and `within`; other columns are
    ignored. Returns vec_id, n_links, component_id, kept, one row per row.
    Vectors that are null, zero, hold null or non-finite components or differ in
    length link with nothing; nor do rows with a null `within` or vec_id (their
    component is their own vec_id). Of rows that share a vec_id the one with the
    greatest label and vector takes part, and its results are those of all of
    them that could take part.
    """
    bare = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(within).alias("label"), F.col("embedding").alias("embedding"))
    able = usable() & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    each = bare.filter(able)
    repeated = not each.groupBy("vec_id").count().filter("count > 1").isEmpty()
    if repeated:
        each = written(each.groupBy("vec_id").agg(F.max(F.struct("label", "embedding")).alias("m")).select("vec_id", "m.label", "m.embedding"), "vectors")
    groups = written(each.groupBy("label", "embedding").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("weight")), "vectors")
    dims = [r[0] for r in groups.select(F.size("embedding").alias("d")).distinct().limit(1000).collect()]
    budget = 2 * (1 - threshold)
    turns = {d: rotation(d) for d in dims}

    def split(dim: int) -> list[np.ndarray]:
        return np.array_split(np.arange(dim), min(blocks, dim))

    def shares(dim: int) -> np.ndarray:
        return np.array([budget * len(s) / dim + SLACK for s in split(dim)])

    def units(raw: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(raw.tolist(), dtype=float)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return x, x @ (turns.get(x.shape[1]) if x.shape[1] in turns else rotation(x.shape[1]))

    def cells(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf.embedding.map(len)):
                _, turned = units(part.embedding)
                for i, s in enumerate(split(dim)):
                    at = np.floor(turned[:, s[0]] / np.sqrt(shares(dim)[i])).astype(int)
                    yield pd.DataFrame({"label": part.label, "dim": dim, "block": i, "cell": at, "rid": part.rid, "weight": part.weight, "embedding": part.embedding})

    kind, vector = (groups.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    placed = groups.mapInPandas(cells, f"label {kind}, dim int, block int, cell long, rid long, weight long, embedding {vector}")
    key = ["label", "dim", "block", "cell"]
    tiles = placed.groupBy(*key).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / TILE)).cast("int").alias("tiles"))
    tiles = written(tiles, "tiles")  # so that the join with a dense cell can be split
    # A row stands in its own cell, and probes its own and the next one.
    sides = placed.withColumn("shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("cell", F.col("cell") + F.greatest(F.col("shift"), F.lit(0)))
    dealt = sides.join(tiles, key).withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    stands = F.col("shift") < 0
    dealt = dealt.select(*key, F.when(stands, F.col("mine")).otherwise(F.col("other")).alias("h"), F.when(stands, F.col("other")).otherwise(F.col("mine")).alias("p"), "shift", "rid", "weight", "embedding")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        home, probe = pdf[pdf["shift"] < 0], pdf[pdf["shift"] >= 0]
        out = []
        if len(home) and len(probe):
            dim, block = int(pdf.dim.iloc[0]), int(pdf.block.iloc[0])
            parts, share = split(dim), shares(dim)
            (x, xt), (y, yt) = units(home.embedding), units(probe.embedding)
            xr, yr = home.rid.to_numpy(), probe.rid.to_numpy()
            s = parts[block]
            xs, ys = xt[:, s], yt[:, s]
            # one product gives all squared distances of the block; single precision is off by far less than its slack
            left = np.hstack([-2 * xs, (xs**2).sum(1)[:, None], np.ones((len(xs), 1))]).astype(np.float32)
            right = np.hstack([ys, np.ones((len(ys), 1)), (ys**2).sum(1)[:, None]]).astype(np.float32)
            next_one = probe["shift"].to_numpy() == 1
            links = np.zeros(len(xr)), np.zeros(len(yr))
            kept_i, kept_j = [], []
            for at in range(0, len(xr), 256):
                i, j = np.nonzero(left[at : at + 256] @ right.T <= np.float32(share[block] + SINGLE))
                i += at
                meet = next_one[j] | (xr[i] < yr[j])
                i, j = i[meet], j[meet]
                each = ((xs[i] - ys[j]) ** 2).sum(1) <= share[block]
                i, j = i[each], j[each]
                good = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
                a, b = i[good], j[good]
                each = np.stack([((xt[a][:, t] - yt[b][:, t]) ** 2).sum(1) <= share[k] for k, t in enumerate(parts[:block])], 1) if block else np.zeros((len(a), 0), bool)
                new = ~each.any(axis=1)
                np.add.at(links[0], a[new], probe.weight.to_numpy()[b[new]])
                np.add.at(links[1], b[new], home.weight.to_numpy()[a[new]])
                kept_i.append(a[new])
                kept_j.append(b[new])
            a, b = (np.concatenate(z) if z else np.empty(0, int) for z in (kept_i, kept_j))
            ids, place = np.unique(np.concatenate([xr, yr]), return_inverse=True)
            low = forest(len(ids), place[a], place[len(xr) + b])
            for r, n in ((xr, links[0]), (yr, links[1])):
                on = n > 0
                out.append(pd.DataFrame({"a": r[on], "b": n[on], "link": False}))
            on = low != np.arange(len(ids))
            out.append(pd.DataFrame({"a": ids[on], "b": ids[low[on]], "link": True}))
        out = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "link": []})
        return out.astype({"a": "int64", "b": "int64", "link": bool})

    found = written(dealt.groupBy(*key, "h", "p").applyInPandas(tile, "a long, b long, link boolean"), "vector-links")
    sums = found.filter("NOT link").groupBy(F.col("a").alias("rid")).agg(F.sum("b").alias("links"))
    classes = groups.select("label", "embedding", "rid", "weight")
    # copies of one vector whose group has another smallest vec_id are linked to it
    comps = components(found.filter("link").select("a", "b")).withColumnRenamed("node", "rid")
    info = classes.join(sums, "rid", "left").join(comps, "rid", "left").select("label", "embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("component_id"))
    rows = bare.withColumn("able", F.coalesce(able, F.lit(False)))
    linked = (each if repeated else rows.filter("able")).join(info, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    if repeated:
        linked = rows.filter("able").select("vec_id").join(linked, "vec_id")
    alone = rows.filter("NOT able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
