"""Near-duplicate documents by one-permutation MinHash.

Every shingle is hashed once; the hash chooses the bin and competes in it.
Empty bins borrow from a bin that holds a value, chosen by a fixed random
sequence per bin (optimal densification). Groups of bins make the band keys.
Documents that share a key are candidates, but only star-shaped: each is
compared with the centre of its bucket. Verified links merge documents into
components, and only buckets that still hold several components are looked at
again: with another centre, and then pair by pair across components. So the
pairs stay few, yet every candidate pair is either verified or known to be in
one component. In buckets of many documents that are alike but not enough, all
pairs would be too many rows: their documents are compared in tiles of bounded
size instead, and a tile returns a spanning forest of its links.

Documents with equal shingle sets are one from the start. Candidates are
confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.components import components
from cloakframe.llm.shared import remove, take_turn, written

#: Entries of a worker's cache of word hashes; it starts afresh when full.
CACHE = 400_000
#: Words of a filter that tells which documents are candidates: 64 bits each, so a megabyte whatever the input.
FILTER_WORDS = 1 << 17


@dataclass(frozen=True)
class Settings:
    """Shingle length in words, similarity in hundredths, bands and bins per band.

    A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** rows) ** bands:
    under 6e-6 for 40 bands of 6.
    """

    words: int = 4
    hundredths: int = 80
    bands: int = 40
    rows: int = 6
    #: Buckets of more documents are compared in tiles, of so many documents a side.
    small: int = 32
    tile: int = 512


class Hasher(dict):
    """From word to hash; makes shingle sets, signatures and keys."""

    def __init__(self, s: Settings):
        super().__init__()
        self.s, self.bins = s, s.bands * s.rows
        rng = np.random.default_rng(20240229)
        self.odd = rng.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
        self.attempts = rng.integers(0, self.bins, (4096, self.bins)).astype(np.uint16)
        self.mult = rng.integers(1 << 62, 1 << 63, (s.bands, s.rows), dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, s.bands, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles; with fewer words than a shingle has, one for all of them; none without words."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(self) > CACHE:
            self.clear()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(self.s.words, len(h))
        out = h[: len(h) - k + 1] * self.odd[0]
        for i in range(1, k):
            out = out + h[i : len(h) - k + 1 + i] * self.odd[i]
        return np.unique(self.mix(out + np.uint64(k)))

    def signature(self, h: np.ndarray) -> np.ndarray:
        """The value of each bin, from sorted hashes."""
        bins = ((h >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bins[first]] = h[first]
        full[bins[first]] = True
        empty, at = np.flatnonzero(~full), 0
        while len(empty) and at < len(self.attempts):
            tried = self.attempts[at : at + 64, empty]
            hit = full[tried]
            found = hit.any(axis=0)
            out[empty[found]] = out[tried[hit.argmax(axis=0), np.arange(len(empty))][found]]
            empty, at = empty[~found], at + 64
        out[empty] = h[0]
        return out

    def keys(self, sig: np.ndarray) -> np.ndarray:
        return self.mix((sig.reshape(self.s.bands, self.s.rows) * self.mult).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)


_hashers: dict[Settings, Hasher] = {}


def hasher(s: Settings) -> Hasher:
    take_turn("minhash", _hashers.clear)
    if s not in _hashers:
        _hashers[s] = Hasher(s)
    return _hashers[s]


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, 128 one-bit values, and the band keys (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = hasher(s)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rows = []
                for text in part.column("text"):
                    h = m.shingles(text.as_py())
                    if not len(h):
                        rows.append((0, 0, 0, 0, 0, np.empty(0, np.int64)))
                        continue
                    sig = m.signature(h)
                    one, two = np.packbits((sig[np.arange(128) % m.bins] & np.uint64(1)).astype(np.uint8)).view(np.int64)
                    full = xxhash.xxh3_128_digest(h)
                    rows.append((len(h), int.from_bytes(full[:8], "little", signed=True), int.from_bytes(full[8:], "little", signed=True), int(one), int(two), m.keys(sig)))
                cols = list(zip(*rows, strict=True))
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in cols[5]])]).astype(np.int32), np.concatenate(cols[5]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:5]], bands], ["doc_id", "n_shingles", "h1", "h2", "s1", "s2", "bands"])

    kind = "doc_id long, n_shingles long, h1 long, h2 long, s1 long, s2 long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def within_reach(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The docs (doc_id, ...) whose id may be among ids (id): a filter of fixed size, with no false negatives."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS * 64))
    bits = ids.select(place("id").alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    marked = docs.withColumn("_p", place("doc_id")).withColumn("word", F.shiftright("_p", 6))
    return marked.join(F.broadcast(bits), "word").filter(F.expr("getbit(bits, cast(_p & 63 as int)) = 1")).drop("_p", "word", "bits")


def sets_of(docs: DataFrame, ids: DataFrame, s: Settings, repeated: bool) -> DataFrame:
    """doc_id and set, the packed hashes of the shingles, of the documents among ids (id) and a few more; one row per text where ids repeat."""
    near = within_reach(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL"), ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = hasher(s)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([m.shingles(t.as_py()).tobytes() for t in part.column("text")], pa.binary())], ["doc_id", "set"])

    sets = near.mapInArrow(run, "doc_id long, set binary")
    return sets.dropDuplicates() if repeated else sets


def verified(pairs: DataFrame, docs: DataFrame, s: Settings, repeated: bool) -> DataFrame:
    """Of pairs (a, b) those whose full shingle sets are alike.

    A centre of a hot bucket is in many pairs: the sets are a written table, so that the joins with them can be split.
    """
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sets = written(sets_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), s, repeated), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= s.hundredths * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    links = written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    remove(sets)
    return links


#: Candidates are left out only where an estimate is so many standard deviations off.
SIGMAS = 7


def alike(x: str, y: str, s: Settings) -> Column:
    """Whether two rows' sizes and one-bit values allow the similarity (but for a chance of 1e-9; short sets have wider bounds)."""
    bits = 128 - F.bit_count(F.col(f"{x}s1").bitwiseXOR(F.col(f"{y}s1"))) - F.bit_count(F.col(f"{x}s2").bitwiseXOR(F.col(f"{y}s2")))
    n, m, p = F.col(f"{x}n"), F.col(f"{y}n"), s.hundredths / 100
    spread = F.sqrt(p * (1 - p) / 4 / F.least(n, m, F.lit(128)) + (1 - p) / 4 / 128)
    return (100 * n >= s.hundredths * m) & (100 * m >= s.hundredths * n) & (bits >= 128 * ((1 + p) / 2 - SIGMAS * spread))


def compared(clusters: DataFrame, docs: DataFrame, s: Settings, repeated: bool) -> DataFrame:
    """Links (a, b) between documents of one cluster: a spanning forest of those across components.

    clusters has rid, cluster, comp. Documents of a cluster are dealt into
    chunks, every two chunks meet in a tile. A tile estimates all its pairs by
    their signatures and confirms the promising ones on the full sets, the most
    alike first, leaving out those that are known to be connected.
    """
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / s.tile).cast("int").alias("chunks"))
    dealt = clusters.join(sizes, "cluster").withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rid", "comp")
    sets = written(sets_of(docs, clusters.select(F.col("rid").alias("id")), s, repeated).withColumnRenamed("doc_id", "rid"), "sets")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        m = hasher(s)
        sets = [np.frombuffer(x, np.uint64) for x in pdf.set]
        sizes = np.array([len(x) for x in sets])
        signs = np.stack([(m.signature(x) & np.uint64(0xFFFF)).astype(np.uint16) if len(x) else np.zeros(m.bins, np.uint16) for x in sets])
        side, same = pdf.mine.to_numpy(), bool((pdf.i == pdf.j).all())
        ids, comp = pdf.rid.tolist(), pdf.comp.tolist()
        first = {c: k for k, c in reversed(list(enumerate(comp)))}
        root = [first[c] for c in comp]

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        p, promising = s.hundredths / 100, []
        for k in range(len(ids)):
            alike = (signs[k + 1 :] == signs[k]).mean(axis=1)
            low, high = np.minimum(sizes[k], sizes[k + 1 :]), np.maximum(sizes[k], sizes[k + 1 :])
            good = (100 * low >= s.hundredths * high) & (alike >= p - SIGMAS * np.sqrt(p * (1 - p) / np.minimum(low, m.bins)))
            if not same:
                good &= side[k + 1 :] != side[k]
            promising += [(-alike[x], k, k + 1 + x) for x in np.flatnonzero(good).tolist() if comp[k] != comp[k + 1 + x]]
        links = []
        for _, a, b in sorted(promising):
            if find(a) != find(b):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= s.hundredths * (sizes[a] + sizes[b] - both):
                    root[find(a)] = find(b)
                    links.append((ids[a], ids[b]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return dealt.join(sets, "rid").groupBy("cluster", "i", "j").applyInPandas(tile, "a long, b long")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Near-duplicate classes of documents (doc_id, text; other columns are ignored).

    Returns one row per row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, itself included), kept (doc_id = component_id).
    Texts that are null, empty or without words have no shingles and link with
    nothing. A row without doc_id links with nothing, has no component and is
    kept. Rows that share a doc_id are one node, with the links of all its texts.
    """
    rows = written(sketches(docs, s), "sketches")
    able = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = able.groupBy("h1", "h2").agg(F.min("doc_id").alias("rid"), *[F.first(c).alias(c) for c in ("n_shingles", "s1", "s2", "bands")])
    often = able.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("h1").alias("low"), F.max("h1").alias("high")).filter("rows > 1")
    repeated = not often.isEmpty()
    each = classes.select(F.explode_outer("bands").alias("key"), F.struct("rid", F.col("n_shingles").alias("n"), "s1", "s2").alias("m"))
    shared = each.groupBy("key").agg(F.min("m").alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    # members of buckets that are shared, with the centre of the first round
    members = written(each.join(shared, "key").select("key", *[F.col(f"m.{x}").alias(x) for x in ("rid", "n", "s1", "s2")], *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("rid", "n", "s1", "s2")]), "members")
    pairs = members.filter((F.col("rid") != F.col("c_rid")) & alike("", "c_", s)).select(F.col("c_rid").alias("a"), F.col("rid").alias("b")).distinct()
    links = verified(pairs, docs, s, repeated)
    if repeated:  # the classes of one document's texts
        several = able.join(often.filter("low <> high").select("doc_id"), "doc_id").select("h1", "h2", "doc_id")
        links = written(links.union(several.join(classes.select("h1", "h2", "rid"), ["h1", "h2"]).select(F.col("rid").alias("a"), F.col("doc_id").alias("b"))), "links")
    comps = components(links)
    own = ["rid", "n", "s1", "s2"]

    def mixed() -> DataFrame:
        """Members of buckets with several components, with their component, the bucket's size, and a centre: the same in all buckets that have it."""
        placed = members.select("key", *own).join(comps.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("component", "rid")).drop("component")
        buckets = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("rid").alias("o"), *own, "comp")).alias("c")).filter("low <> high")
        return written(placed.join(buckets.select("key", "size", *[F.col(f"c.{x}").alias(f"c_{x}") for x in (*own, "comp")]), "key"), "mixed")

    left = mixed()
    pairs = left.filter((F.col("comp") != F.col("c_comp")) & alike("", "c_", s)).select(F.least("rid", "c_rid").alias("a"), F.greatest("rid", "c_rid").alias("b")).distinct()
    more = verified(pairs, docs, s, repeated)
    if not more.isEmpty():
        links = links.union(more)
        comps = components(links)
        left = mixed()
    few, many = left.filter(F.col("size") <= s.small), left.filter(F.col("size") > s.small)
    right = few.select("key", *[F.col(x).alias(f"o_{x}") for x in (*own, "comp")])
    pairs = few.select("key", *own, "comp").join(right, "key").filter((F.col("rid") < F.col("o_rid")) & (F.col("comp") != F.col("o_comp")) & alike("", "o_", s)).select(F.col("rid").alias("a"), F.col("o_rid").alias("b")).distinct()
    more = [verified(pairs, docs, s, repeated)]
    if not many.isEmpty():
        joined = components(many.select(F.col("rid").alias("a"), F.col("c_rid").alias("b")))
        clusters = many.select("rid", "comp").distinct().join(joined.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "comp", F.coalesce("component", "rid").alias("cluster"))
        more.append(written(compared(written(clusters, "clusters"), docs, s, repeated), "links"))
    more = [x for x in more if not x.isEmpty()]
    if more:
        comps = components(reduce(DataFrame.union, more, links))
    found = classes.select("h1", "h2", "rid").join(comps.withColumnRenamed("node", "rid"), "rid", "left").select("h1", "h2", F.coalesce("component", "rid").alias("component_id"))
    found = written(found, "classes")  # a large group of copies is a hot key, which a join of two plain tables can split
    linked = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(found, ["h1", "h2"], "left").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, s: Settings = Settings(words=5)) -> DataFrame:
    """The documents of which `near_duplicates` keeps one for each class, with all their columns."""
    gone = near_duplicates(docs, s).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
