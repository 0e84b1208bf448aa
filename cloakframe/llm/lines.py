"""Line deduplication by an exact set-similarity join, in DataFrame operations alone.

A line's tokens are its distinct lower-cased words, ordered by rarity. Two
lines with a Jaccard similarity of t share a token in their prefixes of
n - ceil(t n) + 1 tokens; candidates must also agree in length, leave room
behind the common token's positions, and pass a 128-bit bitmap bound on their
overlap. What passes is verified on the whole sets. A line with an earlier
match, in order of (doc_id, line), is removed.

Rarity comes from a table of word counts by hash, of fixed size, so that it fits
into the plan whatever the vocabulary; any fixed order gives the same
result, a truer one shorter lists. Lines with equal sets are one from the
start. Large groups of similar lines are thinned out before the join: each line is
first compared with the most alike of some early lines that share one of three
of its prefix tokens, and only lines that found no match there go on to look at
every earlier candidate.

A line's place is (d, at): its doc_id, and its number before a hash of its
document's text where ids repeat, so that rows that share one keep their own lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.minhash import within_reach
from cloakframe.llm.shared import release, remove, setting, unused, written

#: Counters of the rarity table, ranks for each doubling of a counter, and the bits of a token below its rank.
COUNTERS, STEPS, HASH_BITS = 1 << 17, 2, 56
#: White space beside the space and the line feed.
OTHER_SPACE = "\t\x0b\x0c\r"
STARS = 3
#: Tokens of a line up to which 64 bits tell enough.
LONG = 64
#: Centres of a token, a power of two.
WAYS = 8
#: Lines (16 bytes each) that may be sent to every task; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Passes of the prefix join, each over the tokens of one remainder: only one pass's rows are on disk at a time.
PASSES = 2


@dataclass(frozen=True)
class Settings:
    """Jaccard similarity in hundredths; lines with fewer distinct words are left alone."""

    hundredths: int = 80
    least_words: int = 1


def spaced(text: Column) -> Column:
    """The text in lower case, its words apart by spaces and its lines by line feeds alone."""
    other = reduce(Column.__or__, [text.contains(c) for c in OTHER_SPACE])  # tests of bytes; a pattern takes several times that
    return F.lower(F.when(other, F.translate(text, OTHER_SPACE, " " * len(OTHER_SPACE))).otherwise(text))


def mark(text: Column) -> Column:
    """What tells apart the texts of rows that share a doc_id: 32 bits of a hash."""
    return F.hash(text).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def lines_of(docs: DataFrame, marks: bool) -> DataFrame:
    """d, at and line (spaced) of each line of documents with an id; without `marks` for documents of which no two have the same."""
    own = mark(F.col("text")) if marks else F.lit(0).cast("long")
    whole = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("d"), own.alias("mark"), F.posexplode_outer(F.split(spaced(F.col("text")), "\n")).alias("l", "line"))
    return whole.select("d", F.shiftleft(F.col("l").cast("long"), 32).bitwiseOR(F.col("mark")).alias("at"), "line")


def counter(h: Column) -> Column:
    return h.bitwiseAND(F.lit(COUNTERS - 1))


def hashed(lines: DataFrame) -> DataFrame:
    """d, at and w, the hashes of each line's distinct words."""
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    return lines.select("d", "at", F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit(""))).alias("w"))


def numbers(values: list[int]) -> Column:
    """An array literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def ranked(words: DataFrame) -> Column:
    """The rank of each counter by the number of lines that hold its words, rarest first, on a logarithmic scale: an array literal of COUNTERS numbers."""
    rows = words.select(F.explode("w").alias("w")).groupBy(counter(F.col("w")).alias("c")).agg(F.floor(STEPS * F.log2(F.count(F.lit(1)))).cast("int").alias("r"))
    with setting(words.sparkSession, "spark.sql.codegen.aggregate.fastHashMap.capacityBit", COUNTERS.bit_length() - 1):  # the fast map of a task holds half as many groups otherwise, and the rest go to the slow one
        counts = rows.toArrow()  # rows as Python objects would take several times that
    ranks = np.zeros(COUNTERS, np.int64)
    ranks[counts["c"].to_numpy()] = counts["r"].to_numpy()
    return numbers(ranks.tolist())


def rarity(docs: DataFrame) -> Column:
    """The ranks of the documents' words."""
    return ranked(hashed(lines_of(docs, False)))


def tokens(words: DataFrame, ranks: Column) -> DataFrame:
    """d, at and t, the sorted tokens of each line's words, a token being its counter's rank before its hash.

    Tokens must not be nullable: Spark sorts such arrays as objects, otherwise as plain numbers.
    """
    token = lambda h: F.coalesce(F.shiftleft(ranks[counter(h)], HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS)), F.lit(0).cast("long"))
    return words.select("d", "at", F.sort_array(F.transform("w", token)).alias("t"))


def with_sets(lines: DataFrame, ranks: Column) -> DataFrame:
    return tokens(hashed(lines), ranks)


def measured(docs: DataFrame, ranks: Column, s: Settings, marks: bool) -> DataFrame:
    return measured_words(hashed(lines_of(docs, marks)), ranks, s)


def measured_words(words: DataFrame, ranks: Column, s: Settings) -> DataFrame:
    """For each line the size n of its set, a hash of the set, its bitmap of 128 bits, the short hashes of its prefix, and the STARS least of these.

    A token turns one bit of the bitmap: a bit of b, and the same bit of b0 if it belongs to the first half. Lines of up to LONG tokens go by b alone, their b0 is 0.
    The bits are looked up, as each step of a lambda is a call and takes longer than what it computes.
    """
    n = F.size("t")
    prefix = n - F.floor((n * s.hundredths + 99) / 100).cast("int") + 1
    none, bits = F.lit(0).cast("long"), [*[1 << i for i in range(63)], -1 << 63]
    turned = lambda of: F.aggregate("t", none, lambda acc, x: acc.bitwiseXOR(numbers(of)[x.bitwiseAND(F.lit(len(of) - 1))]))
    b0 = F.when(n > LONG, turned([0] * 64 + bits)).otherwise(none)
    short = F.transform(F.slice("t", 1, prefix), lambda x: F.hash(x))
    found = tokens(words, ranks).select("d", "at", n.alias("n"), F.xxhash64("t").alias("h"), b0.alias("b0"), turned(bits).alias("b"), short.alias("prefix"))
    return found.withColumn("stars", F.slice(F.sort_array("prefix"), 1, STARS))


def apart(n: Column, m: Column, x: str, y: str) -> Column:
    """The differing bits of two bitmaps of lines of n and m tokens: of both halves if both lines have them."""
    first, both = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in ("b0", "b"))
    return F.when((n > LONG) & (m > LONG), F.bit_count(first) + F.bit_count(first.bitwiseXOR(both))).otherwise(F.bit_count(both))


def similar(n: Column, m: Column, x: str, y: str, s: Settings) -> Column:
    """The length filter and the bitmap bound: no more bits differ than the sets may have tokens of their own. The test that few pairs pass at little cost comes first."""
    own, most = 100 + s.hundredths, (n + m) * (100 - s.hundredths)
    quick = F.bit_count(F.col(f"{x}b").bitwiseXOR(F.col(f"{y}b"))) * own <= most
    return quick & (100 * n >= s.hundredths * m) & (100 * m >= s.hundredths * n) & (apart(n, m, x, y) * own <= most)


def earlier(x: str, y: str) -> Column:
    return (F.col(f"{x}d") < F.col(f"{y}d")) | ((F.col(f"{x}d") == F.col(f"{y}d")) & (F.col(f"{x}at") < F.col(f"{y}at")))


def verified(pairs: DataFrame, docs: DataFrame, s: Settings, marks: bool) -> DataFrame:
    """The later lines (d, at) of pairs (d, at, y_d, y_at) whose sets are similar.

    Ranks play no part: each of a plan's stages has the driver describe the plan anew, with the whole table of ranks if it is in it.
    """
    both = pairs.select("d", "at").union(pairs.select("y_d", "y_at"))
    found = lines_of(within_reach(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), both.select(F.col("d").alias("id"))), marks)
    wanted = both.select(F.xxhash64("d", "at").alias("id"))
    sets = hashed(within_reach(found.withColumn("doc_id", F.xxhash64("d", "at")), wanted).drop("doc_id"))
    if marks:  # repeated rows have the same lines at the same places
        sets = sets.groupBy("d", "at").agg(F.first("w").alias("w"))
    # both sides of the pairs read one exchange of sets, as each renames every column
    one, other = (sets.select(*[F.col(c).alias(f"{side}{c}") for c in ("d", "at", "w")]) for side in ("x_", "y_"))
    joined = pairs.join(one, (F.col("d") == F.col("x_d")) & (F.col("at") == F.col("x_at"))).select("d", "at", "x_w", "y_d", "y_at").join(other, ["y_d", "y_at"])
    common = F.size(F.array_intersect("x_w", "y_w"))
    return joined.filter(100 * common >= s.hundredths * (F.size("x_w") + F.size("y_w") - common)).select("d", "at").distinct()


OWN = ("d", "at", "n", "b0", "b")


def equal_lines(lines: DataFrame) -> DataFrame:
    """The lines (d, at) that have an earlier one with the same set: with the same hash of all tokens, and the same bitmap."""
    sets = lines.select("h", "b", "d", "at")
    first = sets.groupBy("h", "b").agg(F.min(F.struct("d", "at")).alias("m"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    first = written(first.select("h", "b", F.col("m.d").alias("y_d"), F.col("m.at").alias("y_at")), "line-sets")  # a set of many lines is a hot key, which a join of two plain tables can split
    return sets.join(first, ["h", "b"]).filter(earlier("y_", "")).select("d", "at").distinct()


def flagged(lines: DataFrame, equal: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """The lines without `equal` ones, with `open`: whether they aren't in `resolved`."""
    known = equal.withColumn("equal", F.lit(True))
    if resolved is not None:
        known = known.union(resolved.withColumn("equal", F.lit(False)))
    known = F.broadcast(known) if known.count() <= BROADCAST else known
    return lines.join(known, ["d", "at"], "left").filter("equal IS NULL OR NOT equal").withColumn("open", F.col("equal").isNull()).drop("equal")


def star_pairs(classes: DataFrame, s: Settings) -> DataFrame:
    """Each line with one earlier line: of three of its prefix tokens' centres, the one whose bitmap differs least.

    Similar lines choose the same three tokens as far as can be. A token's
    centres are the earliest line of each of WAYS parts of its lines, so that
    one centre unlike the rest doesn't leave a large group to the join of all.
    """
    keys = classes.select(F.explode_outer("stars").alias("k"), *OWN)
    way = F.xxhash64("d", "at").bitwiseAND(F.lit(WAYS - 1))
    first = keys.groupBy("k").agg(F.count(F.lit(1)).alias("size"), *[F.min(F.when(way == i, F.struct(*OWN))).alias(f"c{i}") for i in range(WAYS)]).filter("size > 1")
    met = keys.join(first, "k").select(*OWN, F.explode_outer(F.array(*[f"c{i}" for i in range(WAYS)])).alias("c"))
    met = met.select(*OWN, *[F.col(f"c.{x}").alias(f"y_{x}") for x in OWN]).filter(earlier("y_", "") & similar(F.col("n"), F.col("y_n"), "", "y_", s))
    best = met.groupBy("d", "at").agg(F.min(F.struct(apart(F.col("n"), F.col("y_n"), "", "y_").alias("apart"), "y_d", "y_at")).alias("c"))
    return best.select("d", "at", "c.y_d", "c.y_at")


def prefix_rows(classes: DataFrame, turn: int) -> DataFrame:
    """A row for each line and prefix token of this pass, whose columns the join needn't test for nulls at every pair."""
    each = classes.select("prefix", F.posexplode_outer("prefix").alias("p", "k"), *OWN, "open").filter(F.pmod("k", F.lit(PASSES)) == turn)
    packed = F.shiftleft(F.col("p").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 1)).bitwiseOR(F.col("open").cast("long"))
    before = F.when(F.col("p") > 0, F.get("prefix", F.col("p") - 1))
    sure = {"d": F.col("d"), "at": F.col("at"), "b0": F.col("b0"), "b": F.col("b"), "x": packed}
    return each.select("k", *[F.coalesce(c, F.lit(0).cast("long")).alias(name) for name, c in sure.items()], F.coalesce(before, F.lit(0)).alias("v"))


def prefix_pairs(rows: DataFrame, s: Settings) -> DataFrame:
    """Each open line with every earlier line that shares a prefix token of the pass, by length, positions and bitmap; a pair may come again in another pass."""
    # both sides read one exchange: each renames every column, and no part of the condition reads one side alone, as the optimizer would filter that side before it
    one, other = (rows.select("k", *[F.col(c).alias(f"{side}{c}") for c in rows.columns[1:]]) for side in ("x_", "y_"))
    n, m = (F.shiftrightunsigned(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), 1) for c in ("x_x", "y_x"))
    p, q = (F.shiftrightunsigned(F.col(c), 32) for c in ("x_x", "y_x"))
    # none for a line that isn't open
    room = F.col("x_x").bitwiseAND(F.lit(1)) * (1 + F.least(n - p - 1, m - q - 1) + F.least(p, q))
    # lines that share the tokens before as well have met there, with as much room
    first = (F.col("x_v") != F.col("y_v")) | (p == 0) | (q == 0)
    fits = similar(n, m, "x_", "y_", s) & earlier("y_", "x_") & first & (room * (100 + s.hundredths) >= s.hundredths * (n + m))
    return one.join(other, "k").filter(fits).select(F.col("x_d").alias("d"), F.col("x_at").alias("at"), "y_d", "y_at").distinct()


def dedup_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Documents (doc_id, text and any other columns) without the lines that match an earlier line.

    Adds n_lines and n_removed (columns of these names are replaced); text
    holds the lines that stay, joined by line feeds. A line matches an earlier
    one, by (doc_id, place), if the Jaccard similarity of their distinct
    lower-cased words is at least the threshold, whether or not that earlier
    line itself stays. Lines without words always stay. A null text stays null
    with no lines; rows without doc_id take no part and stay as they are. Rows
    that share a doc_id have lines of their own, at equal places in order of a
    hash of the text; rows that repeat doc_id and text are one document, whose
    lines share their fate.
    """
    docs = docs.drop("n_lines", "n_removed")
    # without a look at the texts; marks where only rows without text share an id change nothing
    marks = not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
    words = written(hashed(lines_of(docs, marks)), "line-words")  # split once, for the ranks and for what they order
    table = written(measured_words(words, ranked(words), s), "lines")
    remove(words)
    if marks:  # repeated rows are one document
        every, table = table, written(table.dropDuplicates(["d", "at"]), "lines")
        remove(every)
    lines = table.filter(F.col("n") >= max(1, s.least_words))
    equal = written(equal_lines(lines), "line-matches")
    pairs = written(star_pairs(flagged(lines, equal), s), "line-pairs")
    stars = written(verified(pairs, docs, s, marks), "line-matches")
    remove(pairs)
    classes = written(flagged(lines, equal, stars).select("prefix", *OWN, "open"), "line-classes")
    remove(table)
    passes = []
    for turn in range(PASSES):
        passes.append(written(prefix_pairs(prefix_rows(classes, turn), s), "line-pairs"))
        release(docs.sparkSession)
    pairs = written(reduce(DataFrame.union, passes).distinct(), "line-pairs")
    for x in (classes, *passes):
        remove(x)
    rest = written(verified(pairs, docs, s, marks), "line-matches")
    remove(pairs)
    gone = equal.union(stars).union(rest)
    n_gone = gone.count()
    own = unused("own", docs.columns)
    by_doc = gone.groupBy("d").agg(F.collect_list("at").alias("gone")).select(F.struct("d", "gone").alias(own))
    by_doc = F.broadcast(by_doc) if n_gone <= BROADCAST else by_doc
    mine = F.transform(F.filter(F.col(own)["gone"], lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)) == (mark(F.col("text")) if marks else 0)), lambda x: F.shiftright(x, 32).cast("int"))
    parts = F.struct(F.split("text", "\n").alias("lines"), F.coalesce(mine, F.array().cast("array<int>")).alias("gone"))

    def rest_of(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        left = F.when(F.size(x["gone"]) > 0, F.array_join(F.transform(stay, lambda i: F.get(x["lines"], i)), "\n")).otherwise(F.col("text"))
        return F.struct(left.alias("text"), F.greatest(F.lit(0), F.size(x["lines"])).cast("long").alias("n_lines"), F.size(x["gone"]).cast("long").alias("n_removed"))

    # a lambda's argument is evaluated once, where a column that is used again may be written out again
    out = docs.join(by_doc, (F.col("doc_id") == F.col(own)["d"]) & F.col("text").isNotNull(), "left")
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.get(F.transform(F.array(parts), rest_of), F.lit(0)).alias(own))
    names = [F.col(f"`{c}`") if c != "text" else F.col(own)["text"].alias("text") for c in docs.columns]
    return out.select(*names, F.col(own)["n_lines"].alias("n_lines"), F.col(own)["n_removed"].alias("n_removed"))
