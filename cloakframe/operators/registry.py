"""The registry: a one-to-one table of originals and pseudonyms.

Columns: original, pseudonym, detector_type, omitted. An omitted entry (its
pseudonym is `=`) protects its original. Masks repeat, so entries whose
pseudonym can't be restored are `reversible` false and outside the bijection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.config import CollisionError, Config
from cloakframe.functions import pseudonyms as P
from cloakframe.functions.checks import is_vendor_domain
from cloakframe.sources.shared import written

SCHEMA = "original string, pseudonym string, detector_type string, omitted boolean"
COLUMNS = ["original", "pseudonym", "detector_type", "omitted"]
ATTEMPTS = 1000


def with_pseudonym(rows: DataFrame, config: Config) -> DataFrame:
    """Sets `pseudonym` of rows with detector_type, original, slot, attempt; `=` for vendors' domains and omitted rules."""
    kind, original, h = F.col("detector_type"), F.col("original"), F.col("_h")
    out = P.unknown(original, h)
    for name, make in P.GENERATORS.items():
        out = F.when(kind == name, make(original, h)).otherwise(out)
    for r in config.rules:
        own = F.lit("=") if r.omitted else P.custom(r.strategy, r.prefix, original, h)
        out = F.when(kind == f"Custom ({r.name})", own).otherwise(out)
    out = F.when((kind == "Domain/FQDN") & is_vendor_domain(original), "=").otherwise(out)
    return rows.withColumn("_h", P.keyed_hash(config.key, kind, F.col("slot"), F.col("attempt"))).withColumn("pseudonym", out).drop("_h")


def masks(config: Config) -> list[str]:
    return [f"Custom ({r.name})" for r in config.rules if r.strategy == "mask" and not r.omitted]


def build(originals: DataFrame, config: Config = Config(), known: DataFrame | None = None) -> DataFrame:
    """Pseudonyms for originals (original, detector_type); those that `known` has keep its entries.

    Where two originals get one pseudonym, or one that is itself an original or
    taken in `known`, all but the first by original try the next candidate;
    after a thousand attempts it is a CollisionError. IPv4 addresses move with
    their /24 network. Each round is a written table, so the originals are
    found once; collisions are rare, and mostly the first check is the last.
    """
    todo = originals.select("original", "detector_type").filter(F.col("original").isNotNull()).dropDuplicates(["original"])
    if known is not None:
        todo = todo.join(known.select("original"), "original", "left_anti")
    slots = todo.withColumn("slot", P.slot(F.col("detector_type"), F.col("original"))).withColumn("attempt", F.lit(0))
    made = written(with_pseudonym(slots, config), "registry")
    single = masks(config)
    for attempt in range(1, ATTEMPTS + 1):
        live = made.filter((F.col("pseudonym") != "=") & ~F.col("detector_type").isin(single))
        order = Window.partitionBy("pseudonym").orderBy("attempt", "original")
        again = live.withColumn("r", F.row_number().over(order)).filter("r > 1").select("detector_type", "slot")
        taken = made.select("original")
        if known is not None:
            taken = taken.union(known.filter("NOT omitted").select("pseudonym"))
        again = again.union(live.join(taken.withColumnRenamed("original", "pseudonym"), "pseudonym", "left_semi").select("detector_type", "slot")).distinct()
        if again.isEmpty():
            break
        if attempt == ATTEMPTS:
            raise CollisionError(f"no free pseudonym after {ATTEMPTS} attempts")
        again = again.withColumn("again", F.lit(True))
        made = made.join(again, ["detector_type", "slot"], "left")
        made = made.withColumn("attempt", F.when(F.col("again"), attempt).otherwise(F.col("attempt"))).drop("again")
        made = written(with_pseudonym(made, config), "registry")
    new = made.select("original", "pseudonym", "detector_type", (F.col("pseudonym") == "=").alias("omitted"))
    return new if known is None else known.select(COLUMNS).unionByName(new)


def check_bijection(registry: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: active entries, distinct originals, distinct pseudonyms, and whether they agree."""
    active = registry.filter(~F.col("omitted") & ~F.col("detector_type").isin(masks(config)))
    sums = active.agg(F.count(F.lit(1)).alias("active"), F.countDistinct("original").alias("originals"), F.countDistinct("pseudonym").alias("pseudonyms"))
    return sums.withColumn("one_to_one", (F.col("active") == F.col("originals")) & (F.col("active") == F.col("pseudonyms")))


def merge_first(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored entries, and new ones whose originals they lack."""
    return stored.select(COLUMNS).unionByName(new.select(COLUMNS).dropDuplicates(["original"]).join(stored.select("original"), "original", "left_anti"))


def merge_last(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New entries, and stored ones whose originals they lack."""
    return merge_first(new, stored)


def add(registry: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds pairs (original, pseudonym, detector_type): omitted if either side is `=`.

    A pair of equal sides is ignored; an omitted or equal entry stays; any other
    entry is replaced. A pseudonym that then belongs to two originals raises a
    CollisionError.
    """
    new = pairs.select("original", "pseudonym", "detector_type").withColumn("omitted", (F.col("original") == "=") | (F.col("pseudonym") == "="))
    new = new.withColumn("pseudonym", F.when(F.col("omitted"), "=").otherwise(F.col("pseudonym"))).filter("omitted OR original <> pseudonym").dropDuplicates(["original"])
    fixed = registry.filter("omitted").join(new.filter("NOT omitted"), "original", "left_semi")
    new = new.join(fixed.select("original"), "original", "left_anti")
    out = merge_last(registry, new)
    if (clash := out.filter("NOT omitted").groupBy("pseudonym").agg(F.countDistinct("original").alias("n")).filter("n > 1").limit(1).collect()):
        raise CollisionError(f"pseudonym {clash[0].pseudonym!r} belongs to several originals")
    return out


def omit(registry: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """Turns entries, all or those of the given originals, into omitted ones."""
    if originals is None:
        return registry.select("original", F.lit("=").alias("pseudonym"), "detector_type", F.lit(True).alias("omitted"))
    hit = originals.select("original").distinct().withColumn("hit", F.lit(True))
    marked = registry.join(hit, "original", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return marked.select("original", F.when(F.col("hit"), "=").otherwise(F.col("pseudonym")).alias("pseudonym"), "detector_type", (F.col("omitted") | F.col("hit")).alias("omitted"))


def reactivate(registry: DataFrame, originals: DataFrame, config: Config = Config()) -> DataFrame:
    """Gives omitted entries of these originals a pseudonym again."""
    back = registry.filter("omitted").join(originals.select("original").distinct(), "original", "left_semi")
    rest = registry.join(back.select("original"), "original", "left_anti")
    return build(back, config, rest)


def remove(registry: DataFrame, originals: DataFrame) -> DataFrame:
    return registry.join(originals.select("original"), "original", "left_anti")


def update(registry: DataFrame, original: str, pseudonym: str) -> DataFrame:
    """Replaces one entry's pseudonym, by the rules of `add`."""
    kept = registry.filter(F.col("original") == original).select("original", F.lit(pseudonym).alias("pseudonym"), "detector_type")
    return add(registry.filter((F.col("original") != original) | ~F.col("omitted")), kept)


def search(registry: DataFrame, query: str = "", kind: str | None = None) -> DataFrame:
    """Entries with the query in either side, whatever the case, and of the type."""
    q = query.lower()
    out = registry.filter(F.lower("original").contains(q) | F.lower("pseudonym").contains(q))
    return out if kind is None else out.filter(F.col("detector_type") == kind)


def mapping(registry: DataFrame, reverse: bool = False, config: Config = Config()) -> DataFrame:
    """What replaces what (needle, replacement), without omitted entries; backwards without masks."""
    active = registry.filter(~F.col("omitted") & (F.col("original") != "=") & (F.col("pseudonym") != "="))
    if reverse:
        active = active.filter(~F.col("detector_type").isin(masks(config)))
        return active.select(F.col("pseudonym").alias("needle"), F.col("original").alias("replacement"))
    return active.select(F.col("original").alias("needle"), F.col("pseudonym").alias("replacement"))


def select_rows(registry: DataFrame, numbers: list[int]) -> DataFrame:
    """Entries by their place (from 1) in order of their originals; only as many rows as the largest place are put in order."""
    first = registry.orderBy("original").limit(max([0, *numbers]))
    ranked = first.withColumn("row", F.row_number().over(Window.orderBy("original")))
    return ranked.filter(F.col("row").isin(numbers)).drop("row")


def clear(registry: DataFrame) -> DataFrame:
    """The registry without entries."""
    return registry.limit(0)
