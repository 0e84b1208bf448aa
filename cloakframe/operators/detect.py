"""Findings: detectors and rules over a text column, and the resolution of overlaps.

All of it is Column expressions, so a scan reads each text once, in one
projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe import catalog as C
from cloakframe.config import Config
from cloakframe.functions import checks as V
from cloakframe.functions.spans import SPANS, spans
from cloakframe.sources.shared import dealt

FINDINGS = "array<struct<priority:int,start_pos:int,end_pos:int,original:string,detector_type:string>>"


def matches(key: str, text: Column) -> Column:
    """The valid matches of one detector: an array of start_pos, end_pos, original."""
    d = C.BY_KEY[key]
    valid = {
        "sid": lambda s: ~V.is_protected_sid(s["original"]),
        "dni_nie": lambda s: V.is_dni_nie(s["original"]),
        "card": lambda s: V.is_card(s["original"]) & V.card_stands_alone(text, s["start_pos"], s["end_pos"]),
        "ipv4": lambda s: V.is_ipv4(s["original"]) & V.ipv4_in_context(text, s["start_pos"], s["end_pos"]),
        "phone": lambda s: V.phone_in_context(text, s["start_pos"], s["end_pos"]),
    }.get(key)
    found = spans(text, d.pattern, d.group)
    if valid is not None:
        found = F.filter(found, valid)
    # what a match can't do without, and is found in one quick pass
    ending = lambda: r"(?i)\.(?:" + d.pattern.rsplit("(?:", 1)[1].split(")", 1)[0] + ")"
    possible = {"dni_nie": text.rlike("[0-9]{7}"), "card": text.rlike("[0-9]{4}"), "phone": text.rlike("[0-9]{2}")}.get(key)
    if key in ("domain", "attachment"):
        possible = text.rlike(ending())
    elif d.hint is not None:
        possible = F.lower(text).contains(d.hint) if d.hint == "0x" else text.contains(d.hint)
    return found if possible is None else F.when(possible, found).otherwise(F.array().cast(SPANS))


def labelled(found: Column, priority: int, name: str) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(priority).alias("priority"), s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), F.trim(F.regexp_replace(s["original"], r"(?U)^\s+|\s+$", "")).alias("original"), F.lit(name).alias("detector_type")))


def raw_findings(text: Column, config: Config = Config()) -> Column:
    """All findings before overlaps are resolved, by priority and place. Users' rules come first, in their order."""
    found = []
    rules = [r for r in config.rules if r.usable]
    for i, r in enumerate(rules):
        found.append(F.filter(labelled(spans(text, r.pattern), i - len(rules), f"Custom ({r.name})"), lambda s: s["original"] != ""))
    for i, key in enumerate(config.priority):
        # protected words give up their place
        found.append(F.filter(labelled(matches(key, text), i, C.BY_KEY[key].name), lambda s: ~V.is_protected_word(s["original"], config.protected_words)))
    return F.array_sort(F.concat(*found)).cast(FINDINGS)


def resolve(found: Column) -> Column:
    """Of overlapping findings the first by priority, then by place."""
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start_pos"] < s["end_pos"]) & (k["end_pos"] > s["start_pos"]))
    return F.aggregate(found, F.array().cast(FINDINGS), lambda kept, s: F.when(free(kept, s), F.array_append(kept, s)).otherwise(kept))


def scan(docs: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:
    """Adds `findings`, the resolved findings of each text. Null texts have null findings."""
    raw = dealt(docs).withColumn("findings", raw_findings(F.col(text), config))
    return raw.withColumn("findings", resolve(F.col("findings")))


def findings(docs: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:
    """A row per finding: the columns of docs but the text, then priority, start_pos, end_pos, original, detector_type."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "findings")]
    # the outer form: with the other one Spark infers a filter of the findings, which would be pushed below the scan and run it again
    return scan(docs, config, text).select(*keep, F.inline_outer("findings")).filter("original IS NOT NULL")


def first_wins(found: DataFrame, by: str) -> DataFrame:
    """Distinct originals, each with the type of its first finding: by priority, then by the document column `by`, then by place."""
    first = F.min(F.struct("priority", by, "start_pos", "detector_type"))
    return found.groupBy("original").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).select("original", F.col("f.detector_type").alias("detector_type"), "n")


def claims(found: DataFrame, key: str) -> DataFrame:
    """The same resolution over rows of findings (key, priority, start_pos, end_pos): for findings that are stored, not computed."""
    grouped = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("priority", "start_pos", "end_pos", "original", "detector_type"))).cast(FINDINGS).alias("f"))
    return grouped.select(key, F.inline_outer(resolve(F.col("f")))).filter("original IS NOT NULL")

