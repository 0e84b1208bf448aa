"""Positions of pattern matches, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start_pos:int,end_pos:int,original:string>>"


def unicode(pattern: str) -> str:
    """The pattern with Unicode-aware classes and word boundaries in any Java version."""
    return f"(?U){pattern}"


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Non-overlapping matches, leftmost first: start_pos, end_pos (characters, end exclusive), original.

    The text between the matches gives their positions. With group 1, of a
    pattern that ends in a quote after the group, the span is the group's.
    Null for a null text.
    """
    p = unicode(pattern)
    pieces = [F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hit")]
    if group:
        pieces.append(F.regexp_extract_all(text, F.lit(p), F.lit(group)).alias("own"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        own = x["own"] if group else x["hit"]
        to = end - 1 if group else end
        found = F.struct((to - F.length(own)).cast("int").alias("start_pos"), to.cast("int").alias("end_pos"), own.alias("original"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.cast("int").alias("at"), F.array_append(acc["out"], found).alias("out")))

    return F.aggregate(F.arrays_zip(*pieces), start, step, lambda acc: acc["out"])


def before(text: Column, start: Column, size: int | None = None) -> Column:
    """The text before a position, or its last characters."""
    if size is None:
        return F.substr(text, F.lit(1), start)
    return F.substr(text, F.greatest(F.lit(1), start - size + 1), F.least(start, F.lit(size)))


def after(text: Column, end: Column, size: int | None = None) -> Column:
    return F.substr(text, end + 1, F.lit(size) if size is not None else F.length(text))


def last_bytes(text: Column, start: Column, size: int) -> Column:
    """The text in the last `size` bytes before a position, with the whole of a character that they cut."""
    w = before(text, start, size)
    enough = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(size)), lambda k: F.octet_length(F.right(w, k)) >= size))
    return F.when(F.octet_length(w) <= size, w).otherwise(F.right(w, enough))
