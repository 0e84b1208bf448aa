"""Audit reports over findings and registries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.config import Config
from cloakframe.operators.rewrite import matchers, replacer

NETWORK, IDENTITY, SYSTEMS, CONTACT = "Red", "Identidad", "Sistemas", "Contacto / Claves"
#: Parts of type names that decide a category, in order; what has none is a contact or key (fixed values).
CATEGORIES = [
    (NETWORK, ["ip", "mac", "domain", "url", "host", "red"]),
    (IDENTITY, ["dni", "nie", "user", "usuario", "nombre", "ident"]),
    (SYSTEMS, ["path", "ruta", "file", "sistema", "sys", "process"]),
]
PROFILES = {"all": [NETWORK, IDENTITY, SYSTEMS, CONTACT], "devops": [NETWORK, SYSTEMS], "gdpr": [IDENTITY, CONTACT]}


def category(kind: Column) -> Column:
    """The category of a type by parts of its name, in lower case."""
    out = F.lit(CONTACT)
    for name, parts in reversed(CATEGORIES):
        out = F.when(F.lower(kind).rlike("|".join(parts)), name).otherwise(out)
    return out


def by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("detector_type").agg(F.count(F.lit(1)).alias("n"))


def by_category(found: DataFrame) -> DataFrame:
    """Count and share (percent, one decimal) of each category."""
    sums = found.groupBy(category(F.col("detector_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # at most four rows
    return sums.withColumn("pct", F.round(100 * F.col("n") / total, 1))


def profile(found: DataFrame, name: str) -> DataFrame:
    """Findings in the categories of a sensitivity profile: all, devops or gdpr."""
    return found.filter(category(F.col("detector_type")).isin(PROFILES[name]))


def rollup(found: DataFrame, by: str) -> DataFrame:
    """Findings by a column and type with subtotals, and distinct originals."""
    return found.rollup(by, "detector_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("original").alias("originals"))


def audit(scanned: DataFrame) -> DataFrame:
    """One row over scanned documents (`findings`, null where ignored): documents scanned and ignored, entities."""
    return scanned.agg(F.count_if(F.col("findings").isNotNull()).alias("scanned"), F.count_if(F.col("findings").isNull()).alias("ignored"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("entities"))


def active_and_omitted(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count_if(~F.col("omitted")).alias("active"), F.count_if("omitted").alias("omitted"))


def tokens_present(docs: DataFrame, registry: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Which originals occur in which texts, as parts of them: key, original. By matchers, not a join of all pairs."""
    sources = matchers(registry, Config(strict_word_boundaries=False))

    @F.pandas_udf("array<string>")
    def each(texts: pd.Series) -> pd.Series:
        found: list[set] = [set() for _ in texts]
        for source in sources:
            r = replacer(source, False)
            for own, t in zip(found, texts, strict=True):
                if isinstance(t, str):
                    own.update(k for _, _, k in r.hits(t))
        return pd.Series([sorted(x) for x in found])

    return docs.select(key, F.explode_outer(each(F.col(text))).alias("original")).filter("original IS NOT NULL")


def text_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines, characters and size in KB (one decimal) of each text."""
    t = F.col(text)
    return docs.select(key, F.size(F.split(t, "\n")).alias("lines"), F.length(t).alias("chars"), F.round(F.octet_length(t) / 1024, 1).alias("kb"))


def format_badge(text: Column) -> Column:
    """A label for display, by the first characters and words of a text."""
    t = F.trim(text)
    alert = t.contains('"wazuh"') | t.contains('"rule"') | t.contains('"agent"')
    return (
        F.when(t == "", "AUTO").when(t.startswith("{") & alert, "JSON WAZUH").when(t.startswith("{") | t.startswith("["), "JSON").when(t.startswith("<") & t.endswith(">"), "XML / HTML")
        .when(t.rlike(r"^(?:\w{3}\s+\d+|\d{4}-\d{2}-\d{2})") | t.rlike("INFO|ERROR|WARN"), "LOG / SYSLOG").otherwise("TEXTO PLANO")
    )


def size_label(size: Column) -> Column:
    """Bytes (of any numeric type) as B, KB, MB or GB."""
    n = size.cast("double")
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(size < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))
    )


def page(df: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """One page of a table in an order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def highlights(scanned: DataFrame, key: str) -> DataFrame:
    """Spans for display: start, end, original, category of each finding of two characters or more."""
    spans = F.transform(F.filter("findings", lambda f: F.length(f["original"]) >= 2), lambda f: F.struct(f["start_pos"].alias("start_pos"), f["end_pos"].alias("end_pos"), f["original"].alias("original"), category(f["detector_type"]).alias("category")))
    return scanned.select(key, spans.alias("highlights"))
