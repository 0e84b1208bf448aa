"""Directories as sources: which files count, what they hold, and which need another scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import catalog as C
from cloakframe.config import Config

#: Bytes at either end of a file that its fingerprint covers; a file of up to both is covered whole.
EDGE = 64 << 10


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def ignore_pattern(line: str) -> str | None:
    """A line of an ignore file as a regular expression over paths below the root; None for blanks and comments."""
    p = line.strip()
    if not p or p.startswith("#") or p.startswith("!"):
        return None
    anchored, folder, p = p.startswith("/"), p.endswith("/"), p.strip("/")
    rx = re.escape(p).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored or "/" in p else "(?:^|/)") + rx + ("/" if folder else "(?:/|$)")


def wanted(path: Column, config: Config, ignore: list[str] | None = None, root: str = "") -> Column:
    """Whether a path counts: nothing hidden, no ignored directory anywhere in it, no ignored extension, no ignore line."""
    below = F.regexp_replace(path, "^" + re.escape(root), "") if root else path
    folders = F.transform(F.split(path, "/"), F.lower)
    out = ~below.rlike(r"(?:^|/)\.[^/]+") & ~F.arrays_overlap(folders, F.array(*[F.lit(d.lower()) for d in config.ignored_directories])) & ~extension(path).isin(list(config.ignored_extensions))
    for p in filter(None, map(ignore_pattern, ignore or [])):
        out = out & ~F.regexp_replace(below, "^/", "").rlike(p)
    return out


def is_binary(path: Column, content: Column) -> Column:
    """By extension, by the first bytes of compressed formats, or by a zero byte in the first 1024. Zip containers count as binary here; office documents are told apart by `operators.office`."""
    head = F.hex(F.substring(content, 1, 1024))
    return extension(path).isin(C.BINARY_EXTENSIONS) | head.rlike("^(?:" + "|".join(C.MAGIC) + ")") | head.rlike("^(?:..)*00")


def directory(spark: SparkSession, root: str, config: Config = Config(), recursive: bool = True, ignore: list[str] | None = None) -> DataFrame:
    """Files of a directory that count: path, modificationTime, length, content, binary.

    Listing, filtering and reading are Spark's; files are whole. For files too
    large for that, `lines` reads them line by line.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    files = files.filter(wanted(F.regexp_replace("path", r"^\w+:/*", "/"), config, ignore, re.sub(r"^\w+:/*", "/", root)))
    return files.withColumn("binary", is_binary(F.col("path"), F.col("content")))


def texts(files: DataFrame) -> DataFrame:
    """Text files as documents: path, text, decoded with replacement of what isn't UTF-8."""
    return files.filter("NOT binary").select("path", F.decode(F.make_valid_utf8(F.decode("content", "utf-8")).cast("binary"), "utf-8").alias("text"))


def lines(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Lines of text files: path, text. Scanned apart, a value over several lines isn't found."""
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).text(root).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def fingerprint(files: DataFrame, rules: str) -> DataFrame:
    """What a scan cache keeps of files: path, length, mtime, partial_hash, rules_hash."""
    n, c = F.col("length"), F.col("content")
    part = F.when(n <= 2 * EDGE, F.xxhash64(c)).otherwise(F.xxhash64(F.substring(c, 1, EDGE), F.substring(c, -EDGE, EDGE)))
    return files.select("path", "length", F.col("modificationTime").alias("mtime"), part.alias("partial_hash"), F.lit(rules).alias("rules_hash"))


def changed(now: DataFrame, cache: DataFrame) -> DataFrame:
    """Of fingerprints, those that need a scan: no cached row with the same rules and length and either the same time or the same hash."""
    same = (F.col("n.path") == F.col("c.path")) & (F.col("n.rules_hash") == F.col("c.rules_hash")) & (F.col("n.length") == F.col("c.length")) & ((F.col("n.mtime") == F.col("c.mtime")) | (F.col("n.partial_hash") == F.col("c.partial_hash")))
    return now.alias("n").join(cache.alias("c"), same, "left_anti")


def updated(cache: DataFrame, now: DataFrame) -> DataFrame:
    """The cache after a scan: new rows replace those of their paths."""
    return now.unionByName(cache.join(now.select("path"), "path", "left_anti").select(now.columns))
