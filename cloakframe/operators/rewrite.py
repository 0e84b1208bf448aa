"""Rewriting documents with a registry, and restoring them.

The whole registry applies to every document, not only what was found in it,
so the registry goes to every task. Up to `matcher_entries` pairs (checked by a
count) it is one broadcast matcher. A larger registry is never gathered in one
place: it is a written table in parts of that size, which a task goes through
one after another for a chunk of texts of bounded size, collecting places that
are then resolved together. The documents never shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.config import Config, FormatError
from cloakframe.functions import formats
from cloakframe.functions.replacing import Replacer, splice
from cloakframe.operators import registry as R
from cloakframe.sources import shared

RESULT = "text string, replacements long, format string, status string, schema_intact boolean, syntax_valid boolean, warnings array<string>"
_replacers: dict = {}


#: Needles of several parts that one matcher may hold together.
GATHERED = 200_000
#: Characters of strings that a task holds while it goes through the parts of a large registry.
CHUNK = 16_000_000
#: Characters of texts of which a task holds the results at once where one matcher has the whole registry.
PIECE = 1_000_000


def matchers(registry: DataFrame, config: Config, reverse: bool = False) -> list:
    """Names and sources of at most about `matcher_entries` pairs each: one broadcast dictionary, or the folders of a table dealt by hash."""
    pairs = R.mapping(registry, reverse, config)
    n = pairs.count()
    parts = max(1, -(-n // config.matcher_entries))
    spark, name = registry.sparkSession, uuid.uuid4().hex
    if parts == 1:
        return [(name, spark.sparkContext.broadcast({r.needle: r.replacement for r in pairs.collect()}))]
    at = f"{shared.folder(spark)}/pairs-{name}"
    pairs.withColumn("part", F.pmod(F.xxhash64("needle"), F.lit(parts))).repartition(parts, "part").write.partitionBy("part").parquet(at)
    return [(f"{name}-{i}", f"{at}/part={i}") for i in range(parts)]


def _pairs(source) -> dict[str, str]:
    if not isinstance(source, str):
        return source.value
    from pyarrow import dataset, fs

    where, at = shared.opened(source)
    if where.get_file_info(at).type == fs.FileType.NotFound:  # a part that got no pair
        return {}
    table = dataset.dataset(at, filesystem=where, format="parquet").to_table(["needle", "replacement"])
    return dict(zip(table["needle"].to_pylist(), table["replacement"].to_pylist(), strict=True))


def replacer(source: tuple, strict: bool) -> Replacer:
    """The worker's matcher for a source of pairs; it keeps the last one."""
    key = (source[0], strict)
    if key not in _replacers:
        _replacers.clear()
        _replacers[key] = Replacer(_pairs(source[1]), strict)
    return _replacers[key]


_RUN = re.compile(r"\w+")


def words_of(strings: list[str]) -> set[str]:
    return set().union(*map(_RUN.findall, strings))


def possible(pairs: dict[str, str], strings: list[str], strict: bool, words: set[str] | None = None) -> dict[str, str]:
    """The pairs without needles that can't stand in any of the strings; `words` are those of the strings, if known.

    A run of word characters that a needle holds between others is a whole word
    of the text; so is, with `strict`, a needle that is one run.
    """
    words = words_of(strings) if words is None else words

    def may(needle: str) -> bool:
        runs = _RUN.findall(needle)
        if len(runs) == 1 and len(runs[0]) == len(needle):
            return not strict or needle in words
        first, last = needle.startswith(runs[0]) if runs else False, needle.endswith(runs[-1]) if runs else False
        return words.issuperset(runs[int(first) : len(runs) - int(last)])

    return {k: v for k, v in pairs.items() if may(k)}


def replaced(sources: list, strict: bool, strings: list[str]) -> dict[str, tuple[str, int]]:
    """New strings and their numbers of replacements; each source is read once for all of them, and only needles that may occur make a matcher, those of several sources together."""
    hits: dict[str, list] = {x: [] for x in strings}
    words, gathered = words_of(strings), {}

    def look() -> None:
        r = Replacer(gathered, strict)
        for x, found in hits.items() if gathered else ():
            found += [(a, b, r.pairs[k]) for a, b, k in r.hits(x)]

    for _, source in sources:
        more = possible(_pairs(source), strings, strict, words)
        if len(gathered) + len(more) > GATHERED:
            look()
            gathered = {}
        gathered |= more
    look()
    return {x: splice(x, found) for x, found in hits.items()}


def with_sources(sources: list, strict: bool, run: Callable):
    """run(replace) with the sources' replacements; with several, the strings that it asks for are gathered first, so it must ask for the same ones again."""
    if len(sources) == 1:
        return run(replacer(sources[0], strict).replace)
    asked: dict[str, None] = {}

    def ask(x: str) -> tuple[str, int]:
        asked[x] = None
        return x, 0

    run(ask)
    return run(replaced(sources, strict, list(asked)).__getitem__)


def rewritten_all(texts: list, kinds: list, sources: list, config: Config, canonical: bool) -> Iterator[list[tuple]]:
    """Rows of RESULT, chunk by chunk."""
    at, most = 0, PIECE if len(sources) == 1 else CHUNK
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= most):
            size, upto = size + len(texts[upto] or ""), upto + 1
        chunk = list(zip(texts[at:upto], kinds[at:upto], strict=True))
        yield with_sources(sources, config.strict_word_boundaries, lambda replace, chunk=chunk: [rewritten(t, k, replace, config, canonical) for t, k in chunk])
        at = upto


def rewritten(text: str | None, kind: str | None, replace, config: Config, canonical: bool) -> tuple:
    """A row of RESULT for one text. A text that isn't in its format comes back as it was, with its status."""
    if text is None:
        return None, 0, None, "ok", True, True, []
    kind = kind if kind in (formats.JSON, formats.XML, formats.LOG, formats.TEXT) else formats.format_of(text)
    try:
        new, n = formats.rewrite(text, kind, replace, config.parity, canonical)
    except FormatError as e:
        return text, 0, kind, f"error: {e}", True, False, [str(e)]
    if kind in (formats.JSON, formats.XML) and n:
        report = formats.compare(text, new, kind)
        return new, n, kind, "ok", report["schema_intact"], report["syntax_valid"], report["issues"]
    return new, n, kind, "ok", True, True, []


def rewrite(docs: DataFrame, registry: DataFrame, config: Config = Config(), text: str = "text", kind: str = "auto", reverse: bool = False, canonical: bool = False) -> DataFrame:
    """Documents with their text rewritten, and a `report` of it.

    kind is a format, `auto`, or the name of a column of formats (null: auto).
    The report holds format_detected, original_length, result_length (bytes),
    replacements_applied, schema_intact, syntax_valid, warnings and status.
    """
    sources = matchers(registry, config, reverse)
    docs = shared.one_worker(docs.drop("report"))

    @F.pandas_udf(RESULT)
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, kinds in batches:
            for rows in rewritten_all([t if isinstance(t, str) else None for t in texts], list(kinds), sources, config, canonical):
                yield pd.DataFrame(rows, columns=["text", "replacements", "format", "status", "schema_intact", "syntax_valid", "warnings"])

    kinds = F.col(kind) if kind in docs.columns else F.lit(kind)
    # named non-deterministic, or a filter of the report would be pushed below it and rewrite each text again
    out = shared.dealt(docs).withColumn("_new", each.asNondeterministic()(F.col(text), kinds))
    report = F.struct(
        F.col("_new.format").alias("format_detected"), F.octet_length(F.col(text)).alias("original_length"), F.octet_length("_new.text").alias("result_length"),
        F.col("_new.replacements").alias("replacements_applied"), F.col("_new.schema_intact").alias("schema_intact"), F.col("_new.syntax_valid").alias("syntax_valid"),
        F.col("_new.warnings").alias("warnings"), F.col("_new.status").alias("status"),
    )
    names = [F.col("_new.text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, report.alias("report"))


def formats_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `format`, the first that fits: json, xml, log, plaintext."""

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: formats.format_of(t) if isinstance(t, str) else None)

    return docs.withColumn("format", each(F.col(text)))
