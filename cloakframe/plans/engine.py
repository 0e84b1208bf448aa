"""The engine: scan, protect and restore as plans over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.config import Config
from cloakframe.operators import detect, registry, rewrite, structured
from cloakframe.sources.shared import written


@dataclass(frozen=True)
class Engine:
    """One configuration's plans. Pseudonyms depend on its key only, so engines with one key agree."""

    config: Config = field(default_factory=Config)

    def scan(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Documents with their findings."""
        return detect.scan(docs, self.config, text)

    def findings(self, docs: DataFrame, text: str = "text") -> DataFrame:
        return detect.findings(docs, self.config, text)

    def registry(self, docs: DataFrame, key: str, text: str = "text", known: DataFrame | None = None, contextual: bool = False) -> DataFrame:
        """The registry of documents, on top of a known one. With `contextual`, what JSON keys announce comes first."""
        found = detect.first_wins(detect.findings(docs.select(key, text), self.config, text), key)
        if contextual:
            # written, as building and applying the registry read it several times
            announced = written(structured.contextual_registry(structured.contextual(structured.json_leaves(docs, key, text), key, self.config), key), "announced")
            known = announced if known is None else registry.merge_first(known, announced)
        return registry.build(found, self.config, known)

    def protect(self, docs: DataFrame, entries: DataFrame, text: str = "text", kind: str = "auto", canonical: bool = False) -> DataFrame:
        """Documents with all the registry's originals replaced, and a report each."""
        return rewrite.rewrite(docs, entries, self.config, text, kind, canonical=canonical)

    def restore(self, docs: DataFrame, entries: DataFrame, text: str = "text", kind: str = "auto") -> DataFrame:
        """Documents with all the registry's pseudonyms replaced by their originals."""
        return rewrite.rewrite(docs, entries, self.config, text, kind, reverse=True)

    def ambiguous(self, docs: DataFrame, entries: DataFrame, text: str = "text") -> DataFrame:
        """Documents that hold a pseudonym before they are protected, which restoring would turn into an original."""
        shown = rewrite.rewrite(docs, entries, self.config, text, "plaintext", reverse=True)
        return shown.filter(F.col("report.replacements_applied") > 0)
