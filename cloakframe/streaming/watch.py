"""The same pipeline over streams.

Each micro-batch is scanned, its new originals join the registry, and its
texts are rewritten. Pseudonyms come from the key, so a batch that is run again
after a failure gives the same texts. The registry has one writer, the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators import detect, registry
from cloakframe.plans.engine import Engine
from cloakframe.sources.vault import Vaults


def protect_stream(stream: DataFrame, engine: Engine, vaults: Vaults, name: str, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text", restore: bool = False, **trigger) -> StreamingQuery:
    """Protects (or restores) a stream's texts and hands each batch to `sink`.

    Null texts pass through. A batch that fails to scan stops the query with its
    error, and is run again from the checkpoint.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            entries = vaults.load(name)
            if not restore:
                found = detect.first_wins(engine.findings(df.select(key, text), text), key)
                fresh = found.join(entries.select("original"), "original", "left_anti")
                if not fresh.isEmpty():
                    entries = registry.build(fresh, engine.config, entries)
                    vaults.save(name, entries)
                    entries = vaults.load(name)
            sink((engine.restore if restore else engine.protect)(df, entries, text), number)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def without_echo(stream: DataFrame, source: str, text: str = "text", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Drops texts that a source sent before within the delay, as when it sends back what it was given."""
    return stream.withWatermark(ts, delay).withColumn("_h", F.sha2(F.coalesce(text, F.lit("")), 256)).dropDuplicatesWithinWatermark([source, "_h"]).drop("_h")


def counts_by_window(stream: DataFrame, engine: Engine, ts: str = "ts", text: str = "text", delay: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Findings by type in windows of event time."""
    found = engine.findings(stream.withWatermark(ts, delay).select(ts, text), text)
    return found.groupBy(F.window(ts, size), "detector_type").agg(F.count(F.lit(1)).alias("n"))
