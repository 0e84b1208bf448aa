"""Packing examples into sequences under several limits at once.

Vector bin packing by the dot-product heuristic: a bin holds what is left of
its limits as a vector, and of the waiting examples that fit, the one whose
demand has the largest dot product with it goes in. The limits are tokens,
segments and loss-bearing tokens.

Every partition packs alone, in one pass, with a bounded pool of waiting
examples: no shuffle, no state on the driver, and a lost task is simply run
again on the same input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cloakframe.llm.tokens import encoder

#: Bits of a sequence's number within its partition.
LOCAL_BITS = 36


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


class VectorPacker:
    """Packs a stream of (key, tokens, loss tokens) into sequences.

    `place(key, start, length, sequence, offset)` is called for each piece.
    With `cut`, an example may be split over sequences (each of its tokens in
    exactly one piece): whole sequences' worth comes off its front first, and
    when no waiting example fits a bin whole, the largest is cut to fill it.
    Without `cut`, an example beyond the limits is refused with a ValueError.
    The last bin, when cut, is split at powers of two, which need no padding.
    Examples without tokens take no place. Ties go to the earliest example.
    """

    def __init__(self, limits: Limits, place: Callable[[object, int, int, int, int], None], cut: bool = True, pool: int = 512):
        self.limits, self.place, self.cut, self.size = limits, place, cut, pool
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.keys: list = []
        self.start = np.zeros(pool, np.int64)
        self.need = np.zeros((pool, 3))
        self.next = 0

    def add(self, key, tokens: int, loss: int | None = None) -> None:
        start, loss = 0, tokens if loss is None else loss
        if not self.cut and (tokens > self.limits.tokens or loss > self.limits.loss):
            raise ValueError(f"example {key!r} with {tokens} tokens and {loss} loss-bearing tokens is over the limits")
        step = min(self.limits.tokens, self.limits.loss) if loss else self.limits.tokens
        while self.cut and tokens - start >= step:
            self.place(key, start, step, self.next, 0)
            self.next, start = self.next + 1, start + step
        if tokens > start:
            if len(self.keys) == self.size:
                self._fill()
            n = len(self.keys)
            self.start[n] = start
            self.need[n] = tokens - start, 1, min(loss, tokens - start)
            self.keys.append(key)

    def _drop(self, i: int) -> None:
        n = len(self.keys) - 1
        self.keys.pop(i)
        self.start[i:n] = self.start[i + 1 : n + 1]
        self.need[i:n] = self.need[i + 1 : n + 1]

    def _fill(self) -> list[tuple[object, int, int]]:
        """Packs one bin from the pool."""
        left, at, seq = self.caps.copy(), 0, self.next
        self.next += 1
        while self.keys:
            need = self.need[: len(self.keys)] / self.caps
            fits = (need <= left / self.caps + 1e-12).all(axis=1)
            if fits.any():
                gain = np.where(fits, need @ (left / self.caps), -1.0)
                i = int(gain.argmax())
                length = int(self.need[i, 0])
            elif self.cut and left[1] >= 1 and min(left[0], left[2]) >= 1:
                i = int(self.need[: len(self.keys), 0].argmax())
                length = int(min(left[0], left[2], self.need[i, 0]))
            else:
                break
            self.place(self.keys[i], int(self.start[i]), length, seq, at)
            at += length
            loss = min(self.need[i, 2], length)
            left -= (length, 1, loss)
            if length == self.need[i, 0]:
                self._drop(i)
            else:
                self.start[i] += length
                self.need[i] -= (length, 0, loss)
            if left[0] < 1 or left[1] < 1:
                break
        return []

    def close(self) -> None:
        """Packs what waits."""
        while self.keys:
            left = int(self.need[: len(self.keys), 0].sum())
            if self.cut and left < self.limits.tokens:
                self.limits = Limits(1 << (left.bit_length() - 1), self.limits.segments, self.limits.loss)
                self.caps[0] = self.limits.tokens
            self._fill()


def pack_examples(df: DataFrame, limits: Limits = Limits(), pool: int = 512, cut: bool = False) -> DataFrame:
    """Assigns examples to sequences.

    df has `example_id` (any type), `n_tokens` and `n_loss` (null: all tokens
    bear loss); other columns are ignored. Returns example_id, start, length,
    sequence_id, offset. Rows with null or no tokens take no place.
    """
    kind = df.schema["example_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows = TaskContext.get().partitionId() << LOCAL_BITS, []
        packer = VectorPacker(limits, lambda k, s, n, q, o: rows.append((k, s, n, base | q, o)), cut, pool)
        names = ["example_id", "start", "length", "sequence_id", "offset"]
        kinds = None
        for b in batches:
            kinds = kinds or [b.schema.field("example_id").type] + [pa.int64()] * 4
            for k, n, loss in zip(*(b.column(c).to_pylist() for c in ("example_id", "n_tokens", "n_loss")), strict=True):
                if n:
                    packer.add(k, n, loss)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)
            rows.clear()
        packer.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return df.select("example_id", df.n_tokens.cast("long").alias("n_tokens"), df.n_loss.cast("long").alias("n_loss")).mapInArrow(run, f"example_id {kind}, start long, length long, sequence_id long, offset long")


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, pool: int = 512, with_ids: bool = False) -> DataFrame:
    """Tokenizes documents (doc_id, text; other columns are ignored), ends each with `end_id` and packs their pieces.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with `with_ids` the ids themselves. A null text is
    empty, so its only id is the end id. Repeated rows are packed each for
    itself, a null doc_id stays null. An empty table gives no rows.
    """
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, enc = TaskContext.get().partitionId() << LOCAL_BITS, [], encoder(tokenizer)

        def place(key: tuple[int, np.ndarray], start: int, length: int, seq: int, at: int) -> None:
            doc, ids = key
            part = ids[start : start + length]
            row = (doc, start, length, zlib.crc32(part), len(ids), base | seq, at)
            rows.append((*row, part.tolist()) if with_ids else row)

        def taken() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        packer = VectorPacker(limits, place, True, pool)
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(enc.encode(text.as_py()), enc.width.type(end_id)).astype("<u4")
                packer.add((doc, ids), len(ids))
                if len(rows) >= 20_000:
                    yield taken()
            yield taken()
        packer.close()
        yield taken()

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, kind)
