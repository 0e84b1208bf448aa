"""Token ids in directly addressable codes.

A file cuts each id into chunks of `bits` bits. Level 0 holds the lowest chunk
of every id; an id with more to come has its continuation bit set there and its
next chunk on the level above. The place on the next level is the number of
set bits before, which a rank directory gives from one counter per 512 bits and
one popcount of at most 512 bits. So any id is reached by as many steps as it
has chunks, without decoding its neighbours.

Layout, little-endian: the magic `DACF1\\0`, u16 bits, u32 levels, u64 documents,
u64 ids; for documents their doc_id i64 and first id u64 (one more at the end);
for each level u64 chunks, the chunks (1, 2 or 4 bytes each), the bitmap padded
to 64 bytes, and the directory, a u32 per 64 bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.shared import opened, place, written
from cloakframe.llm.tokens import encoder

MAGIC = b"DACF1\0"
HEAD = struct.Struct("<HIQQ")
#: ids of one file; a partition with more writes several.
FILE_IDS = 4_000_000
#: ids that a task reads, about.
TASK_IDS = 2_000_000
#: The signed value that marks a null doc_id.
NO_ID = -(2**63)


def levels_of(ids: np.ndarray, bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level."""
    kind = {8: np.uint8, 16: np.dtype("<u2"), 32: np.dtype("<u4")}[bits]
    rest, out = ids.astype(np.uint64), []
    while True:
        more = rest >> np.uint64(bits)
        on = more > 0
        bitmap = np.packbits(on, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % 64))
        counts = np.bitwise_count(bitmap.reshape(-1, 64)).sum(axis=1, dtype=np.int64)
        out.append(((rest & np.uint64((1 << bits) - 1)).astype(kind), bitmap, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(counts) else np.empty(0, "<u4")))
        if not on.any():
            return out
        rest = more[on]


def to_bytes(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    """A file of documents with these sizes, their ids one after another."""
    levels = levels_of(ids, bits)
    parts = [MAGIC, HEAD.pack(bits, len(levels), len(docs), len(ids)), docs.astype("<i8").tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()]
    for chunks, bitmap, ranks in levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class DacFile:
    """Reads such a file: `token(i)`, `tokens(i, j)`, `documents(k, l)`.

    data is the file's bytes, or a function of a place and a length that reads
    from it; only what an answer needs is read.
    """

    def __init__(self, data):
        self.read = data if callable(data) else lambda at, n, view=memoryview(data): view[at : at + n]
        head = bytes(self.read(0, len(MAGIC) + HEAD.size))
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.bits, levels, self.n_docs, self.n_ids = HEAD.unpack_from(head, len(MAGIC))
        self.kind = np.dtype({8: "u1", 16: "<u2", 32: "<u4"}[self.bits])
        at = len(MAGIC) + HEAD.size + 16 * self.n_docs + 8
        #: For each level how many chunks it has, and where they, the bitmap and the directory begin.
        self.levels: list[tuple[int, int, int, int]] = []
        for _ in range(levels):
            (m,) = struct.unpack("<Q", self.read(at, 8))
            size = -(-m // 512) * 64
            bitmap = at + 8 + m * self.kind.itemsize
            self.levels.append((m, at + 8, bitmap, bitmap + size))
            at = bitmap + size + size // 16

    def _array(self, kind, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.read(at, n * np.dtype(kind).itemsize), kind, n) if n else np.empty(0, kind)

    def _rank(self, level: int, i: int) -> int:
        """How many chunks before place i go on."""
        m, _, bitmap, ranks = self.levels[level]
        if not m:
            return 0
        block = min(i // 512, -(-m // 512) - 1)
        (before,) = struct.unpack("<I", self.read(ranks + 4 * block, 4))
        own = self._array(np.uint8, bitmap + 64 * block, -(-i // 8) - 64 * block)
        whole = i // 8 - 64 * block
        return before + int(np.bitwise_count(own[:whole]).sum()) + (int(own[whole] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def token(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, _) in enumerate(self.levels):
            value |= int(self._array(self.kind, chunks + i * self.kind.itemsize, 1)[0]) << (self.bits * k)
            if not self.read(bitmap + i // 8, 1)[0] >> i % 8 & 1:
                break
            i = self._rank(k, i)
        return value

    def tokens(self, i: int, j: int) -> np.ndarray:
        """The ids at places i to j, without j, as far as there are any."""
        i, j = max(0, i), min(j, self.n_ids)
        out = np.zeros(max(0, j - i), np.uint32)
        where = slice(None)
        for k, (_, chunks, bitmap, _) in enumerate(self.levels):
            if j <= i:
                break
            out[where] |= self._array(self.kind, chunks + i * self.kind.itemsize, j - i).astype(np.uint32) << np.uint32(self.bits * k)
            bits = np.unpackbits(self._array(np.uint8, bitmap + i // 8, -(-j // 8) - i // 8), bitorder="little")
            on = np.flatnonzero(bits[i % 8 : i % 8 + j - i])
            if not len(on):
                break
            where = on if isinstance(where, slice) else where[on]
            i, j = self._rank(k, i), self._rank(k, j)
        return out

    def documents(self, k: int, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """doc_id, first id's place and ids of documents k to n, without n; read as one range."""
        at = len(MAGIC) + HEAD.size
        starts = self._array("<u8", at + 8 * (self.n_docs + k), n - k + 1).astype(np.int64)
        ids = self.tokens(int(starts[0]), int(starts[-1]))
        for doc, start, end in zip(self._array("<i8", at + 8 * k, n - k).tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield doc, start, ids[start - int(starts[0]) : end - int(starts[0])]


MANIFEST = pa.schema([("part", pa.int64()), ("volume", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, bits: int = 8, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes documents (doc_id, text; other columns are ignored) in ascending doc_id order into files in the shared folder.

    Returns the manifest, itself a written table: part, volume, path, docs, ids;
    (part, volume) is the order of the files. A null text is empty and has the
    end id only; a null doc_id comes first; repeated rows are all written.
    """
    at = place(docs.sparkSession, "dac")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, volume = encoder(tokenizer), TaskContext.get().partitionId(), 0
        fs, top = opened(at)
        fs.create_dir(top)
        ids_of: list[np.ndarray] = []
        names: list[int] = []
        size, end = 0, np.array([end_id], enc.width)

        def flush() -> pa.RecordBatch:
            nonlocal size, volume
            path = f"{part:08d}-{volume:06d}-{uuid.uuid4().hex}.dac"
            sizes = np.fromiter(map(len, ids_of), np.int64, len(ids_of))
            with fs.open_output_stream(f"{top}/{path}") as f:
                f.write(to_bytes(np.array(names, np.int64), sizes, np.concatenate(ids_of), bits))
            row = pa.RecordBatch.from_pylist([{"part": part, "volume": volume, "path": f"{at}/{path}", "docs": len(names), "ids": size}], schema=MANIFEST)
            ids_of.clear()
            names.clear()
            size, volume = 0, volume + 1
            return row

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids_of.append(np.concatenate([enc.encode(text.as_py()), end]))
                names.append(NO_ID if doc is None else doc)
                size += len(ids_of[-1])
                if size >= file_ids:
                    yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(run, "part long, volume long, path string, docs long, ids long"), "dac-manifest")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_ids(manifest: DataFrame, with_ids: bool = False, task_ids: int = TASK_IDS) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with `with_ids` the ids.

    Files are read by ranges of documents with about `task_ids` ids each, dealt
    to as many tasks as there are ranges. An empty manifest gives no rows.
    """
    schema = DIGESTS.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else DIGESTS
    sums = manifest.groupBy("part").agg(F.sum("ids").alias("ids"))  # one row a partition, so the running sum over all of them is small
    before = sums.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = Window.partitionBy("part").orderBy("volume")
    files = manifest.select("*", (F.sum("ids").over(inside) - F.col("ids")).alias("inside")).join(before, "part").select("path", (F.col("before") + F.col("inside")).alias("base"), "docs", "ids")
    step = F.greatest(F.lit(1), F.floor(F.col("docs") * task_ids / F.col("ids"))).cast("long")
    parts = files.withColumn("step", step).select("path", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.col("step"))).alias("at"), F.least(F.col("at") + F.col("step"), "docs").alias("upto"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base, at, upto in zip(*(b.column(c).to_pylist() for c in ("path", "base", "at", "upto")), strict=True):
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    file = DacFile(lambda place, n, f=f: f.read_at(n, place))
                    for k in range(at, upto, 5000):
                        rows = [(None if doc == NO_ID else doc, start + base, len(x), zlib.crc32(x.astype("<u4", copy=False)), *([x.astype(np.int32)] if with_ids else [])) for doc, start, x in file.documents(k, min(k + 5000, upto))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    tasks = max(1, -(-(manifest.agg(F.sum("ids")).first()[0] or 0) // task_ids))
    return parts.repartition(tasks, "path", "at").mapInArrow(run, kind)
