"""SentencePiece BPE: encoding by a merge-type prefix table, and decoding.

For each prefix of a word the table keeps the one token that can end the
prefix's encoding. An automaton lists the tokens that end at each place; one of
them is right if it stands at the start, or if it is compatible with the last
token of the prefix before it, that is if BPE on those two tokens alone would
leave them as they are. There is always exactly one, so the ids are recovered
backwards from the end, and the work is linear in the text.

No piece of such a vocabulary has the space mark after another character, so a
text may be cut before each space mark. Words repeat, so a bounded cache per
Python worker holds their ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import threading
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cloakframe.llm.shared import take_turn

MARK = "▁"
#: Entries of a worker's word cache and of its compatibility cache; each starts afresh when full.
CACHE = 500_000
PAIRS = 400_000
LONGEST = 64
UNKNOWN = -1

_made: dict[str, PieceTable] = {}
_lock = threading.Lock()


class PieceTable(dict):
    """Encoder and decoder of one model; itself the cache from word (without its space mark) to packed ids."""

    def __init__(self, path: str):
        super().__init__()
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.width, self.code = (np.dtype("<u2"), "H") if n <= 65536 else (np.dtype("<u4"), "I")
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in normal) or any(MARK in self.text[i].lstrip(MARK) for i in normal):
            raise ValueError("a vocabulary with unused pieces or with space marks inside pieces isn't supported")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.id = {self.text[i]: i for i in normal}
        self.score = [sp.get_score(i) for i in range(n)]
        order = sorted((i for i in normal if len(self.text[i]) > 1), key=lambda i: (-self.score[i], i))
        self.form = [-1] * n  # when a piece forms; -1: a single character
        for k, i in enumerate(order):
            self.form[i] = k
        self.left, self.right = [UNKNOWN] * n, [UNKNOWN] * n
        self.merged: dict[int, int] = {}
        for i in order:
            t = self.text[i]
            for k in range(1, len(t)):
                if (a := self.id.get(t[:k])) is not None and (b := self.id.get(t[k:])) is not None:
                    self.merged[a << 20 | b] = i
        scores = [self.score[i] for i in order if self.text[i].strip(MARK)]
        #: Pieces that merge at the same score have no order of their own: only runs of space marks may, and words with such runs are merged directly.
        self.ordered = len(set(scores)) == len(scores)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            if len(t) == 1 or not t.strip(MARK):
                if len(t) == 1:
                    self.automaton.add_word(t, (i, 1))
                continue
            if len(ids := self.merge(t, self._note(i))) == 1 and ids[0] == i:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.known_pairs: dict[int, bool] = {}
        inside = {t[k : k + 2] for t in self.id for k in range(len(t) - 1)}
        #: Two characters that are neighbours in no piece never merge; a word may be cut between them.
        self.inside = inside
        #: What a piece stands for in a text.
        self.shown = [t.replace(MARK, " ") for t in self.text]
        for i in range(n):
            if sp.is_control(i):
                self.shown[i] = ""
        for b in range(128):
            self.shown[self.bytes[b]] = chr(b)
        #: ids that need more than their own text: unknown ones, and bytes of characters beyond ASCII.
        self.odd = np.zeros(n, bool)
        self.odd[[sp.unk_id(), *self.bytes[128:]]] = True

    def _note(self, i: int):
        def last(a: int, b: int, made: int) -> None:
            if made == i:
                self.left[i], self.right[i] = a, b

        return last

    def merge(self, word: str, note=None) -> list[int]:
        """Merges directly: the best score first, then the leftmost. ids, with UNKNOWN for characters that no piece has."""
        ids = [self.id.get(c, UNKNOWN) for c in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and ids[i] >= 0 and ids[j] >= 0 and (m := self.merged.get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(queue, (-self.score[m], i, ids[i], ids[j], m))

        for i in range(n - 1):
            offer(i)
        gone = -2
        while queue:
            _, i, a, b, m = heapq.heappop(queue)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            if note is not None:
                note(a, b, m)
            ids[i], ids[j] = m, gone
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i != gone]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves these two tokens as they are, side by side.

        Takes both apart again, the later formed first. Whenever the two inner
        edges could merge, the merge must come too late: after the left edge is
        taken into its own token, or after the right one is.
        """
        key = a << 20 | b
        if (known := self.known_pairs.get(key)) is not None:
            return known
        form, never = self.form, 1 << 60
        until_a = until_b = never
        out = True
        while True:
            m = self.merged.get(a << 20 | b)
            if m is not None and form[m] < until_a and form[m] <= until_b:
                out = False
                break
            if form[a] > form[b]:
                until_a, a = form[a], self.right[a]
            elif form[b] >= 0:
                until_b, b = form[b], self.left[b]
            else:
                break
        if len(self.known_pairs) > PAIRS:
            self.known_pairs.clear()
        self.known_pairs[key] = out
        return out

    def by_table(self, word: str) -> list[int]:
        """Tokens of a word by the prefix table; UNKNOWN for characters that no piece has."""
        n = len(word)
        last = [UNKNOWN] * (n + 1)
        size = [1] * (n + 1)
        for end, (i, length) in self.automaton.iter(word):
            end += 1
            if last[end] == UNKNOWN:
                before = last[end - length] if end > length else UNKNOWN
                if before == UNKNOWN or self.compatible(before, i):
                    last[end], size[end] = i, length
        out = []
        while n > 0:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def pack(self, word: str) -> bytes:
        """Packed ids of a word that begins with its space marks."""
        whole = word.startswith(MARK * 2) or not self.ordered
        cuts = [] if whole else [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.inside]
        out, at = [], 0
        for cut in [*cuts, len(word)]:
            part = word[at:cut]
            place = at
            for i in self.merge(part) if whole else self.by_table(part):
                if i == UNKNOWN:
                    out += [self.bytes[b] for b in word[place].encode()]
                    place += 1
                else:
                    out.append(i)
                    place += len(self.text[i])
            at = cut
        return array(self.code, out).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.pack(word if word.startswith(MARK) else MARK + word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """ids of a text without begin and end; null and empty texts have none."""
        if not text:
            return np.empty(0, self.width)
        if len(self) > CACHE:
            self.clear()
        if "  " in text or text[0] == " " or MARK in text:
            words = re.findall("▁+[^▁]*", MARK + text.replace(" ", MARK))
        else:
            words = text.split(" ")
        return np.frombuffer(b"".join(map(self.__getitem__, words)), self.width)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Byte tokens in a row are read as UTF-8; where they aren't, and for unknown ids, the library decodes."""
        each = ids.tolist()
        if self.odd[ids].any():
            out = bytearray()
            for i in each:
                if (b := self.byte_of.get(i)) is not None:
                    out.append(b)
                elif self.odd[i]:
                    return self.library.decode(each)
                else:
                    out += self.shown[i].encode()
            try:
                text = out.decode()
            except UnicodeDecodeError:
                return self.library.decode(each)
        else:
            text = "".join(map(self.shown.__getitem__, each))
        return text[1:] if text.startswith(" ") else text


def table(path: str) -> PieceTable:
    """The worker's table for this model; its cache lives as long as the worker."""
    with _lock:
        take_turn("pieces", _made.clear)
        if path not in _made:
            _made[path] = PieceTable(path)
        return _made[path]


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_decode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Encodes documents (doc_id, text; other columns are ignored) with begin and end ids, and decodes them again.

    One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with
    `with_ids` ids and decoded. A null text is empty and has the begin and end
    ids only; rows that repeat stay; an empty table gives no rows.
    """
    schema = DIGESTS
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32()))).append(pa.field("decoded", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model)
        for b in batches:
            names, texts = b.column("doc_id"), b.column("text")
            for at in range(0, b.num_rows, 2000):
                rows = []
                for text in texts.slice(at, 2000):
                    ids = np.concatenate([[t.bos], t.encode(text.as_py()), [t.eos]]).astype("<u4")
                    decoded = t.decode(ids)
                    row = (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, ids.tolist(), decoded) if with_ids else row)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([names.slice(at, 2000).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, kind)
