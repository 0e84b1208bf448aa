"""Token counts under a unigram vocabulary, without the tokens.

An automaton enumerates the vocabulary's matches in a word; a Viterbi pass
carries, for each place, the best score of a segmentation that ends there and
how many pieces it has. Ties are those of the `tokenizers` library's unigram
model: of equal scores the segmentation found first stands, and they are found
in order of the last piece's start, so the longest last piece wins. A character
that no single-character piece matches may be taken as unknown, at the lowest
score less 10; unknown characters in a row are one token, or with byte fallback
their UTF-8 bytes.

Words are cut before space marks, which no piece has inside; with the integer
scores of the public vocabularies all sums are exact, so words are independent.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cloakframe.llm.shared import take_turn

MARK = "▁"
#: What an unknown character costs beyond the lowest score (a fixed value of unigram tokenizers).
UNKNOWN_PENALTY = 10.0
CACHE = 500_000
LONGEST = 64

_made: dict[str, UnigramCounter] = {}
_lock = threading.Lock()


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class UnigramCounter(dict):
    """Counts the tokens of texts; itself the cache from word (without its space mark) to count."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        super().__init__()
        import ahocorasick

        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a vocabulary with space marks inside pieces isn't supported")
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()

    def count(self, word: str) -> int:
        """The number of tokens of the best segmentation of a word with its space marks."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = bytearray(n)
        for end, (length, score) in self.automaton.iter(word):
            ends[end + 1].append((end + 1 - length, score))
            if length == 1:
                single[end] = 1
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), bytearray(n + 1)
        for end in range(1, n + 1):
            top, at, odd = None, 0, 0
            for start, score in sorted(ends[end]):
                if top is None or best[start] + score > top:
                    top, at, odd = best[start] + score, start, 0
            if not single[end - 1] and (top is None or best[end - 1] + self.unknown > top):
                top, at, odd = best[end - 1] + self.unknown, end - 1, 1
            best[end], unknown[end] = top, odd
            if not odd:
                pieces[end] = pieces[at] + 1
            elif self.byte_fallback:
                pieces[end] = pieces[at] + len(word[at].encode())
            else:
                pieces[end] = pieces[at] + (not unknown[at])
        return pieces[n]

    def __missing__(self, word: str) -> int:
        n = self.count(word if word.startswith(MARK) else MARK + word)
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def text(self, text: str | None) -> int:
        """Tokens of a text whose spaces are space marks, with one in front; none for a null or empty text."""
        if not text:
            return 0
        if len(self) > CACHE:
            self.clear()
        if "  " in text or text[0] == " " or MARK in text:
            words = re.findall("▁+[^▁]*", MARK + text.replace(" ", MARK))
        else:
            words = text.split(" ")
        return sum(map(self.__getitem__, words))


def counter(path: str) -> UnigramCounter:
    """The worker's counter for this vocabulary; its cache lives as long as the worker."""
    with _lock:
        take_turn("counts", _made.clear)
        if path not in _made:
            _made[path] = UnigramCounter(vocabulary(path))
        return _made[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every document (doc_id, text; other columns are ignored).

    Null and empty texts have 0 tokens; rows that repeat stay; a null doc_id
    stays null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.text(t.as_py()) for t in b.column("text")], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
