"""Exact, cached encoding with a public byte-level BPE file.

A byte-level BPE tokenizer first cuts a text into words by a fixed pattern and
never merges across the cuts. Words repeat, hence a bounded cache per Python
worker answers most of them; unseen words go to the BPE model of the
`tokenizers` library.

The cut is made here only where both regex engines are certain to agree on what
a letter, a digit or a space is (`PLAIN`); any other text goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import threading
from array import array

import numpy as np

from cloakframe.llm.shared import take_turn

#: Characters with the same class in every Unicode version, without the numerals that are no digits.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧]*")
#: The word pattern of byte-level BPE (a fixed value), with Python's names for the classes.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Entries of the word cache of one worker; it starts afresh when full. Longer words are not kept.
CACHE = 750_000
LONGEST = 64

_made: dict[str, WordEncoder] = {}
_lock = threading.Lock()


def default_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level BPE vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordEncoder(dict):
    """ids of texts under one tokenizer file, as little-endian arrays; itself the cache from word to packed ids.

    Null and empty texts have no ids. Strings of special tokens in a text get
    the library's default handling, as such a text is encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        small = self.tokenizer.get_vocab_size() <= 65536
        self.width, self.code = (np.dtype("<u2"), "H") if small else (np.dtype("<u4"), "I")
        self.letters = str.maketrans(dict(byte_letters()))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, [t.id for t in self.bpe.tokenize(spelled)]).tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.width)
        if not PLAIN.fullmatch(text) or (self.special is not None and self.special.search(text)):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width)
        if len(self) > CACHE:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, WORD.findall(text))), dtype=self.width)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this file; its cache lives as long as the worker."""
    with _lock:
        take_turn("tokens", _made.clear)
        if path not in _made:
            _made[path] = WordEncoder(path)
        return _made[path]
