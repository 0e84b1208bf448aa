"""Many literal replacements in one pass over a text."""

from __future__ import annotations

import ahocorasick


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


class Replacer:
    """Replaces needles by their values: leftmost first, then the longest; what was put in isn't looked at again.

    With `strict`, a needle of letters, digits and underscores only matches as a whole word.
    """

    def __init__(self, pairs: dict[str, str], strict: bool = True):
        self.pairs = {k: v for k, v in pairs.items() if k}
        self.whole = {k for k in self.pairs if strict and all(map(_wordy, k))}
        self.automaton = None
        if self.pairs:
            self.automaton = ahocorasick.Automaton()
            for k in self.pairs:
                self.automaton.add_word(k, k)
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """All places (start, end, needle) where a needle may stand, overlapping ones too."""
        if self.automaton is None:
            return []
        out = []
        for last, k in self.automaton.iter(text):
            start, end = last + 1 - len(k), last + 1
            if k not in self.whole or not (start and _wordy(text[start - 1]) or end < len(text) and _wordy(text[end])):
                out.append((start, end, k))
        return out

    def replace(self, text: str) -> tuple[str, int]:
        """The new text and the number of replacements."""
        return splice(text, [(a, b, self.pairs[k]) for a, b, k in self.hits(text)])


def splice(text: str, hits: list[tuple[int, int, str]]) -> tuple[str, int]:
    """Puts values at places, leftmost first, then the longest."""
    out, at, n = [], 0, 0
    for start, end, value in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start >= at:
            out += [text[at:start], value]
            at, n = end, n + 1
    return ("".join(out) + text[at:], n) if n else (text, 0)
