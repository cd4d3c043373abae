"""Text without case, separators and punctuation, with the way back to the source.

A folded text keeps, for every character, the index of the source character that it came from, as
one integer array; nothing is stored per character as a string.
"""

from __future__ import annotations

import unicodedata

import numpy as np

GONE = "PZ"  # categories that are dropped; with symbols "S" too


class Folder:
    """NFKC and case folding of single characters, separators dropped. Characters are remembered."""

    def __init__(self, symbols: bool = False):
        self.gone = GONE + "S" if symbols else GONE
        self.known: dict[str, str] = {}
        kept = [self.of(chr(k)) for k in range(128)]
        self.ascii = np.array([bool(c) for c in kept])
        self.drop = {k: None for k in range(128) if not kept[k]}

    def of(self, ch: str) -> str:
        found = self.known.get(ch)
        if found is None:
            parts = unicodedata.normalize("NFKC", ch).casefold()
            found = "".join(p for p in parts if unicodedata.category(p)[0] not in self.gone and not p.isspace())
            self.known[ch] = found
        return found

    def fold(self, text: str) -> tuple[str, np.ndarray]:
        """(folded text, source index of each of its characters)."""
        if text.isascii():
            return text.lower().translate(self.drop), np.flatnonzero(self.ascii[np.frombuffer(text.encode(), np.uint8)])
        parts = list(map(self.of, text))
        return "".join(parts), np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))


def starts(value: str, body: str) -> list[int]:
    """Places at which ``value`` starts in ``body``, overlapping ones too."""
    out, at = [], body.find(value) if value else -1
    while at >= 0:
        out.append(at)
        at = body.find(value, at + 1)
    return out


def whole_span(origin: np.ndarray, at: int, size: int) -> tuple[int, int] | None:
    """Half-open source span of a folded run; None if it cuts through a source character."""
    begin, end = int(origin[at]), int(origin[at + size - 1])
    if (at and origin[at - 1] == begin) or (at + size < len(origin) and origin[at + size] == end):
        return None
    return begin, end + 1
