"""Pieces of text that byte-level BPE encodes independently, and a memory of encoded pieces.

The pre-tokenizer's pattern never joins a character with a single space behind it when both
neighbours of that space are no white space: the space opens a new token. Texts are cut there, so
a piece is a word with the space before it, punctuation and line ends included. Repeated pieces are
encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

IRREGULAR = re.compile(r"\s\s|^\s|\s$")


def pieces(text: str) -> list[str]:
    """Pieces whose concatenation is ``text`` and whose encodings concatenate to its encoding."""
    parts = text.split(" ")
    if len(parts) == 1:
        return parts if text else []
    if not IRREGULAR.search(text):
        out = [" " + p for p in parts]
        out[0] = parts[0]
        return out
    out, last = [parts[0]], parts[0]
    for part in parts[1:]:
        if last and part and not last[-1].isspace() and not part[0].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
        last = part
    return out


class Memory(dict):
    """Piece -> its ids as little-endian 32-bit integers; new pieces are encoded together."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 120_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        cut = [pieces(t) for t in texts]
        if len(self) > self.limit:
            self.clear()
        new = [p for p in set().union(*cut) if p not in self]
        self.update(zip(new, self.encode(new), strict=True))
        parts = [b"".join(map(self.__getitem__, c)) for c in cut]
        return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
