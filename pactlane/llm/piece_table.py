"""Token ids of whole blocks of texts through a table of encoded pieces, in numpy.

A block of texts is one buffer. It is cut at single spaces whose neighbours are no white space (where
the pre-tokenizer opens a new token in any case), every piece is hashed from prefix sums under two
bases, and only pieces that the table does not hold are encoded by the library, many in one call.
Ids are then gathered by offsets. The table holds two 64-bit hashes, an offset and a number of ids for
each piece, no text; when it is full, the pieces that were met longest ago make room.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from pactlane.llm.blocks import mix

LIMIT = 1_500_000  # pieces of a table
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
# First bytes of characters outside ASCII that may be white space; a space beside one is never a cut.
DOUBTFUL = (0xC2, 0xE1, 0xE2, 0xE3)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_AHEAD = _SPACE.copy()
_AHEAD[list(DOUBTFUL)] = True
_WIDE = np.zeros(256, bool)
_WIDE[list(DOUBTFUL[1:])] = True


def solid_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before ``at`` is surely no white space."""
    before = raw[at - 1]
    wide = before >= 0x80  # the last byte of a longer character: its first one tells
    return ~_SPACE[before] & ~(wide & (raw[np.maximum(at - 2, 0)] == 0xC2)) & ~(wide & _WIDE[raw[np.maximum(at - 3, 0)]])


def solid_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character at ``at`` is surely no white space."""
    return ~_AHEAD[raw[at]]


def cut(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts in ``raw``; ``edges`` are the texts' starts and the end."""
    at = np.flatnonzero(raw == 32)
    at = at[(at > 0) & (at + 1 < len(raw))]
    plain = solid_before(raw, at) & solid_at(raw, at + 1)
    # spaces at the rim of a text open no piece of their own
    rim = np.zeros(len(raw) + 1, bool)
    rim[edges] = True
    opens = np.zeros(len(raw) + 1, bool)
    opens[at[plain & ~rim[at] & ~rim[at + 1]]] = True
    opens[edges] = True
    return np.flatnonzero(opens[:-1])


_POWERS: list[list[np.ndarray]] = []


def powers(n: int) -> list[list[np.ndarray]]:
    """Powers of each base and of its inverse, at least ``n`` of them."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        _POWERS.clear()
        for base in BASES:
            both = [np.full(size, b, np.uint64) for b in (base, pow(int(base), -1, 1 << 64))]
            for p in both:
                p[0] = 1
            _POWERS.append([np.multiply.accumulate(p) for p in both])
    return _POWERS


def hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every run of bytes."""
    out = []
    values = raw.astype(np.uint64) + np.uint64(1)
    for up, down in powers(len(raw) + 1):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values * down[: len(raw)], out=sums[1:])
        out.append(mix((sums[stops] - sums[starts]) * up[starts] + (stops - starts).astype(np.uint64)))
    return out[0], out[1]


class Grown:
    """An array that is appended to; room for more is made ahead."""

    def __init__(self, kind: type):
        self.room, self.size = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            self.room = np.concatenate((self.room[: self.size], np.empty(max(need, 2 * self.size) - self.size, self.room.dtype)))
        self.room[self.size : need] = values
        self.size = need

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


FRESH = 1 << 16  # pieces that are looked up apart before they join the sorted rest


class PieceTable:
    """Encoded pieces by hash; ``encode`` takes a buffer and the starts and stops of pieces in it and gives
    (ids of all pieces in a row, number of each). Rows stand in the order of their coming; two sorted
    lists of hashes, a long one and one of the latest pieces, lead to them."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int = LIMIT):
        self.encode, self.limit, self.clock = encode, limit, 0
        self._clear()

    def _clear(self) -> None:
        self.key, self.check, self.stock = Grown(np.uint64), Grown(np.uint64), Grown(np.uint32)
        self.start, self.count, self.met = Grown(np.int64), Grown(np.int32), Grown(np.int32)
        self.sorted = [(np.empty(0, np.uint64), np.empty(0, np.int64))] * 2

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of each piece, -1 if the table does not hold it."""
        out = np.full(len(a), -1)
        for keys, rows in self.sorted:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, a), len(keys) - 1)
                row = rows[at]
                hit = (keys[at] == a) & (self.check.all[row] == b)
                out[hit] = row[hit]
        return out

    def _add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, counts: np.ndarray, met: np.ndarray | int) -> None:
        rows = np.arange(self.key.size, self.key.size + len(a))
        self.start.add(np.cumsum(counts) - counts + self.stock.size)
        for column, new in ((self.key, a), (self.check, b), (self.count, counts), (self.met, np.broadcast_to(met, len(a))), (self.stock, ids)):
            column.add(new)

        def merged(one: tuple, other: tuple) -> tuple:
            keys, rows = (np.concatenate(x) for x in zip(one, other, strict=True))
            order = np.argsort(keys, kind="stable")
            return keys[order], rows[order]

        long, fresh = self.sorted
        fresh = merged(fresh, (a, rows))
        if len(fresh[0]) > FRESH:
            long, fresh = merged(long, fresh), (fresh[0][:0], fresh[1][:0])
        self.sorted = [long, fresh]

    def _forget(self) -> None:
        """Keep the half that was met last."""
        keep = np.sort(np.argsort(self.met.all, kind="stable")[self.met.size // 2 :])
        counts = self.count.all[keep].astype(np.int64)
        old = self.key.all[keep], self.check.all[keep], self.stock.all[spread(self.start.all[keep], counts)], counts, self.met.all[keep]
        self._clear()
        self._add(*old)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate(([0], np.cumsum(size)))
        data = b"".join(texts)
        if not data:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(data, np.uint8)
        starts = cut(raw, edges)
        stops = np.append(starts[1:], len(raw))
        a, b = hashes(raw, starts, stops)
        code, own = pd.factorize(a)
        first = np.empty(len(own), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        self.clock += 1
        row = self._find(own, b[first])
        new = np.flatnonzero(row < 0)
        if len(new):
            at = first[new]
            if self.key.size and self.key.size + len(new) > self.limit:
                self._forget()
                row = self._find(own, b[first])
                new = np.flatnonzero(row < 0)
                at = first[new]
            row[new] = np.arange(self.key.size, self.key.size + len(new))
            self._add(own[new], b[at], *self.encode(raw, starts[at], stops[at]), self.clock)
        self.met.all[row] = self.clock
        row = row[code]
        counts = self.count.all[row].astype(np.int64)
        found = self.stock.all[spread(self.start.all[row], counts)]
        upto = np.concatenate(([0], np.cumsum(counts)))
        place = np.searchsorted(starts, edges)
        return found, np.diff(upto[place])


def spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... (counts[k] numbers) for each k."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - counts), counts)
