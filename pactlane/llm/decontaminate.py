"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton holds every run of words of every item. Document words stream through it; the state
and the length of the longest suffix that occurs in some item are tracked, so each word costs a
constant number of steps. A match of at least ``width`` words ends a window; items shorter than
the window count when all of their words match. Items are grouped into blocks of a bounded number
of words (``BLOCK_WORDS``); each block's words are broadcast and its automaton is built once per
task. Documents pass through the blocks one after another without any shuffle.

Defined results: null and empty texts have no words and no hits; items without words match
nothing; items with a null id mark hits but are not listed; repeated items and documents change
nothing; without items nothing is hit. Extra columns stay (names with two leading underscores are
used here: ``__n_words``, ``__runs``, ``__items``).
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.llm.blocks import sheltered, text_blocks, values

WIDTH = 10
BLOCK_WORDS = 200_000  # benchmark words per automaton, in the mean
MAX_COVERAGE = 0.5  # documents with a larger share of hit words are dropped whole

# A-Z become a-z; every other ASCII character but digits and letters separates words.
NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Automaton:
    """Suffix automaton of all items, with the items of each window and of each short item."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.width = width
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            codes = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            coded.append((item, codes))
            last = 0
            for c in codes:
                last = self._extend(last, c)
        full: dict[int, set] = {}
        short: dict[int, tuple[int, set]] = {}
        for item, codes in coded:
            s = 0
            for i, c in enumerate(codes):
                s = self.next[s][c]
                if i + 1 >= width:
                    s = self._holding(s, width)
                    full.setdefault(s, set()).add(item)
            if 0 < len(codes) < width:
                s = self._holding(s, len(codes))
                short.setdefault(s, (len(codes), set()))[1].add(item)
        self.window: list[set | None] = [None] * len(self.next)
        self.shorts: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.window[s] = full[s] if s in full else self.window[up]
            self.shorts[s] = ((short[s],) if s in short else ()) + self.shorts[up]

    def _holding(self, s: int, size: int) -> int:
        """The state on the suffix path of ``s`` whose strings include the one of ``size`` words."""
        while self.length[self.link[s]] >= size:
            s = self.link[s]
        return s

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for (strings of p) + c, split off when its state also holds longer ones."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged (first, one past last) runs of hit words, and the items met."""
        moves, link, length, width, window, shorts = self.next, self.link, self.length, self.width, self.window, self.shorts
        runs: list[tuple[int, int]] = []
        items: set = set()
        s = size = 0
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                s = size = 0
                continue
            while s and c not in moves[s]:
                s = link[s]
                size = length[s]
            s = moves[s].get(c, 0)
            if not s:
                size = 0
                continue
            size += 1
            hit = 0
            if size >= width:
                hit = width
                items |= window[s]
            if shorts[s]:
                for n, owners in shorts[s]:
                    if n <= size:
                        hit = max(hit, n)
                        items |= owners
            if hit:
                first = i + 1 - hit
                while runs and runs[-1][1] >= first:
                    first = min(first, runs.pop()[0])
                runs.append((first, i + 1))
        return runs, items


_BUILT: dict[str, Automaton] = {}


def _automaton(block, width: int) -> Automaton:
    """One automaton per block and worker; only the last one is kept."""
    key, items = block.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, width)
    return _BUILT[key]


def _scan(block, width: int, finish=None):
    """Add one block's hits to the rows; ``finish`` turns the batches into the last result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanned(batches)
        return finish(found) if finish else found

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(block, width)
        for batch, texts in text_blocks(batches):
            n_words, runs, items = [], [], []
            for text, old_runs, old_items in zip(texts, values(batch, "__runs"), values(batch, "__items"), strict=True):
                words = words_of(text)
                found, met = machine.scan(words)
                n_words.append(len(words))
                runs.append((old_runs or b"") + np.array(found, np.int32).tobytes())
                items.append(sorted({*(old_items or ()), *(i for i in met if i is not None)}))
            keep = [(f.name, batch.column(k)) for k, f in enumerate(batch.schema) if f.name not in ("__n_words", "__runs", "__items")]
            keep += [("__n_words", pa.array(n_words, pa.int64())), ("__runs", pa.array(runs, pa.binary())), ("__items", pa.array(items, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([c for _, c in keep], names=[n for n, _ in keep])

    return run


@sheltered("doc_id", "text")
def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``__n_words``, ``__runs`` (packed int32 pairs of hit words: first, one past last)
    and ``__items`` (ids, as sorted strings, of the items that were met)."""
    return _through_blocks(docs, benchmark, width, block_words)


def _through_blocks(docs: DataFrame, benchmark: DataFrame, width: int, block_words: int, finish=None, finished: str = "") -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / 6 / block_words))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*columns, "__n_words long", "__runs binary", "__items array<string>"])
    out = docs.withColumns({"__n_words": F.lit(None).cast("long"), "__runs": F.lit(None).cast("binary"), "__items": F.lit(None).cast("array<string>")})
    for b in range(blocks):
        rows = items.where(F.col("block") == b).select("item", "text").collect()
        block = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item, words_of(bytes(r.text or b""))) for r in rows]))
        last = finish is not None and b == blocks - 1
        out = out.mapInArrow(_scan(block, width, finish), finished) if last else out.mapInArrow(_scan(block, width), schema)
    return out


def hit_words() -> Column:
    """Number of hit words of a row of ``matches``."""
    return F.pandas_udf(_hit_words, "long")("__runs")


def merged(packed: bytes) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, np.frombuffer(packed, np.int32).reshape(-1, 2).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hit_words(runs: pd.Series) -> pd.Series:
    return runs.map(lambda packed: sum(b - a for a, b in merged(packed)) if packed else 0)


def _cut(max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            keep, out = [], []
            for n, (text, packed, n_words) in enumerate(zip(texts, values(batch, "__runs"), values(batch, "__n_words"), strict=True)):
                runs = merged(packed)
                if not runs:
                    keep.append(n)
                    out.append(text)
                elif sum(b - a for a, b in runs) <= max_coverage * n_words:
                    spans = [m.span() for m in WORD.finditer(text)]
                    parts, last = [], 0
                    for a, b in runs:
                        parts.append(text[last : spans[a][0]])
                        last = spans[b][0] if b < len(spans) else spans[b - 1][1]
                    keep.append(n)
                    out.append(b"".join([*parts, text[last:]]))
            part = batch.take(pa.array(keep, pa.int64()))
            rest = [(f.name, part.column(k)) for k, f in enumerate(part.schema) if f.name not in ("text", "__n_words", "__runs", "__items")]
            rest.append(("text", pa.array(out, pa.binary()).cast(pa.string())))
            yield pa.RecordBatch.from_arrays([c for _, c in rest], names=[n for n, _ in rest])

    return run


@sheltered("doc_id", "text")
def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with hit words cut out of ``text``; documents with more than ``max_coverage`` of
    their words hit are dropped. Documents without hits keep their text as it is."""
    others = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "text string"])
    return _through_blocks(docs, benchmark, width, BLOCK_WORDS, _cut(max_coverage), schema).select(*docs.columns)
