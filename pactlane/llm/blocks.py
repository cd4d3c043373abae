"""Helpers of the text operators: bounded blocks of texts, word hashes and scratch tables.

Arrow batches are cut into blocks of about a megabyte of text, so a task's Python memory
does not depend on the batch size or on how long the texts are (one text is never cut).
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlane.session import ensure_checkpoint_dir

BLOCK_BYTES = 1 << 20
SPACES = bytes(range(9, 14)) + b" "


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task without the last one's batches."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(slice of a batch, its texts as bytes or None) for runs of rows of about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        start = 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()
            start = stop
    give_back()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class WordHashes(dict):
    """64-bit hash of a word, remembered for repeated words; forgotten when it has grown."""

    def __init__(self, seed: int = 0, limit: int = 150_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64, odd base) of every run of ``width`` values of ``h``."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * down, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * up[: n - width + 1] + np.uint64(width))


def rolling_sums(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``h[a:b]`` for each pair of ``start`` and ``stop``, independent of its place."""
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * down[: len(h)], out=sums[1:])
    return (sums[stop] - sums[start]) * up[start]


def whole_runs(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``width`` that stay within one document, and each one's document."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(owner) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(owner[width - 1 :] == owner[: len(owner) - width + 1])
    return starts, owner[starts]


def sheltered(*own: str):
    """For an operator on a table with any further columns: those get plain names inside and their own
    names again in its result, so none can clash and dots do no harm. A column of the input that has
    the name of a result column comes back as ``<name>_input``. ``own`` are the columns it reads."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            names = docs.columns
            inner = [c if c in own else f"extra_{k}_" for k, c in enumerate(names)]
            if inner == names:
                return fn(docs, *args, **options)
            out = fn(docs.toDF(*inner), *args, **options)
            made = set(out.columns) - set(inner)
            back = {i: f"{c}_input" if c in made else c for i, c in zip(inner, names, strict=True)}
            return out.toDF(*[back.get(c, c) for c in out.columns])

        return run

    return wrap


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 48 << 20


def small(df: DataFrame, row_bytes: Column | int = 16, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a stored table, so cheap to measure) for the small side of a join. Measured up to
    ``limit`` bytes it is broadcast; beyond, it is left as it is and Spark shuffles both sides."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out of all training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5
