"""Token ids in files of canonical, length-limited Huffman codes.

Layout of a folder (Parquet, so that Spark's own writer commits it on any store):

* ``code``: symbol, length. Lengths come from the global counts of all ids by package-merge, at most
  ``LIMIT`` bits; the codes follow from the lengths (canonical order: length, symbol).
* ``parts``: part, start. Parts are ranges of document ids; start counts the ids of all parts before.
* ``blocks``: part, block, start (ids of the part before the block), docs and counts (packed ids of
  the documents and their numbers of tokens), bits (each document starts on a byte, most significant
  bit first) and checkpoints (bit offsets of every ``STRIDE``-th token of each document). Blocks
  decode on their own, and within a block all checkpoints decode side by side through one table.

Texts are encoded once by the tokenizers library, every distinct piece of a task only once; the end
id closes each document. Documents are coded before they are shuffled into ranges, so the shuffle
carries the compressed bits. A document is never cut, and a block closes after ``BLOCK_TOKENS``.

Defined results: a null or empty text has the end id only; null ids come first (as the smallest
integer, given back as null), equal ids follow each other by text hash; an empty table gives empty
files. Extra columns are left out.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlane.llm.blocks import small, stored, table_of, text_blocks, values
from pactlane.llm.bpe import byte_letters
from pactlane.llm.piece_table import PieceTable, solid_at, solid_before, spread

LIMIT = 18
STRIDE = 256
BLOCK_TOKENS = 1 << 20
PART_TOKENS = 1 << 22  # tokens of a range of documents, in the mean
JOINED = 1 << 12  # characters of pieces encoded in one call
NO_ID = -(1 << 63)


# ---- codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for symbols without counts."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    by = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[by].astype(np.float64)
    level, kinds = leaves, [np.ones(len(by), bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate((leaves, level[0:even:2] + level[1:even:2]))
        order = np.argsort(both, kind="stable")
        level = both[order]
        kinds.append(order < len(by))
    take = 2 * len(by) - 2
    for leaf in reversed(kinds):
        n = int(leaf[:take].sum())
        lengths[by[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """Codes of the symbols and the table that decodes them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.limit = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = np.left_shift(1, self.limit - lengths[order])
        first = np.cumsum(size) - size
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.limit - lengths[order])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.width = np.ones(1 << self.limit, np.int64)
        self.symbol[: int(size.sum())] = np.repeat(order, size)
        self.width[: int(size.sum())] = np.repeat(lengths[order], size)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
        """(bits, checkpoints) of each run of ids."""
        if not len(ids):
            return [(b"", b"")] * len(counts)
        width = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(width)))
        edge = np.concatenate(([0], np.cumsum(counts)))
        size = (ends[edge[1:]] - ends[edge[:-1]] + 7) // 8  # bytes of each document
        begin = np.cumsum(size) - size
        place = ends[:-1] + np.repeat(8 * begin - ends[edge[:-1]], counts)
        word, bit = place >> 5, (place & 31).astype(np.uint64)
        both = self.codes[ids] << (np.uint64(64) - bit - width.astype(np.uint64))
        n = int(size.sum()) // 4 + 3
        # bits of a word never overlap, and their sum below 2**32 is exact in a double
        words = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        data = words.astype(">u4").tobytes()
        out = []
        for k, n in enumerate(counts.tolist()):
            marks = place[edge[k] : edge[k] + n : STRIDE] - 8 * begin[k]
            out.append((data[begin[k] : begin[k] + size[k]], marks.astype("<u8").tobytes()))
        return out

    def decode(self, bits: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All ids of a block; ``checkpoints`` hold bit offsets into ``bits``, ``counts`` the ids of each document."""
        total = int(counts.sum())
        out = np.empty(total, np.uint32)
        if not total:
            return out
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        lanes = -(-counts // STRIDE)
        number = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        size = np.minimum(STRIDE, np.repeat(counts, lanes) - number * STRIDE)
        to = np.repeat(np.cumsum(counts) - counts, lanes) + number * STRIDE
        by = np.argsort(-size, kind="stable")
        size, to, place = size[by], to[by], checkpoints[by].astype(np.int64)
        active = np.searchsorted(-size, -np.arange(STRIDE), side="left")  # lanes longer than each step
        shift = np.uint32(32 - self.limit)
        for step in range(int(size[0])):
            m = active[step]
            p = place[:m]
            peek = (window[p >> 3] << (p & 7).astype(np.uint32)) >> shift
            out[to[:m] + step] = self.symbol[peek]
            place[:m] = p + self.width[peek]
        return out


# ---- tokens


class Encoder:
    """The library's encoding without offsets, of many pieces in one call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.size = np.zeros(max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1, np.int64)
        for name, k in spec["model"]["vocab"].items():
            self.size[k] = len(name) if all(c in letters for c in name) else len(name.encode())
        for t in spec["added_tokens"]:
            self.size[t["id"]] = len(t["content"].encode())
        self.table = PieceTable(self.encode_pieces)

    def encode_pieces(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of each). Pieces that open with a space may stand one behind
        the other: many are encoded as one text, whose tokens are told apart by their bytes."""
        length = stops - starts
        # a single space before a character that is none, and no white space at the end
        joins = (length > 1) & (raw[starts] == 32) & solid_at(raw, np.minimum(starts + 1, len(raw) - 1)) & solid_before(raw, stops)
        own, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        counts, found = np.zeros(len(starts), np.int64), []
        ends = np.cumsum(length[own])
        data = raw[spread(starts[own], length[own])].tobytes()
        groups = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(own) else 0, JOINED), side="left")
        edges = np.append(groups, len(own))  # pieces of a text encoded in one call
        bounds = np.concatenate(([0], ends))[edges]
        texts = [data[s:e].decode("utf-8") for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k, e in enumerate(self.library.encode_batch_fast(texts, add_special_tokens=False)):
            group = own[edges[k] : edges[k + 1]]
            ids = np.array(e.ids, np.uint32)
            stop = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(length[group]), side="left") + 1
            counts[group] = np.diff(stop, prepend=0)
            found.append(ids)
        single = [raw[s:e].tobytes().decode("utf-8") for s, e in zip(starts[alone].tolist(), stops[alone].tolist(), strict=True)]
        for k, e in zip(alone, self.library.encode_batch_fast(single, add_special_tokens=False), strict=True):
            counts[k] = len(e.ids)
            found.append(np.array(e.ids, np.uint32))
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        # back into the order of the pieces
        order = np.concatenate((own, alone))
        begin = np.empty(len(starts), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return ids[spread(begin, counts)], counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ids: np.ndarray) -> bytes:
    """Byte planes of the ids, compressed: high bytes are few and repeat."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return b"".join(len(z).to_bytes(4, "little") + z for z in (zlib.compress(planes[:, k].tobytes(), 1) for k in range(4)))


def unpack(data: bytes) -> np.ndarray:
    planes, at = [], 0
    for _ in range(4):
        n = int.from_bytes(data[at : at + 4], "little")
        planes.append(np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + n]), np.uint8))
        at += 4 + n
    return np.stack(planes, 1).reshape(-1).view("<u4")


TOKENS = pa.schema([("docs", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])


def _tokens(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch, texts in text_blocks(batches):
            found, counts = own.table.ids([t or b"" for t in texts])
            ids = np.full(len(found) + len(counts), end, "<u4")
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(counts + 1) - 1] = False  # the end id of each document
            ids[inner] = found
            docs = np.array([NO_ID if d is None else d for d in values(batch, "doc_id")], np.int64)
            hashes = np.array(values(batch, "text_hash"), np.int64)
            yield table_of([(docs.tobytes(), hashes.tobytes(), (counts + 1).tobytes(), pack(ids))], TOKENS)

    return run


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in values(batch, "ids"):
                total += np.bincount(unpack(data), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["symbol", "n"])

    return run


CODED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("checkpoints", pa.binary())])


def _coded(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Code(code.value)
        for batch in batches:
            for docs, hashes, counts, data in zip(*(values(batch, n) for n in ("docs", "hashes", "counts", "ids")), strict=True):
                counts = np.frombuffer(counts, np.int64)
                coded = own.encode(unpack(data), counts)
                rows = zip(np.frombuffer(docs, np.int64).tolist(), np.frombuffer(hashes, np.int64).tolist(), counts.tolist(), coded, strict=True)
                yield table_of([(d, h, n, *c) for d, h, n, c in rows], CODED)

    return run


BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary()), ("checkpoints", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded documents of a part in order -> blocks."""
    part, block, start, size, n, held = None, 0, 0, 0, 0, []

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal block, start, size, n, held
        if held:
            marks = [np.frombuffer(c, "<u8") + np.uint64(8 * at) for *_, c, at in held]
            row = (part, block, start, np.array([h[0] for h in held], np.int64).tobytes(), np.array([h[1] for h in held], np.int64).tobytes(), b"".join(h[2] for h in held), np.concatenate(marks).tobytes())
            yield table_of([row], BLOCK)
            block, start, size, n, held = block + 1, start + n, 0, 0, []

    for batch in batches:
        for p, doc, count, bits, marks in zip(*(values(batch, k) for k in ("part", "doc_id", "n", "bits", "checkpoints")), strict=True):
            if p != part:
                yield from close()
                part, block, start = p, 0, 0
            held.append((doc, count, bits, marks, size))
            size += len(bits)
            n += count
            if n >= BLOCK_TOKENS:
                yield from close()
    yield from close()


def write(docs: DataFrame, tokenizer: str, folder: str, end: int) -> None:
    """Encode ``text`` of ``docs`` (doc_id, text) in ascending order of ids into ``folder``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    tokens = stored(docs.mapInArrow(_tokens(tokenizer, end), "docs binary, hashes binary, counts binary, ids binary"), "tokens")
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    size = max([end, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    counted = tokens.select("ids").mapInArrow(_count(size), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[counted.column("symbol").to_numpy()] = counted.column("n").to_numpy()
    lengths = code_lengths(counts)
    code = spark.createDataFrame(pa.table({"symbol": np.arange(size), "length": lengths}))
    code.write.parquet(f"{folder}/code")

    parts = max(1, int(counts.sum()) // PART_TOKENS)
    cuts: list[int] = []
    if parts > 1:
        found = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [(k + 1) / parts for k in range(parts - 1)], 10_000)).first()[0]
        cuts = sorted(set(found or []))
    coded = tokens.mapInArrow(_coded(spark.sparkContext.broadcast(lengths)), "doc_id long, text_hash long, n long, bits binary, checkpoints binary")
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    ordered = coded.withColumn("part", part).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "text_hash")
    blocks = ordered.mapInArrow(_blocks, "part int, block long, start long, docs binary, counts binary, bits binary, checkpoints binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")

    sizes = spark.read.parquet(f"{folder}/blocks").select("part", "counts").mapInArrow(_sizes, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()
    total, rows = 0, []
    for p, n in sorted((r.part, r.n) for r in sizes):  # one row for each range
        rows.append((p, total))
        total += n
    spark.createDataFrame(rows, "part int, start long").write.parquet(f"{folder}/parts")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(np.frombuffer(c, np.int64).sum()) for c in values(batch, "counts")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["part", "n"])


def _read(code, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Code(code.value)
        for batch in batches:
            for base, start, docs, counts, bits, marks in zip(*(values(batch, k) for k in ("base", "start", "docs", "counts", "bits", "checkpoints")), strict=True):
                counts = np.frombuffer(counts, np.int64)
                ids = own.decode(bits, np.frombuffer(marks, "<u8"), counts).astype("<u4")
                edge = np.concatenate(([0], np.cumsum(counts)))
                doc = [None if d == NO_ID else d for d in np.frombuffer(docs, np.int64).tolist()]
                out = [pa.array(doc, pa.int64()), pa.array(base + start + edge[:-1]), pa.array(counts)]
                if digest:
                    data = ids.tobytes()
                    out.append(pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.int64()))
                else:
                    out.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of int) of every document in ``folder``; with ``digest``
    ids_crc32 (of the ids as little-endian 32-bit integers) instead of the ids."""
    code = spark.read.parquet(f"{folder}/code").orderBy("symbol").toArrow()
    sent = spark.sparkContext.broadcast(code.column("length").to_numpy())
    parts = spark.read.parquet(f"{folder}/parts").withColumnRenamed("start", "base")
    blocks = spark.read.parquet(f"{folder}/blocks").join(small(parts), "part")
    last = "ids_crc32 long" if digest else "ids array<int>"
    return blocks.mapInArrow(_read(sent, digest), f"doc_id long, start long, n_tokens long, {last}")
