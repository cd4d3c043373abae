"""Fill-in-the-middle transformation by secondary-sort assembly.

A text is cut into units (a word with the white space before it; white space at the end is a unit).
Two units chosen by a seeded digest of the id part it into prefix, middle and suffix, and the form
says in which order, behind which marks, the sections are put out. Sections travel as pieces of at
most ``UNITS`` units, keyed by document and place in the output. One shuffle sorted by that key (the
DataFrame form of ``repartitionAndSortWithinPartitions``) brings the pieces of a document one behind
the other, so outputs are digested or joined as they stream past and no document is held whole by
the digests. Restoration reads the output stream alone: it looks for the marks of the form, numbers
what stands between them by its place in the source, and sorts the partition again.

A document is told by its id and a 128-bit hash of its text. Repeated rows of a document are counted
in each task before the shuffle and given back as often as they stood, so a row that fills a third of
the table sends one copy from each task.

Defined results: a null or empty text has no units, the form ``plain`` and an empty output; a text
that holds one of the marks stays plain; a null id is written ``null`` in the seed; an empty table
gives no rows. Only ``doc_id`` (a long) and ``text`` are read; extra columns are left out whatever
their names, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlane.llm.blocks import BLOCK_BYTES, SPACES, table_of, text_blocks, values

UNITS = 512
REMEMBERED = 200_000  # documents whose repeats a task counts before it sends the counts
SEED = 42
PLAIN_FROM = 50  # of 100: the third number of the seed from which a document stays plain
SPM_BELOW = 80  # of 100: the fourth number below which the suffix comes first
PREFIX, MIDDLE, SUFFIX = range(3)
MARKS = {PREFIX: b"<P>", MIDDLE: b"<M>", SUFFIX: b"<S>"}
ORDER = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offset behind each unit of a text."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    if not len(space):
        return np.empty(0, np.int64)
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(space))


def chars(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    raw = np.frombuffer(data, np.uint8)
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def cut(doc_id: int | None, text: bytes, seed: int = SEED) -> tuple[str, np.ndarray, int, int]:
    """(form, unit ends, units of the prefix, units up to the end of the middle) of a document."""
    ends = unit_ends(text)
    name = "null" if doc_id is None else doc_id
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    first, last = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    if not text or h3 % 100 >= PLAIN_FROM or any(m in text for m in MARKS.values()):
        return "plain", ends, first, last
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), ends, first, last


# ---- pieces in output order

PIECE = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.binary()), ("place", pa.int32()), ("copies", pa.int64()), ("n", pa.int64()),
    ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("data", pa.binary()),
])
PIECE_SQL = "doc_id long, text_key binary, place int, copies long, n long, form string, prefix_chars long, middle_chars long, data binary"


def document_pieces(doc_id: int | None, key: bytes, text: bytes, units: int) -> list[tuple]:
    """Rows of ``PIECE`` of a document; the first one has its facts, a mark opens its section's first piece."""
    form, ends, first, last = cut(doc_id, text)
    edge = np.concatenate(([0], ends))
    if form == "plain":
        spans, facts = [(b"", 0, len(ends))], (len(ends), form, None, None)
    else:
        sections = {PREFIX: (0, first), MIDDLE: (first, last), SUFFIX: (last, len(ends))}
        spans = [(MARKS[s], *sections[s]) for s in ORDER[form]]
        facts = (len(ends), form, chars(text[: edge[first]]), chars(text[edge[first] : edge[last]]))
    out: list[tuple] = []
    for mark, a, b in spans:
        for k in range(a, max(b, a + 1), units):
            data = (mark if k == a else b"") + text[edge[k] : edge[min(k + units, b)]]
            out.append((doc_id, key, len(out), 1 if not out else None, *(facts if not out else (None,) * 4), data))
    return out


def _emit(units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: dict[tuple, int] = {}

        def repeats() -> pa.RecordBatch:
            """What has repeated since the last call: counted ahead of the first piece."""
            rows = [(*key, -1, n, None, None, None, None, None) for key, n in again.items() if n]
            again.clear()
            return table_of(rows, PIECE)

        for batch, texts in text_blocks(batches):
            if len(again) > REMEMBERED:
                yield repeats()
            rows: list[tuple] = []
            for doc_id, text in zip(values(batch, "doc_id"), texts, strict=True):
                text = text or b""
                key = (doc_id, xxhash.xxh3_128_digest(text))
                again[key] = again.get(key, -1) + 1
                if not again[key]:
                    rows += document_pieces(*key, text, units)
            yield table_of(rows, PIECE)
        yield repeats()

    return run


def pieces(docs: DataFrame, units: int = UNITS) -> DataFrame:
    """Pieces of all outputs; each document's follow one another in output order within a partition."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return docs.mapInArrow(_emit(units), PIECE_SQL).repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "place")


# ---- streams


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, int, tuple, Iterator[bytes]]]:
    """(key, copies counted ahead, first piece, its data and all that follows) of every document; the
    data must be read before the next document. Other tasks' copies of a piece are counted, not read."""
    for key, group in groupby(_rows(batches), key=lambda r: r[:2]):
        copies, first = 0, None
        for first in group:
            if first[2] == 0:
                break
            copies += first[3]

        counted = [copies + 1]

        def data(first=first, group=group, counted=counted) -> Iterator[bytes]:
            yield first[-1]
            last = 0
            for row in group:
                if row[2] == 0:
                    counted[0] += 1
                elif row[2] > last:
                    last = row[2]
                    yield row[-1]

        yield key, counted, first, data()


class Sections:
    """Parts an output stream at the marks of its form."""

    def __init__(self, form: str):
        self.ahead, self.section, self.held = list(ORDER[form]), PREFIX, b""

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        data = self.held + data
        while self.ahead:
            mark = MARKS[self.ahead[0]]
            at = data.find(mark)
            if at < 0:
                break
            yield self.section, data[:at]
            self.section, data = self.ahead.pop(0), data[at + len(mark) :]
        keep = len(data) - 2 if self.ahead and len(data) > 2 else 0 if self.ahead else len(data)  # a mark may end in the next piece
        self.held = data[keep:]
        yield self.section, data[:keep]

    def close(self) -> Iterator[tuple[int, bytes]]:
        yield self.section, self.held


SOURCE = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.binary()), ("section", pa.int32()), ("number", pa.int32()), ("copies", pa.int64()), ("n", pa.int64()),
    ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("data", pa.binary()),
])
SOURCE_SQL = "doc_id long, text_key binary, section int, number int, copies long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, data binary"


def _flushed(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about a megabyte of their last column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[-1] or b"")
        if size >= BLOCK_BYTES:
            yield table_of(held, schema)
            held, size = [], 0
    yield table_of(held, schema)


def _digest_outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order -> pieces by place in the source, and a row of facts before them."""

    def rows() -> Iterator[tuple]:
        for key, counted, first, stream in _streams(batches):
            n, form, prefix, middle = first[4:8]
            digest, sections, number = hashlib.sha256(), Sections(form), 0
            for data in stream:
                digest.update(data)
                for section, part in sections.feed(data):
                    if part:
                        yield (*key, section, number, *(None,) * 6, part)
                        number += 1
            for section, part in sections.close():
                if part:
                    yield (*key, section, number, *(None,) * 6, part)
            yield (*key, -1, 0, counted[0], n, form, prefix, middle, digest.hexdigest(), None)

    yield from _flushed(rows(), SOURCE)


DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
])
DIGEST_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _digest_restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for key, group in groupby(_rows(batches), key=lambda r: r[:2]):
            facts, digest = next(group), hashlib.sha256()
            for row in group:
                digest.update(row[-1])
            for _ in range(facts[4]):
                yield (key[0], *facts[5:10], digest.hexdigest())

    yield from _flushed(rows(), DIGEST)


def digests(docs: DataFrame, units: int = UNITS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, and digests of the output and of the text
    restored from output and form, for every row of ``docs``."""
    source = pieces(docs, units).mapInArrow(_digest_outputs, SOURCE_SQL)
    return source.sortWithinPartitions("doc_id", "text_key", "section", "number").mapInArrow(_digest_restored, DIGEST_SQL)


OUTPUT = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string())])


def _join_outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for key, counted, first, stream in _streams(batches):
            output = b"".join(stream).decode("utf-8")
            for _ in range(counted[0]):
                yield key[0], first[5], output

    yield from _flushed(rows(), OUTPUT)


def transform(docs: DataFrame, units: int = UNITS) -> DataFrame:
    """doc_id, form and output text of every row of ``docs``; here each text is held whole by its row."""
    return pieces(docs, units).mapInArrow(_join_outputs, "doc_id long, form string, output string")


def restore(output: str, form: str) -> str:
    """The text that became ``output`` in ``form``."""
    sections, parts = Sections(form), {PREFIX: b"", MIDDLE: b"", SUFFIX: b""}
    for section, part in [*sections.feed(output.encode()), *sections.close()]:
        parts[section] += part
    return (parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]).decode()
