"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (LZ78: each phrase is the shortest run of characters not
met as a phrase before). The set of phrases is hashed and its ``KEPT`` smallest hashes are the
fingerprint; the likeness of two fingerprints is the share of the smallest hashes of their union
that both hold, an estimate of the Jaccard similarity of the phrase sets, which follows how well
one text compresses with the other's dictionary.

``with_neighbours`` also puts every document beside the next one in an order without collecting the
order anywhere: ids are cut into ranges, only each range's last document is sent along to the range
before it, and a range is read through once, sorted.

Defined results: a null text is empty; the fingerprint of an empty text is the empty string, and two
empty fingerprints have likeness 1, an empty and another one 0; equal texts have equal
fingerprints. Rows with equal ids follow each other by text, a null id comes last; exact repeats of
a row are neighbours. A single row is its own neighbour. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlane.llm.blocks import mix, rolling_sums, small, stored, table_of, text_blocks, values

KEPT = 64
RANGE_BYTES = 8 << 20  # text of a range, in the mean
HASH = np.dtype(">u4")


class Phrases:
    """LZ78 parse that can be continued: phrases so far and the run that is not yet a phrase."""

    def __init__(self, phrases: dict | None = None, rest: str = ""):
        self.phrases, self.rest = dict(phrases) if phrases else {}, rest

    def feed(self, text: str) -> Phrases:
        known, run = self.phrases, self.rest
        for c in text:
            run += c
            if run not in known:
                known[run] = None
                run = ""
        self.rest = run
        return self

    def copy(self) -> Phrases:
        return Phrases(self.phrases, self.rest)

    def fingerprint(self, kept: int = KEPT) -> str:
        """Hexadecimal text of the smallest distinct 32-bit hashes of the phrases, ascending."""
        if not self.phrases:
            return ""
        h = _hashes(list(self.phrases))
        if len(h) > 4 * kept:
            h = np.partition(h, 2 * kept)[: 2 * kept]  # equal hashes leave fewer than 2 kept only by chance
        return np.unique(h)[:kept].astype(HASH).tobytes().hex()


def _hashes(phrases: list[str]) -> np.ndarray:
    """32-bit hash of each phrase: polynomial over its code points, from prefix sums of all of them."""
    text = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, phrases), np.int64, len(phrases))
    end = np.cumsum(size)
    return (mix(rolling_sums(text + np.uint64(1), end - size, end) + size.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def likeness(a: str, b: str, kept: int = KEPT) -> float:
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(v), HASH) for v in (a, b))
    least, first = np.unique(np.concatenate((x, y)), return_counts=True)
    return float((first[:kept] == 2).mean())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bool, str]]:
    for batch, texts in text_blocks(batches):
        for part, doc, sent, text in zip(values(batch, "part"), values(batch, "doc_id"), values(batch, "sent"), texts, strict=True):
            yield part, doc, sent, (text or b"").decode("utf-8")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range, largest id first and the sent neighbour last; a row is done when the next is known."""
    rows: list[tuple] = []
    ahead: tuple | None = None  # the row that waits: id, text, start of the last third, parse up to it, fingerprint
    where: int | None = None

    def parsed(doc, text: str) -> tuple:
        cut = len(text) - len(text) // 3
        head = Phrases().feed(text[:cut])
        return doc, text, cut, head, head.copy().feed(text[cut:]).fingerprint()

    def done(row: tuple, text: str, mark: str) -> None:
        doc, own, cut, head, print_ = row
        put = text[: len(own) - cut]
        edited = head.feed(put).fingerprint()
        digest = hashlib.sha256((own[:cut] + put).encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((doc, len(own), digest, print_, edited, likeness(print_, edited), likeness(print_, mark)))

    for part, doc, sent, text in _rows(batches):
        if part != where:
            ahead, where = None, part
        if sent:
            if ahead:
                done(ahead, text, Phrases().feed(text).fingerprint())
            ahead = None
            continue
        now = parsed(doc, text)
        if ahead:
            done(ahead, text, now[4])
        ahead = now
        if len(rows) >= 1000:
            yield table_of(rows, OUT)
            rows = []
    yield table_of(rows, OUT)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of the next one by descending id, and of the edited text (the
    last third replaced by the next document's beginning)."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    docs = docs.select("doc_id", "text")
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    parts = max(1, (size or 0) // RANGE_BYTES)
    bounds = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [(k + 1) / parts for k in range(parts - 1)] or [1.0], 10_000)).first()[0] or []
    cuts = sorted(set(bounds)) if parts > 1 else []
    # ranges hold the ids above a cut; null ids go to the lowest one
    part = F.lit(0)
    if cuts:
        part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))), F.lit(0))
    docs = docs.select("doc_id", "text", part.cast("int").alias("part"))
    order = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    tops = stored(docs.groupBy("part").agg(F.max(order).alias("top")), "tops")
    places = [r.part for r in tops.select("part").orderBy("part").collect()]
    before = {p: places[(k + 1) % len(places)] for k, p in enumerate(places)}  # its first row follows the last row of that range
    to = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("part"))
    sent = tops.select(to.alias("to"), F.col("top.doc_id").alias("t_id"), F.col("top.h").alias("t_h"))
    heads = docs.join(small(sent, 64), F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.xxhash64("text") == F.col("t_h")))
    heads = heads.select("doc_id", "text", F.col("to").alias("part"), F.lit(True).alias("sent")).dropDuplicates(["part"])
    both = docs.select("doc_id", "text", "part", F.lit(False).alias("sent")).unionByName(heads)
    both = both.repartition(max(len(places), 1), "part").sortWithinPartitions("part", "sent", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    return both.mapInArrow(_compare, schema)
