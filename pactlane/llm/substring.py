"""Substring deduplication: repeated windows of consecutive words are removed, the first one stays.

Rabin-Karp hashes of every window of ``width`` words are computed per block of documents with
numpy. Inside a block all but the first occurrence of a hash are already known to be repeats, so
only first occurrences travel (a hot passage sends one entry per block). They go, packed per
block and bucket, to the bucket of their minimiser (smallest hash of the word runs inside the
window): equal windows meet, neighbours stay together, and the entries of a bucket are counted
there. Buckets are sized from the bytes of the input. Repeats merge into maximal intervals of
removed words per document, which come back to the texts by document.

Two different windows share a 64-bit hash with a chance of about n**2 / 2**65 over n distinct
windows.

Defined results: null and empty texts have no words and nothing removed; documents shorter than
the window are kept whole. A document is an id and a text (told by its xxhash64): rows that share an
id but not the text are different documents, ordered by text hash. A window is a repeat only if it
also stands at a smaller (id, text hash, position), so exact repeats of a row change nothing. A null
id is taken for the smallest 64-bit id. Extra columns stay as they are (names with two leading
underscores are used here: ``__hash``, ``__n_words``, ``__n_removed``).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlane.llm.blocks import WordHashes, mix, rolling, sheltered, small, stored, text_blocks, values, whole_runs

WIDTH = 20
RUN = 3  # words hashed together for the minimiser
BUCKET_BYTES = 4 << 20  # input text per bucket
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NO_ID = -(1 << 63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _later(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, ordered: bool) -> np.ndarray:
    """Boolean per entry: its key also stands at a smaller (document, place)."""
    by = np.argsort(keys, kind="stable") if ordered else np.lexsort((places, docs, keys))
    head = np.arange(len(by))
    head[1:][keys[by[1:]] == keys[by[:-1]]] = 0
    head = by[np.maximum.accumulate(head)]
    out = np.zeros(len(by), bool)
    out[by] = (docs[by] != docs[head]) | (places[by] != places[head])
    return out


def _ranks(ids: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry's rank among the distinct (id, text hash), and one entry of every rank."""
    by = np.lexsort((texts, ids))
    new = np.ones(len(by), bool)
    new[1:] = (ids[by[1:]] != ids[by[:-1]]) | (texts[by[1:]] != texts[by[:-1]])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    return rank, by[new]


def _flagged(starts: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Per document: start positions of repeats, packed as (first, count) runs."""
    if not len(starts):
        return
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(owner) != 0)) + 1
    first = np.concatenate(([0], cut))
    size = np.diff(np.concatenate((first, [len(starts)])))
    runs = np.stack([starts[first], size], 1).astype(np.int32)
    docs = owner[first]
    edge = np.concatenate(([0], np.flatnonzero(np.diff(docs)) + 1, [len(docs)]))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(docs[a]), runs[a:b].tobytes()


SENT = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("runs", pa.binary())])


def _send(buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in text_blocks(batches):
            ids = np.array([NO_ID if i is None else i for i in values(batch, "doc_id")], np.int64)
            marks = np.array(values(batch, "__hash"), np.int64)
            rank, _ = _ranks(ids, marks)
            order = np.argsort(rank, kind="stable")
            words: list[bytes] = []
            counts = np.zeros(len(ids), np.int64)
            for k, n in enumerate(order):
                own = (texts[n] or b"").split()
                counts[k] = len(own)
                words += own
            ids, marks, rank, h = ids[order], marks[order], rank[order], hashes.of(words)
            starts, owner = whole_runs(counts, width)
            if not len(starts):
                continue
            keys = rolling(h, width)[starts]
            short = min(RUN, width)
            least = _sliding_min(rolling(h, short), width - short + 1)[starts]
            places = starts - (np.cumsum(counts) - counts)[owner]
            again = _later(keys, rank[owner], places, ordered=not (rank[1:] == rank[:-1]).any())
            rows: list[tuple] = []
            home = (mix((ids ^ marks).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            for r, runs in _flagged(places[again], rank[owner[again]]):
                n = int(np.searchsorted(rank, r))
                rows.append((int(home[n]), int(ids[n]), int(marks[n]), None, None, None, None, runs))
            first = np.flatnonzero(~again)
            to = (mix(least[first]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            first, to = first[by], to[by]
            edge = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])) if len(to) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part = first[a:b]
                own, at = owner[part], places[part]
                cut = np.concatenate(([0], np.flatnonzero((np.diff(rank[own]) != 0) | (np.diff(at) != 1)) + 1))
                docs = np.stack([ids[own[cut]], marks[own[cut]]], 1)
                size = np.diff(np.concatenate((cut, [len(part)]))).astype(np.int32)
                rows.append((int(to[a]), 0, 0, keys[part].tobytes(), docs.tobytes(), size.tobytes(), at[cut].astype(np.int32).tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT)

    return run


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: every occurrence of a hash but the earliest document's is a repeat. No id or text
    hash is null here: pandas would turn the column into floats and round it."""
    known = group[group["runs"].notna()]
    sent = group[group["hashes"].notna()]
    out = [(int(d), int(t), r) for d, t, r in zip(known["doc_id"], known["text_hash"], known["runs"], strict=True)]
    if len(sent):
        keys = np.frombuffer(b"".join(sent["hashes"]), np.uint64)
        size = np.frombuffer(b"".join(sent["sizes"]), np.int32)
        heads = np.frombuffer(b"".join(sent["docs"]), np.int64).reshape(-1, 2)
        begin = np.frombuffer(b"".join(sent["places"]), np.int32)
        by = np.argsort(keys, kind="stable")
        same = keys[by[1:]] == keys[by[:-1]]
        member = np.zeros(len(keys), bool)
        member[1:] |= same
        member[:-1] |= same
        some = by[member]
        if len(some):
            run = np.repeat(np.arange(len(size)), size)[some]
            place = begin[run].astype(np.int64) + (some - (np.cumsum(size) - size)[run])
            rank, one = _ranks(heads[:, 0], heads[:, 1])
            doc, key = rank[run], keys[some]
            again = _later(key, doc, place, ordered=False)
            doc, place = doc[again], place[again]
            by = np.lexsort((place, doc))
            out += [(int(heads[one[d], 0]), int(heads[one[d], 1]), r) for d, r in _flagged(place[by], doc[by])]
    ids, texts, runs = zip(*out, strict=True) if out else ((), (), ())
    return pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "text_hash": pd.Series(texts, dtype="int64"), "runs": pd.Series(runs, dtype="object")})


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, runs): packed (first start, count) int32 runs of windows that also start earlier."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, math.ceil(size / BUCKET_BYTES))
    sent = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash")).mapInArrow(
        _send(buckets, width), "bucket long, doc_id long, text_hash long, hashes binary, docs binary, sizes binary, places binary, runs binary"
    )
    found = sent.groupBy("bucket").applyInPandas(_count, "doc_id long, text_hash long, runs binary")
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set("runs").alias("runs"))


def removed_mask(n: int, runs: list[bytes], width: int) -> np.ndarray:
    """Boolean per word: covered by any flagged window."""
    step = np.zeros(n + 1, np.int32)
    for packed in runs:
        pair = np.frombuffer(packed, np.int32).reshape(-1, 2)
        np.add.at(step, pair[:, 0], 1)
        np.add.at(step, np.minimum(pair[:, 0] + pair[:, 1] + width - 1, n), -1)
    return np.cumsum(step[:-1]) > 0


def cut_text(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the removed words; white space before a kept word stays with it."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for (a, b), dropped in zip(spans, gone, strict=True):
        if not dropped:
            out.append(text[last:b])
        last = b
    out.append(text[last:])
    return b"".join(out).lstrip(SPACE) if gone[:1].any() else b"".join(out)


SPACE = b" \t\n\r\x0b\x0c"


def _apply(width: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            removed, n_words, out = [], [], []
            for text, runs in zip(texts, values(batch, "runs"), strict=True):
                words = (text or b"").split()
                gone = removed_mask(len(words), runs, width) if runs else None
                removed.append(int(gone.sum()) if runs else 0)
                n_words.append(len(words))
                if digest:
                    kept = [w for w, g in zip(words, gone, strict=True) if not g] if runs else words
                    out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                else:
                    out.append(cut_text(text, gone) if runs else text)
            rest = [(batch.schema.field(i).name, batch.column(i)) for i in range(batch.num_columns) if batch.schema.field(i).name not in ("runs", "text", "__n_words", "__n_removed")]
            kind = pa.string()
            rest += [("text", pa.array(out, kind) if digest else pa.array(out, pa.binary()).cast(kind)), ("__n_words", pa.array(n_words, pa.int64())), ("__n_removed", pa.array(removed, pa.int64()))]
            yield pa.RecordBatch.from_arrays([c for _, c in rest], names=[n for n, _ in rest])

    return run


@sheltered("doc_id", "text")
def deduplicate(docs: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, any others) with repeated windows cut out of ``text``, plus
    ``__n_words`` and ``__n_removed``. With ``digest`` the text column holds the sha256 of the kept
    words joined by one space instead."""
    found = stored(repeated_windows(docs, width), "repeats")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    others = [c for c in docs.columns if c != "text"]
    size = F.aggregate("runs", F.lit(40), lambda n, r: n + F.length(r) + 16)
    found = found.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "runs")
    same = (F.col("__doc") == F.coalesce("doc_id", F.lit(NO_ID))) & (F.col("__hash") == F.xxhash64("text"))
    joined = docs.join(small(found, size), same, "left")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", text string, __n_words long, __n_removed long"
    return joined.select(*others, "text", "runs").mapInArrow(_apply(width, digest), schema).select(*docs.columns, "__n_words", "__n_removed")
