"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; everything but letters counts as one blank, so a text becomes words
between blanks. N-grams of 1 to 3 characters are hashed into ``BUCKETS`` counters (one of them only
of blanks is left out). Training counts them per language in Spark, from at most about ``MAX_TRAIN``
labelled texts picked by a hash of the id; rows whose crc32(doc_id) mod 5 is 0 are never read. The
log-probability matrix (languages x buckets, single precision; its size is checked) is broadcast;
a block of texts is scored as one gather and one segmented sum in numpy.

The score is the posterior of the predicted language with the log-likelihood divided by a temper
that grows with the text, so that it stays below 1 for doubtful texts.

Defined results: a text that is null or has no letter is ``und`` with score 0; null languages are
not learned; ties go to the language that sorts first; without any labelled text all are ``und``
with score 0. Repeated rows are predicted alike, extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlane.llm.blocks import fold, mix, sheltered, stored, text_blocks, values

BUCKETS = 1 << 16
MAX_TRAIN = 20_000
SMOOTH = 0.5
MAX_MATRIX = 256 << 20  # bytes of the log-probability matrix
SLICE = 400_000  # characters scored at a time

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for anything else (built once from Unicode)."""
    if not _LETTER:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(table)
    return _LETTER[0]


def codes(text: bytes | None) -> np.ndarray:
    """Letters in lower case and single zeros for what is between them; empty without letters."""
    if not text:
        return np.empty(0, np.uint32)
    x = _letters()[np.frombuffer(text.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = x != 0
    if not keep.any():
        return np.empty(0, np.uint32)
    keep[1:] |= x[:-1] != 0
    x = x[keep]
    return np.concatenate(([0], x)) if x[0] else x


def grams(x: np.ndarray) -> np.ndarray:
    """Buckets of the 1- to 3-grams of ``codes``."""
    x = x.astype(np.uint64)
    two = x[:-1] * np.uint64(0x200000) + x[1:]
    three = two[:-1] * np.uint64(0x200000) + x[2:]
    every = np.concatenate((mix(x[x != 0] + np.uint64(1 << 62)), mix(two[two != 0] + np.uint64(1 << 63)), mix(three)))
    return (every & np.uint64(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])
        counts.clear()

    for batch, texts in text_blocks(batches):
        for text, lang in zip(texts, values(batch, "lang"), strict=True):
            g = grams(codes(text))
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            counts[lang] += np.bincount(g, minlength=BUCKETS)
        if len(counts) > 100:
            yield from flush()
    yield from flush()


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """{"langs", "matrix"} from ``docs`` (doc_id, text, lang)."""
    usable = docs.select("doc_id", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    n = usable.count()
    if not n:
        return {"langs": [], "matrix": np.zeros((BUCKETS, 0), np.float32)}
    texts = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    texts = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_train)
    counted = texts.select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long")
    counted = stored(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    langs = [r.lang for r in counted.select("lang").distinct().orderBy("lang").limit(MAX_MATRIX // (4 * BUCKETS) + 1).collect()]
    if len(langs) * BUCKETS * 4 > MAX_MATRIX:
        raise ValueError("more languages than the matrix has room for")
    table = np.zeros((BUCKETS, len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    for rows in counted.toArrow().to_batches():
        table[rows.column("bucket").to_numpy(), [place[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    total = table.sum(0) + SMOOTH * BUCKETS
    return {"langs": langs, "matrix": np.log((table + SMOOTH) / total).astype(np.float32)}


def classify(texts: list[bytes | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """(language, score) of each text; sums are taken over slices of bounded length."""
    sums, sizes = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    waiting: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if waiting:
            size = np.array([len(g) for _, g in waiting])
            rows = matrix[np.concatenate([g for _, g in waiting])]
            part = np.add.reduceat(rows, np.cumsum(size) - size, axis=0, dtype=np.float64)
            np.add.at(sums, [k for k, _ in waiting], part)
            waiting.clear()

    load = 0
    for k, text in enumerate(texts):
        g = grams(codes(text))
        sizes[k] = len(g)
        for a in range(0, len(g), SLICE):
            waiting.append((k, g[a : a + SLICE]))
            load += len(waiting[-1][1])
            if load >= SLICE:
                flush()
                load = 0
    flush()
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    tempered = sums / np.sqrt(np.maximum(sizes, 1))[:, None]
    best = tempered.argmax(1)
    p = 1 / np.exp(tempered - tempered.max(1, keepdims=True)).sum(1)
    return [langs[b] if s else "und" for b, s in zip(best, sizes, strict=True)], np.where(sizes > 0, p, 0.0).tolist()


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value["langs"], model.value["matrix"]
        for batch, texts in text_blocks(batches):
            named, scores = classify(texts, langs, matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "__lang", "__score"])

    return run


@sheltered("doc_id", "text")
def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``__lang`` and ``__score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(_predict(sent), ", ".join([*columns, "__lang string, __score double"]))
