"""Toxicity by maximum-scoring segments over token log-odds.

Learning: words of labelled texts are counted by class in Spark (document counts, over distinct
texts). The log-odds of a word between the classes use an informative Dirichlet prior (prior counts
in proportion to the word's overall frequency); words whose odds exceed ``MIN_Z`` standard
deviations form the lexicon (at most ``LEXICON`` words, the most certain ones). Every other word
scores ``-DRIFT``, so that scores fall in ordinary text.

Scoring: one linear scan finds every maximal-scoring segment (Ruzzo and Tompa, 1999). Under the word
distribution of clean texts, segment scores follow an extreme-value law: ``E = K m exp(-rate S)``
segments of score S or more are expected in m words, where ``rate`` solves ``sum p exp(rate s) = 1``
and K is the chance that a word starts a segment. Segments with E below ``SIGNIFICANT`` are the toxic
passages. The best E and the number of passages go through a logistic map fitted to the same
labelled texts.

Training reads at most about ``MAX_TRAIN`` labelled texts, picked by a hash of the id; rows whose
crc32(doc_id) mod 5 is 0 are never read. Ids, languages and sources are no inputs of a score.

Defined results: null and empty texts score as texts without any passage; labels that are null or
other than 0 and 1 are not used, of repeated labels the largest counts; without any label of either
kind every text gets the smoothed share of toxic labels (0.25 without labels). Repeated rows score
alike, extra columns stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlane.llm.blocks import fold, sheltered, small, stored, text_blocks, values
from pactlane.llm.decontaminate import words_of

MAX_TRAIN = 50_000
LEXICON = 20_000
MIN_Z = 4.0
PRIOR = 0.1  # prior counts in relation to the counted ones
DRIFT = 0.25
SIGNIFICANT = 0.01
COUNTED = 200_000  # words a task counts before it passes the counts on


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, one past last, score) when the words of ``hits``
    (position, positive score) interrupt words of score ``-drift``."""
    found: list[list] = []  # first, end, sum before, sum after, index of the last one with a smaller sum before
    total, at = 0.0, 0
    for place, score in hits:
        low = total - drift * (place - at)
        total, at = low + score, place + 1
        first, high = place, total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
            j -= 1
        found.append([first, at, low, high, j])
    return [(a, b, r - x) for a, b, x, r, _ in found]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "clean", "toxic"]
        )
        for c in counts:
            c.clear()
        return out

    for batch, texts in text_blocks(batches):
        for text, toxic in zip(texts, values(batch, "toxic"), strict=True):
            counts[toxic].update(set(words_of(text)))
        if len(counts[0]) + len(counts[1]) > COUNTED:
            yield flush()
    yield flush()


def _rate(scores: np.ndarray, p: np.ndarray, drift: float) -> float:
    """The positive solution of sum p exp(rate s) + (1 - sum p) exp(-rate drift) = 1."""
    def excess(x: float) -> float:
        return float((p * np.exp(x * scores)).sum() + (1 - p.sum()) * math.exp(-x * drift) - 1)

    low, high = 0.0, 1e-3
    while excess(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, start: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps; weights of the columns, then the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log(start / (1 - start))
    ridge = np.diag([1e-2] * (len(w) - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def passages(words: list[bytes], model: dict) -> tuple[list[tuple[int, int, float, float]], list[float]]:
    """Significant (first word, one past last, score, E) segments, and the text's features."""
    lexicon = model["lexicon"]
    found = segments([(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon], model["drift"])
    rate, start = model["rate"], model["start"]
    log_e = [math.log(max(1, len(words)) * start) - rate * s for _, _, s in found]
    out = [(a, b, s, math.exp(max(-700.0, e))) for (a, b, s), e in zip(found, log_e, strict=True) if e < math.log(SIGNIFICANT)]
    best = -min(log_e) if log_e else -10.0
    return out, [min(60.0, max(-10.0, best)) / 10, math.log1p(len(out))]


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """Model (a small dict) from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = stored(known.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    n, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    model = {"lexicon": {}, "drift": DRIFT, "rate": 1.0, "start": 1.0, "weights": [0.0, 0.0, math.log(((n_toxic or 0) + 0.5) / (n - (n_toxic or 0) + 1.5))]}
    if not n or not n_toxic or n_toxic == n:
        return model
    picked = known.where(F.pmod(F.xxhash64("l_id"), F.lit(n)) < max_train)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(small(picked), F.col("doc_id") == F.col("l_id"))
    texts = stored(texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max(F.struct("toxic", "text")).alias("t")).select("t.*"), "toxicity-train")
    counts = stored(texts.mapInArrow(_counts, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words")
    n_clean, n_toxic = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    if not n_clean or not n_toxic:
        return model

    shares = counts.withColumn("all", F.col("clean") + F.col("toxic"))
    # prior counts of each class: in proportion to the class's size
    shares = shares.select("word", "clean", "toxic", (F.col("all") * (PRIOR * n_clean / (n_clean + n_toxic))).alias("prior_c"), (F.col("all") * (PRIOR * n_toxic / (n_clean + n_toxic))).alias("prior_t"))
    at, ac = F.col("toxic") + F.col("prior_t"), F.col("clean") + F.col("prior_c")
    delta = F.log(at / (F.lit(n_toxic * (1 + PRIOR)) - at)) - F.log(ac / (F.lit(n_clean * (1 + PRIOR)) - ac))
    scored = shares.select("word", delta.alias("score"), (delta / F.sqrt(1 / at + 1 / ac)).alias("z"), (ac / (n_clean * (1 + PRIOR))).alias("p"))
    top = scored.where((F.col("z") >= MIN_Z) & (F.col("score") > 0)).orderBy(F.desc("z"), "word").limit(LEXICON).toArrow()
    if not top.num_rows:
        return model
    scores, p = top.column("score").to_numpy(), top.column("p").to_numpy()
    model |= {"lexicon": dict(zip(top.column("word").to_pylist(), scores.tolist(), strict=True)), "rate": _rate(scores, p, DRIFT), "start": float(p.sum())}
    sent = spark.sparkContext.broadcast(model)
    rows = texts.mapInArrow(_features(sent), "toxic int, a double, b double").toArrow()
    x = np.stack([rows.column("a").to_numpy(), rows.column("b").to_numpy()], 1)
    y = rows.column("toxic").to_numpy().astype(float)
    model["weights"] = _logistic(x, y, (y.sum() + 0.5) / (len(y) + 2)).tolist()
    return model


def _features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            x = [passages(words_of(t), model.value)[1] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(values(batch, "toxic"), pa.int32()), pa.array([a for a, _ in x]), pa.array([b for _, b in x])], names=["toxic", "a", "b"])

    return run


FOUND = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.value["weights"])
        for batch, texts in text_blocks(batches):
            both = [passages(words_of(t), model.value) for t in texts]
            z = np.array([x for _, x in both]) @ w[:-1] + w[-1]
            found = [[dict(zip(("first", "end", "score", "expected"), s, strict=True)) for s in out] for out, _ in both]
            columns = [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))), pa.array(found, FOUND)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__score", "__passages"])

    return run


@sheltered("doc_id", "text")
def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``__score`` (chance of label 1) and ``__passages`` (significant toxic segments)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*columns, "__score double, __passages array<struct<first:int,end:int,score:double,expected:double>>"])
    return docs.mapInArrow(_score(sent), schema)
