"""Occurrences of many passages in many documents, exactly or up to case and separators.

Documents are not searched once per passage. Of every folded document the run with the least hash is
chosen in each window, so wherever a passage stands inside a document the same runs are chosen there
as in the passage itself. Each passage is looked up by one of its runs, the one that the documents
hold least often (a passage none of whose runs occurs is done with); the place of the run gives the
only possible start. What is found there is checked by 128-bit hashes of the whole passage, from
prefix sums over the document, so the work is linear in the texts and in the hits.

Defined results: null and empty texts, and passages without any letter, digit or symbol, occur
nowhere; equal passages and repeated documents are found under each of their keys; overlapping
occurrences all count. Keys must tell documents apart; passages may share keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlane.functions import constants as C
from pactlane.functions.fingerprints import code_points, mixed, run_hashes, window_minima
from pactlane.functions.folding import Folder, whole_span
from pactlane.operators.common import count_if, fits, rate, stored

# (characters of a run, runs of a window): a passage belongs to the first level whose window it fills
LEVELS = ((16, 16), (4, 4), (1, 1))
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def level_of(size: int) -> int:
    return next(k for k, (q, w) in enumerate(LEVELS) if size >= q + w - 1)


def chosen_runs(codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs chosen in a folded text."""
    q, w = LEVELS[level]
    hashes = run_hashes(codes, q, level + 1)
    at = np.unique(window_minima(hashes, w))
    return at, hashes[at]


class Prefixes:
    """Polynomial hashes of any run of a text from prefix sums, under two bases."""

    def __init__(self, codes: np.ndarray):
        self.sums, self.up = [], []
        n = len(codes)
        for base in BASES:
            down = np.full(n + 1, pow(int(base), -1, 1 << 64), np.uint64)
            up = np.full(n + 1, base, np.uint64)
            down[0] = up[0] = 1
            down, up = np.multiply.accumulate(down), np.multiply.accumulate(up)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * down[:n], out=sums[1:])
            self.sums.append(sums)
            self.up.append(up)

    def of(self, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Hash of each run under each base, as signed integers."""
        return [mixed((s[begin + size] - s[begin]) * u[begin]).view(np.int64) for s, u in zip(self.sums, self.up, strict=True)]


def _value(codes: np.ndarray) -> list[int]:
    return [int(h[0]) for h in Prefixes(codes).of(np.array([0]), np.array([len(codes)]))]


PASSAGE_SQL = "text string, level int, size int, lead int, raw_size int, f1 long, f2 long, r1 long, r2 long, runs array<struct<run:long,place:int>>"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct passage texts -> level, sizes, hashes (folded and as they stand) and chosen runs."""
    folder = Folder()
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            folded, origin = folder.fold(text)
            if folded:
                codes = code_points(folded)
                level = level_of(len(codes))
                at, runs = chosen_runs(codes, level)
                pairs = [{"run": r, "place": p} for r, p in zip(runs.view(np.int64).tolist(), at.tolist(), strict=True)]
                raw = code_points(text)
                rows.append((text, level, len(codes), int(origin[0]), len(raw), *_value(codes), *_value(raw), pairs))
        kinds = [pa.string(), *[pa.int32()] * 4, *[pa.int64()] * 4, pa.list_(pa.struct([("run", pa.int64()), ("place", pa.int32())]))]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PASSAGE_SQL.split(", ")])


def _document_runs(levels: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            for row in range(batch.num_rows):
                folded = folder.fold(batch.column(1)[row].as_py() or "")[0]
                codes = code_points(folded)
                for level in levels:
                    at, runs = chosen_runs(codes, level)
                    if len(at):
                        keys = batch.column(0).take(pa.array(np.full(len(at), row)))
                        columns = [keys, pa.array(np.full(len(at), level, np.int32)), pa.array(runs.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), len(codes), np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, names=["source_key", "level", "run", "place", "length"])

    return run


def _check(kind: pa.DataType):
    """Documents with their possible starts -> the occurrences among them."""
    names = ["source_key", "passage", "start", "end", "exact_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            rows: list[tuple] = []
            for key, text, hits in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hit = {c: np.array([h[c] for h in hits.as_py()], np.int64) for c in ("passage", "start", "size", "lead", "raw_size", "f1", "f2", "r1", "r2")}
                folded, origin = folder.fold(text)
                f1, f2 = Prefixes(code_points(folded)).of(hit["start"], hit["size"])
                same = np.flatnonzero((f1 == hit["f1"]) & (f2 == hit["f2"]))
                hit = {c: v[same] for c, v in hit.items()}
                begin = origin[hit["start"]] - hit["lead"]
                inside = (begin >= 0) & (begin + hit["raw_size"] <= len(text))
                r1, r2 = Prefixes(code_points(text)).of(np.where(inside, begin, 0), np.where(inside, hit["raw_size"], 0))
                exact = inside & (r1 == hit["r1"]) & (r2 == hit["r2"])
                for k in range(len(same)):
                    span = whole_span(origin, int(hit["start"][k]), int(hit["size"][k]))
                    if span or exact[k]:
                        rows.append((key.as_py(), int(hit["passage"][k]), *(span or (None, None)), int(begin[k]) if exact[k] else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), *[pa.int32()] * 3], strict=True)], names=names)

    return run


def occurrences(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """Every place of every passage (key, text) in every source (key, text): passage_key, source_key,
    start and end (of the folded match, half-open, in code points; null where only the passage as it
    stands is whole there) and exact_start (null where case or separators differ)."""
    kind = sources.schema["key"].dataType
    texts = passages.where("text IS NOT NULL").select("text").distinct()
    values = stored(texts.mapInArrow(_passages, PASSAGE_SQL).withColumn("passage", F.xxhash64("text", "f1", "r2")), "passages")
    wanted = stored(values.select("level", F.explode("runs.run").alias("run")).distinct(), "wanted-runs")
    levels = sorted(r.level for r in values.select("level").distinct().collect())
    if not levels:
        schema = f"passage_key {passages.schema['key'].dataType.simpleString()}, source_key {kind.simpleString()}, start int, end int, exact_start int"
        return passages.sparkSession.createDataFrame([], schema)
    runs = sources.mapInArrow(_document_runs(levels), f"source_key {kind.simpleString()}, level int, run long, place int, length int")
    found = stored(runs.join(fits(wanted, 16), ["level", "run"], "left_semi"), "found-runs")
    often = found.groupBy("level", "run").agg(F.count("*").alias("n"))
    # the run that documents hold least often, if they hold all of them
    own = values.select("passage", "level", "size", "lead", "raw_size", "f1", "f2", "r1", "r2", F.explode("runs").alias("r"))
    held = own.select("*", "r.run", F.col("r.place").alias("own_place")).drop("r").join(often, ["level", "run"], "left").na.fill(0, ["n"])
    anchor = held.groupBy("passage").agg(F.min(F.struct("n", "own_place", "level", "run", "size", "lead", "raw_size", "f1", "f2", "r1", "r2")).alias("a"))
    anchors = stored(anchor.where("a.n > 0").select("passage", "a.*").drop("n"), "anchors")
    start = F.col("place") - F.col("own_place")
    possible = found.join(fits(anchors, 80), ["level", "run"]).where((start >= 0) & (start + F.col("size") <= F.col("length")))
    hit = F.struct("passage", start.alias("start"), "size", "lead", "raw_size", "f1", "f2", "r1", "r2")
    grouped = possible.groupBy("source_key").agg(F.collect_list(hit).alias("hits"))
    beside = sources.select(F.col("key").alias("source_key"), "text").join(grouped, "source_key").select("source_key", "text", "hits")
    from pyspark.sql.pandas.types import to_arrow_type

    checked = beside.mapInArrow(_check(to_arrow_type(kind)), f"source_key {kind.simpleString()}, passage long, start int, end int, exact_start int")
    keys = passages.select(F.col("key").alias("passage_key"), "text").join(values.select("text", "passage"), "text").select("passage_key", "passage")
    return checked.join(keys, "passage").select("passage_key", "source_key", "start", "end", "exact_start")


def verified(found: DataFrame) -> DataFrame:
    """One row for each passage and source with an occurrence: status, match_kind, candidate_span_count
    and the span where it is unique. Exact places come first; folded ones count where there is none."""
    by = found.groupBy("passage_key", "source_key").agg(
        F.count("exact_start").alias("exact"), F.countDistinct("start", "end").alias("folded"), F.min("exact_start").alias("exact_start"), F.min("start").alias("start"), F.min("end").alias("end"),
    )
    by = by.where("exact > 0 OR folded > 0")
    count = F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("folded"))
    status = F.when(F.col("exact") == 1, F.lit(C.EXACT_UNIQUE)).when(count > 1, F.lit(C.AMBIGUOUS)).otherwise(F.lit(C.NORMALIZED_UNIQUE))
    kind = F.when(F.col("exact") == 1, F.lit("exact")).when(count > 1, F.lit("none")).otherwise(F.lit("normalized"))
    begin = F.when(F.col("exact") == 1, F.col("exact_start")).when(count == 1, F.col("start"))
    return by.select("passage_key", "source_key", status.alias("status"), kind.alias("match_kind"), count.alias("candidate_span_count"), begin.alias("start"))


def passage_statistics(passages: DataFrame, checked: DataFrame) -> DataFrame:
    """For each passage in how many sources it stands with which status, and the share verified."""
    names = {C.EXACT_UNIQUE: "exact_unique", C.NORMALIZED_UNIQUE: "normalized_unique", C.AMBIGUOUS: "ambiguous"}
    per = checked.groupBy("passage_key").agg(F.count("*").alias("sources"), *[count_if(F.col("status") == s).alias(n) for s, n in names.items()])
    out = passages.select(F.col("key").alias("passage_key")).join(per, "passage_key", "left").na.fill(0)
    good = F.col("exact_unique") + F.col("normalized_unique")
    return out.select("*", (F.col("sources") == 0).alias("not_found"), rate(good, F.col("sources"), None).alias("verified_rate"))
