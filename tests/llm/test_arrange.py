"""Fill-in-the-middle assembly, whitening and shuffled shards against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlane.llm import fill_in_middle as fim
from pactlane.llm import sharding, whitening
from pactlane.llm.blocks import scratch
from pactlane.llm.queries import QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    units, h = UNIT.findall(text), sha(f"42:{'null' if doc_id is None else doc_id}")
    n = len(units)
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 80 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text)


@pytest.mark.parametrize("units", [1, 3, 512])
def test_fill_in_middle_matches_plain_version(docs, units):
    extra = docs.select("doc_id", "text").limit(0).sparkSession.createDataFrame(
        [(None, "no id here"), (None, "other text"), (7, "a<P b<P> c"), (8, "< P<S <M <"), (9, " lead and trail \n"), (10, "　wide space é")] + [(5, "again and again")] * 40,
        "doc_id long, text string",
    )
    rows = docs.select("doc_id", "text").unionByName(extra).repartition(4)
    got = sorted(map(tuple, fim.digests(rows, units).collect()), key=str)
    assert got == sorted((plain_fim(r.doc_id, r.text) for r in rows.collect()), key=str)


def test_fill_in_middle_texts_and_empty(docs, empty):
    assert fim.digests(empty).collect() == []
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = fim.transform(docs.withColumn("form", F.lit("x")).withColumn("a.b", F.lit(1)), 4).collect()
    assert len(out) == len(texts) and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert fim.restore(r.output, r.form) == texts[r.doc_id]


def test_query_fill_in_middle(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, QUERIES["op11_fill_in_middle"](spark, sf).collect()))
    assert got == sorted(plain_fim(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


# ---- whitening


def check_whitening(white, model, vectors, kept=32, tol=1e-9):
    """Rows by exact sums and a dense eigendecomposition."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors])
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    centred = np.array([[float(int(v) - Fraction(s, n)) for v, s in zip(row, sums, strict=True)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    size = len(model.eigenvalues)
    assert size == min(kept, int((e > 1e-12 * e[0]).sum()))
    np.testing.assert_allclose(model.eigenvalues, e[:size], rtol=tol, atol=tol * e[0])
    np.testing.assert_allclose(model.explained, e[:size] / e.sum(), rtol=1e-6)
    dev = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    rows = {r.record.vec_id: r for r in white.collect()}
    got = np.array([rows[k].whitened for k in range(n)])
    assert [rows[k].deviation for k in range(n)] == [d if d < 1 << 63 else None for d in dev]
    gap = np.abs(np.diff(e[: size + 1])) if size < len(e) else np.abs(np.diff(np.append(e, 0)))[:size]
    for k in range(size):
        if (k == 0 or gap[k - 1] > 1e-6 * e[0]) and (k >= len(gap) or gap[k] > 1e-6 * e[0]):
            want = centred @ v[:, k] / math.sqrt(e[k])
            np.testing.assert_allclose(got[:, k] * np.sign(got[:, k] @ want), want, atol=1e-6)
    np.testing.assert_allclose(np.cov(got.T, bias=True), np.eye(size), atol=1e-6)
    assert model.identity_error < 1e-6


@pytest.mark.parametrize("case", ["plain", "scaled", "flat", "few"])
def test_whitening_matches_dense_version(spark, case):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300 if case != "few" else 5, 8)).astype(np.float32)
    if case == "scaled":
        data *= 10.0 ** np.arange(8) / 10
    if case == "flat":
        data[:, 3], data[:, 5] = 0.5, data[:, 4]
    df = spark.createDataFrame([(k, [float(c) for c in v], "x", 1) for k, v in enumerate(data)], "vec_id long, embedding array<float>, deviation string, `a.b` int").repartition(3)
    model = whitening.fit(df, "embedding", kept=6)
    white = whitening.transform(df, "embedding", model)
    assert white.schema["record"].dataType.names == ["vec_id", "embedding", "deviation", "a.b"]
    check_whitening(white, model, data.astype(float), kept=6, tol=1e-8)


def test_whitening_defined_results(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.fit(spark.createDataFrame([], schema), "embedding") is None
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [5.0, 1e300]), (10, [])]
    df = spark.createDataFrame(rows, schema).repartition(3)
    model = whitening.fit(df, "embedding")
    out = whitening.transform(df, "embedding", model).collect()
    assert sorted((r.record.vec_id or 0 for r in out)) == [0, 1, 1, 9] and model.centre.n == 4
    assert any(r.deviation is None for r in out)  # the entry held at 2**52 exceeds a long
    same = spark.createDataFrame([(k, [2.0, 3.0]) for k in range(4)], schema)
    model = whitening.fit(same, "embedding")
    assert [(r.whitened, r.deviation) for r in whitening.transform(same, "embedding", model).collect()] == [([], 0)] * 4
    assert whitening.by_component(whitening.transform(same, "embedding", model), model).count() == 0


def test_query_whitening(spark):
    out = QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 500 * 32 and {r.n for r in rows} == {500} and max(r.identity_error for r in rows) < 1e-9
    data = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()]
    x = np.floor(64 * np.array(data)) + 1_000_000
    e = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    got = {r.component: r.explained for r in rows}
    np.testing.assert_allclose([got[k + 1] for k in range(32)], e[:32] / e.sum(), rtol=1e-8)


# ---- shards


def shards_of(spark, df, **options):
    folder = scratch(spark, "test-shards")
    sharding.write(df, folder, **options)
    return sharding.read(spark, folder, df.schema)


def test_shards_hold_everything_once_in_equal_counts(spark, docs):
    rows = docs.unionByName(docs.limit(20)).withColumn("slot", F.lit("mine")).withColumn("shard", F.lit(None).cast("int")).withColumn("a.b", F.lit(1))
    rows = rows.unionByName(spark.createDataFrame([(None, "same", "en", "s", 4, "x", "mine", None, 1)] * 70, rows.schema))
    out = shards_of(spark, rows, shards=7, bucket_bytes=20_000)
    got = out.collect()
    assert sorted(str(r.record) for r in got) == sorted(str(r) for r in rows.collect())
    by: dict[int, list[int]] = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert sum(r.shard == 0 for r in got if r.record.text == "same") < 40  # a hot row is spread


def test_shards_are_seeded_and_uniform(spark):
    folder = scratch(spark, "numbers")
    spark.range(4000).selectExpr("id AS doc_id", "'t' AS text").coalesce(2).write.parquet(folder)
    df = spark.read.parquet(folder)
    order = lambda **o: [r.record.doc_id for r in shards_of(spark, df, shards=4, bucket_bytes=17 * 500, **o).orderBy("shard", "slot").collect()]
    first = order()
    assert first == order() != order(seed=7) and sorted(first) == list(range(4000))
    # each quarter of the ids in each shard: 16 cells of 250 in the mean
    cells = np.histogram2d(np.repeat(range(4), 1000), np.array(first) // 1000, bins=4)[0]
    assert ((cells - 250) ** 2 / 250).sum() < 40
    assert abs(np.corrcoef(first[:-1], first[1:])[0, 1]) < 0.06


def test_shards_of_little(spark, empty):
    assert shards_of(spark, empty, shards=3).count() == 0
    few = spark.createDataFrame([(1, None), (1, ""), (None, "é")], "doc_id long, text string")
    out = sharding.assignments(shards_of(spark, few, shards=5)).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(0, 0), (1, 0), (2, 0)]
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted([(16, 0), (16, 0), (18, zlib.crc32("é".encode()))])
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def test_query_sharding_is_native(spark):
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op13_sharding"](spark, sf)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = out.collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {k: (len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts.items()}
    counts = np.bincount([r.shard for r in rows], minlength=40)
    assert len(rows) == len(texts) and counts.max() - counts.min() <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(k, s) for k in range(40) for s in range(counts[k])]
