"""Operators and pipeline stages on tables whose further columns have awkward names, on repeated rows and on empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pactlane.llm import bpe, decontaminate, language, ngram_join, substring, toxicity, urls

AWKWARD = ["runs", "__score", "__lang", "__ids", "__doc", "__id", "__hash", "__bad", "__host", "a.b", "part", "extra_3_", "token"]


@pytest.fixture(scope="module")
def awkward(docs):
    out = docs.select("doc_id", "text", "n_chars")
    for k, c in enumerate(AWKWARD):
        out = out.withColumn(c, F.lit(k))
    return out


def same_extras(out, renamed=()):
    assert set(AWKWARD) - set(renamed) <= set(out.columns)
    rows = [r.asDict() for r in out.collect()]
    for r in rows:
        for k, c in enumerate(AWKWARD):
            assert r[f"{c}_input" if c in renamed else c] == k
    return rows


def test_operators_keep_awkward_columns(spark, awkward, bpe_file):
    n = awkward.count()
    labels = awkward.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog and of in")], "item_id long, text string")
    model = toxicity.train(awkward.select("doc_id", "text"), labels)
    assert len(same_extras(toxicity.score(awkward, model), ["__score"])) == n
    langs = language.train(awkward.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.lit("x")).otherwise(F.lit("y")).alias("lang")))
    assert len(same_extras(language.predict(awkward, langs), ["__score", "__lang"])) == n
    assert len(same_extras(substring.deduplicate(awkward))) == n
    assert len(same_extras(decontaminate.matches(awkward, bench))) == n
    assert same_extras(decontaminate.decontaminate(awkward, bench))
    assert len(same_extras(bpe.encode(awkward, bpe_file), ["__ids"])) == n
    assert same_extras(ngram_join.keep_one(awkward))


def test_url_filter_keeps_awkward_columns_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "<a href='http://b.net/'>"), (1, "http://a.com/x", "<a href='http://b.net/'>"), (2, None, None)], "page_id long, url string, html string")
    plain = urls.judge(pages, [("allow", "com/")])
    for k, c in enumerate(AWKWARD):
        pages = pages.withColumn(c, F.lit(k))
    out = urls.judge(pages, [("allow", "com/")])
    assert len(same_extras(out, ["__host"])) == 3
    pick = lambda df: sorted(map(str, df.select("page_id", "__host", "__verdict").collect()))
    assert pick(out) == pick(plain)


@pytest.mark.parametrize("which", ["awkward", "repeated", "empty"])
def test_stages_of_the_pipeline(spark, awkward, which, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs = {"awkward": awkward, "repeated": awkward.unionByName(awkward), "empty": awkward.limit(0)}[which]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = str(tmp_path_factory.mktemp("stage") / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
    assert (docs.count() == 0) == (which == "empty")
