"""Equal pairs and rows are judged once, and every one of them is counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import curate as K
from pactlane.plans import curate_queries as Q
from pactlane.plans import library_queries as L

SF = "/root/testdata/sf0.001"


def parsed_rows(monkeypatch):
    seen, plain = [], K.parse_contract

    def counted(df, raw, out):
        seen.append(df.count())
        return plain(df, raw, out)

    monkeypatch.setattr(K, "parse_contract", counted)
    return seen


def test_pair_verdicts_count_every_pair_and_parse_equal_ones_once(spark, monkeypatch):
    pairs = Q.pairs(spark, SF).where("ordinal < 400")
    pairs = pairs.withColumn("id", F.when(F.col("ordinal") == 3, F.lit(" ")).otherwise(F.col("id"))).withColumn("split", F.when(F.col("ordinal") == 5, F.lit("x")).otherwise(F.col("split")))
    pairs = pairs.withColumn("chosen", F.when(F.col("ordinal") == 7, F.lit(None)).otherwise(F.col("chosen"))).withColumn("rejected", F.when(F.col("ordinal") == 9, F.col("chosen")).otherwise(F.col("rejected")))
    pairs = pairs.withColumn("rejected_input_text", F.when(F.col("ordinal") == 11, F.lit("other")).otherwise(F.col("input_text")))
    pairs = pairs.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(3)))).cache()
    want = {(r.rejection_reason, r.violation, r["count"]) for r in K.check_pairs(pairs).groupBy("rejection_reason", "violation").count().collect()}
    assert len({v for _, v, _ in want}) >= 6
    seen = parsed_rows(monkeypatch)
    assert {(r.rejection_reason, r.violation, r.copies) for r in K.pair_verdicts(pairs).collect()} == want
    assert sum(n for *_, n in want) == pairs.count() and max(seen) <= pairs.count() / 3


def test_counted_failures_are_those_of_the_rows(spark, monkeypatch):
    again = lambda df: df.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(3))))
    rows, pairs = again(L.broken_rows(spark, SF)), again(Q.pairs(spark, SF)).where("ordinal < 400").withColumn("chosen", F.when(F.col("ordinal") % 9 == 1, F.lit("{}")).otherwise(F.col("chosen")))
    manifest = spark.createDataFrame([("m", -1, pairs.count())], "manifest_id string, sft_rows long, preference_pairs long")
    want = {(r.category, r.message, r["count"]) for r in K.artifact_failures(rows, pairs, manifest).groupBy("category", "message").count().collect()}
    seen = parsed_rows(monkeypatch)
    assert {(r.category, r.message, r.failures) for r in K.counted_failures(rows, pairs, manifest).collect()} == want
    assert max(seen) <= max(rows.count(), pairs.count()) / 3
