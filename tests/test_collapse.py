"""Equal texts are parsed and equal pairs of texts are judged once, with the rows of the plain way."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import diagnose as D
from pactlane.operators import evaluate as E
from pactlane.plans import evaluation_queries as Q
from pactlane.plans import inputs

SF = "/root/testdata/sf0.001"


def _rows(df):
    flat = df.select(F.to_json(F.struct(*sorted(c for c in df.columns)), {"ignoreNullFields": "false"}).alias("j"))
    return sorted(r.j for r in flat.collect())


def _inputs(spark):
    gold = inputs.gold_rows(spark, SF)
    preds = inputs.predictions(spark, SF)
    again = preds.where("ordinal % 5 = 0").withColumn("ordinal", F.col("ordinal") + 1).withColumn("raw", F.lit(""))
    return gold, preds.unionByName(again)


def test_collapsed_rows_are_the_plain_rows(spark):
    gold, preds = _inputs(spark)
    plain, once = E.scored(gold, preds, Q.ARMS), E.scored_once(gold, preds, Q.ARMS)
    assert once.count() == 2 * gold.count()
    assert _rows(once) == _rows(plain)


def test_each_pair_of_texts_is_judged_once(spark):
    gold, preds = _inputs(spark)
    rows = E.paired(gold, preds, Q.ARMS)
    judged = E.contents(rows, E.parsed_texts(gold, preds, 4), 4)
    different = E.aligned(gold, preds, Q.ARMS).select("gold", "raw").distinct().count()
    assert judged.count() == different < rows.count()


def test_residuals_are_found_once_per_pair(spark):
    rows = Q.fully(spark, SF)
    assert Q.fully_contents(spark, SF).count() == Q.contents(spark, SF).count()
    assert "found" in rows.columns
    assert _rows(D.residuals(rows)) == _rows(D.residuals(rows.drop("found")))
