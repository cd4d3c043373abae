"""Rows that hold equal texts are counted first, with the results of the plain rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import evaluate as E
from pactlane.operators import provenance as P
from pactlane.operators import review as R
from pactlane.plans import evaluation_queries as Q
from pactlane.plans import provenance_queries as S
from pactlane.plans import review_queries as V
from tests.test_collapse import SF, _rows

BY = ["arm", "split"]


def test_slot_items_are_scored_once_per_pair(spark, monkeypatch):
    rows = Q.layered(spark, SF)
    seen = []
    monkeypatch.setattr(E, "micro_scores", lambda df, by, real=E.micro_scores: seen.append(df) or real(df, by))
    assert _rows(Q.micro_f1(spark, SF)) == _rows(E.micro_scores(rows, BY))
    assert seen[0].count() == Q.paired(spark, SF).select(*BY, *E.PAIR).distinct().count() < rows.count()
    assert seen[0].agg(F.sum("copies")).first()[0] == rows.count()
    assert _rows(Q.layered_metrics(spark, SF)) == _rows(E.layered_metrics(rows, BY))


def test_a_row_may_stand_for_several(spark):
    rows = Q.layered(spark, SF)
    twice = rows.unionByName(rows.where("ordinal % 3 = 0"))
    marked = rows.withColumn("copies", F.when(F.col("ordinal") % 3 == 0, 2).otherwise(1))
    assert _rows(E.micro_scores(marked, BY)) == _rows(E.micro_scores(twice, BY))
    assert _rows(E.layered_metrics(marked, BY)) == _rows(E.layered_metrics(twice, BY))


def test_cases_are_designed_from_counted_pairs(spark, monkeypatch):
    plain = Q.records(spark, SF).join(Q.scored(spark, SF).select("arm", "id", "g", "p"), ["arm", "id"])
    value = lambda s: F.expr(V.VALUE.format(cm=f"{s}.normalized_command", rt=f"{s}.route", tt=f"{s}.task_type"))
    plain = plain.select("arm", "source_id", "drift_bucket", "field_path", value("g").alias("gold_value"), value("p").alias("wrong_value"))
    seen = []
    monkeypatch.setattr(R, "case_design", lambda df, real=R.case_design: seen.append(df) or real(df))
    assert _rows(V.case_design(spark, SF)) == _rows(R.case_design(plain))
    held = seen[0].groupBy("arm", "source_id", "drift_bucket", "field_path", "gold_value", "wrong_value").agg(F.sum("copies").alias("n"))
    assert _rows(held) == _rows(plain.groupBy(*plain.columns).agg(F.count("*").alias("n")))
    assert seen[0].count() < plain.count()


def test_mechanisms_are_found_once_per_content(spark, monkeypatch):
    plain = P.mechanisms(P.slot_pairs(Q.scored(spark, SF)))
    found = []
    monkeypatch.setattr(P, "mechanisms", lambda df, real=P.mechanisms: found.append(real(df)) or found[-1])
    once = S.mech(spark, SF)
    keys = [c for c in plain.columns if c not in ("id", "ordinal", "source_id")]
    counts = lambda df, n: _rows(df.groupBy(*keys).agg(n.cast("bigint").alias("n")))
    assert counts(once, F.sum("copies")) == counts(plain, F.count("*"))
    assert found[0].select("id").distinct().count() <= S.sources(spark, SF).count() < Q.paired(spark, SF).count()
    assert once.count() < plain.count()
    for query in (lambda m: P.movement_summary(P.slot_movements(m)), lambda m: P.top_mechanism_pairs(P.slot_movements(m)), lambda m: P.slot_profiles(m, P.slot_movements(m))):
        assert _rows(query(once)) == _rows(query(plain))


def test_an_arm_without_slots_is_right_about_paths_of_the_other_alone(spark):
    slot = '{"slot_path":"a","has_gold":false,"has_pred":true,"provenance":"unsupported_by_source","mechanism":"EXTRA_SLOT_KEY"}'
    texts = [(n, f'{{"task_type":"t","route":"r","slots":[{s}]}}') for n, s in ((1, ""), (2, slot))]
    profiles = spark.createDataFrame(texts, "number long, profile string")
    rows = [("control", "i", 1), ("treatment", "i", 2), ("control", "j", 1), ("treatment", "j", 2), ("control", "k", 1)]
    rows = spark.createDataFrame([(a, i, "dev", n) for a, i, n in rows], "arm string, id string, split string, profile long")
    got = P.counted_mechanisms(rows, profiles).select("arm", "slot_path", "has_pred", "gold_support", "provenance", "mechanism", "is_correct", "copies")
    assert sorted(map(tuple, got.collect())) == [
        ("control", "a", False, None, "unavailable", "SLOT_CORRECT_ABSENT", True, 2),
        ("treatment", "a", True, None, "unsupported_by_source", "EXTRA_SLOT_KEY", False, 2),
    ]
