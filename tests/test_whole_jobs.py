"""Queries that once left out part of their table."""

from __future__ import annotations

from oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_object_payloads_of_every_output(spark):
    import __spark_entry__ as entry
    from pactlane.plans.evaluation_queries import preds

    rows = entry.queries()["object_payloads"](spark, SMALL)
    made = preds(spark, SMALL)
    cut = made.where("ordinal % 7 = 3").count()
    assert cut > 0
    assert rows.count() == made.count()
    assert rows.join(made.where("ordinal % 7 = 3"), ["arm", "id"]).count() == cut


def test_object_payloads_against_sql(spark):
    import __spark_entry__ as entry

    ok, note = compare(spark, connect(SMALL), "object_payloads", SMALL, entry.queries(), entry.oracle_sql())
    assert ok, note
