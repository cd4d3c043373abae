"""What follows from shared texts is found once for each, with the rows of the plain way."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.functions.contract import parse_contract
from pactlane.operators import curate as K
from pactlane.operators import evaluate as E
from pactlane.operators import pairing as PI
from pactlane.operators import provenance as P
from pactlane.plans import curate_queries as T
from pactlane.plans import evaluation_queries as Q
from pactlane.plans import provenance_queries as R
from tests.test_collapse import SF, _rows


def test_bundle_renders_gold_once_a_pair(spark, monkeypatch):
    plain = PI.assemble(Q.gold(spark, SF), Q.scored(spark, SF).select("arm", "id", "raw", "schema_valid"))
    hashed = []
    monkeypatch.setattr(PI, "stored", lambda df, name, real=PI.stored: hashed.append(real(df, name)) or hashed[-1])
    once = PI.assemble_once(Q.paired(spark, SF), Q.contents(spark, SF))
    assert _rows(once) == _rows(plain)
    assert hashed[0].count() == Q.contents(spark, SF).count() < plain.count()


def test_sources_are_diagnosed_and_audited_once(spark):
    rows = Q.scored(spark, SF)
    plain = P.diagnostics(P.slot_table(rows), P.default_policy())
    assert _rows(R.diags(spark, SF)) == _rows(plain)
    once = R.source_diags(spark, SF)
    assert once.groupBy("id", "slot_path").count().where("count > 1").isEmpty() and once.count() < plain.count()
    audits = P.audits(plain, P.slot_table(rows, "g"))
    assert _rows(R.audited(spark, SF)) == _rows(audits)
    show = lambda df: sorted((r["arm"], r["id"], r["slot_path"], r["primary_mechanism"]) for r in df.collect())
    mismatched = P.collision_audit(R.source_audits(spark, SF).where("trusted AND gold_correct = false"))
    ledger = P.mismatch_ledger(E.beside_sources(Q.paired(spark, SF), mismatched), R.condition())
    assert show(ledger) == show(P.mismatch_ledger(audits, R.condition())) != []


def test_a_leak_is_told_for_every_row_of_its_content(spark):
    leaky = P.sidecars(R.source_diags(spark, SF).withColumn("slot_path", F.lit("gold_slots")))
    plain = P.sidecars(R.diags(spark, SF).withColumn("slot_path", F.lit("gold_slots")))
    got, want = E.beside_sources(Q.paired(spark, SF), P.sidecar_privacy(leaky)), P.sidecar_privacy(plain)
    assert _rows(got) == _rows(want)


def test_targets_are_rendered_once(spark, monkeypatch):
    seeds = T.seeds(spark, SF)
    hashed = []
    monkeypatch.setattr(K, "stored", lambda df, name, real=K.stored: hashed.append(real(df, name)) or hashed[-1])
    more = seeds.unionByName(seeds.limit(1).withColumn("id", F.lit("none")).withColumn("target", F.lit(None).cast("string")))
    rows = K.expand_rows(more)
    assert rows.count() == 3 * more.count() and hashed[0].count() == more.select("target").distinct().count() < seeds.count()
    pairs = K.preference_pairs(rows)
    assert hashed[1].count() == rows.where("variant = 0").select("target").distinct().count()
    plain = parse_contract(rows.where("variant = 0"), "target", "c").select("id", F.explode(K.rejections(F.col("c"), F.lit(True))).alias("r"))
    plain = plain.select(F.concat_ws("-", "id", "r.category").alias("id"), F.col("r.rejected").alias("rejected"))
    assert _rows(pairs.select("id", "rejected")) == _rows(plain)
