"""Equal predictions of equal sources share one verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import evaluate as E
from pactlane.operators import provenance as V
from pactlane.plans import inputs
from pactlane.streaming import sidecar as S

SF = "/root/testdata/sf0.001"
ARMS = ["control", "treatment"]


def test_outcomes_share_one_verdict_among_equal_predictions(spark, monkeypatch):
    parsed = []
    plain = S.parse_contract

    def seen(df, raw, out):
        parsed.append(df.count())
        return plain(df, raw, out)

    monkeypatch.setattr(S, "parse_contract", seen)
    batch = E.scored(inputs.gold_rows(spark, SF), inputs.predictions(spark, SF), ARMS).select("arm", "id", "ordinal", "split", "input_text", "raw")
    out = S.outcomes(batch.unionByName(batch.withColumn("id", F.concat("id", F.lit("-again")))), V.default_policy(spark))
    assert out.count() == 2 * batch.count()
    assert parsed == [batch.select("input_text", "raw").distinct().count()]
    got = {r.id: (r.hook_status, r.error_code, r.trusted_count, r.candidate_count) for r in out.where("arm = 'control'").collect()}
    assert all(got[k] == got[f"{k}-again"] for k in got if not k.endswith("-again"))


def test_outcomes_parse_nothing_again_when_they_are_read(spark):
    batch = E.scored(inputs.gold_rows(spark, SF), inputs.predictions(spark, SF), ARMS).select("arm", "id", "ordinal", "split", "input_text", "raw").cache()
    out = S.outcomes(batch, V.default_policy(spark)).select("arm", "id", "hook_status", "trusted_count", "input_hash")
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "from_json" not in plan and "sha2" not in plan
    assert out.count() == batch.count()
