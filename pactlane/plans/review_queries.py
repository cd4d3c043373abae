"""Queries of the reviews: reconciled counts, case design, disjointness, false trust, safety and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import compare as C
from pactlane.operators import diagnose as D
from pactlane.operators import evaluate as E
from pactlane.operators import projection as V
from pactlane.operators import provenance as P
from pactlane.operators import review as R
from pactlane.operators.common import fits
from pactlane.plans.compare_queries import CANONICAL_GOLD, PROJ, _tall, recs
from pactlane.plans.evaluation_queries import PAIR_BYTES, RECORDS, RESIDUALS, contents, fully, gold, layered, paired, preds, records, scored
from pactlane.plans.oracle_parts import LAYER, n, with_rows
from pactlane.plans.provenance_queries import AUDIT, audited, diags
from pactlane.plans.registry import ORACLE, query
from pactlane.plans.shared import written

# ---- counts that must add up ------------------------------------------------------------

GRAINS = ["arm", "split", "task_family", "field_path"]
# The reported counts carry faults: one sum too high, one finest row lost.
RAISED = "level = 2 AND arm = 'treatment' AND split = 'dev'"
LOST = "level = 4 AND arm = 'control' AND split = 'test' AND field_path = 'slots' AND task_family LIKE 'search|%'"


@query(
    "residual_reconciliation",
    with_rows(
        f"""SELECT p.level, p.arm, p.split, p.task_family, p.field_path, own, parts FROM (SELECT level, arm, split, task_family, field_path, own, CASE level
  WHEN 0 THEN (SELECT sum(own) FROM rp c WHERE c.level = 1) WHEN 1 THEN (SELECT sum(own) FROM rp c WHERE c.level = 2 AND c.arm = rp.arm) WHEN 2 THEN (SELECT sum(own) FROM rp c WHERE c.level = 3 AND c.arm = rp.arm AND c.split = rp.split)
  WHEN 3 THEN (SELECT sum(own) FROM rp c WHERE c.level = 4 AND c.arm = rp.arm AND c.split = rp.split AND c.task_family = rp.task_family) END::BIGINT AS parts FROM rp WHERE level < 4) p WHERE own IS DISTINCT FROM parts""",
        f"""{RECORDS.strip()},
gr AS (SELECT 4 - length(replace(bin(grouping(arm, split, task_family, field_path)), '0', '')) AS level, arm, split, task_family, field_path, count(*) AS own FROM recs GROUP BY ROLLUP (arm, split, task_family, field_path)),
rp AS (SELECT CAST(level AS INT) AS level, arm, split, task_family, field_path, CASE WHEN {RAISED} THEN own + 3 ELSE own END AS own FROM gr WHERE NOT coalesce({LOST}, false))""",
    ),
)
def residual_reconciliation(spark, sf_dir):
    """Grains whose reported residuals are not the sum of the finer ones."""
    counts = R.grain_counts(records(spark, sf_dir), GRAINS)
    reported = counts.where(f"NOT coalesce({LOST}, false)").withColumn("n", F.expr(f"CASE WHEN {RAISED} THEN n + 3 ELSE n END"))
    return R.reconcile(reported, GRAINS)


# ---- case design ---------------------------------------------------------------------------

VALUE = "CASE field_path WHEN 'normalized_command' THEN {cm} WHEN 'route' THEN {rt} WHEN 'task_type' THEN {tt} END"


def drift_values(spark, sf_dir):
    """Strict mismatches with both values, once per distinct pair of texts."""
    value = lambda s: F.expr(VALUE.format(cm=f"{s}.normalized_command", rt=f"{s}.route", tt=f"{s}.task_type"))
    found = lambda: D.strict_drifts(contents(spark, sf_dir).select(*E.PAIR, "g", "p", "schema_valid"))
    return written(spark, sf_dir, "drift_values", lambda: found().select(*E.PAIR, "drift_bucket", "field_path", value("g").alias("gold_value"), value("p").alias("wrong_value")))


@query(
    "case_design",
    with_rows(
        """, v AS (SELECT arm, source_id, drift_bucket, string_agg(x, ' | ' ORDER BY rk) FILTER (WHERE side = 'g') AS gold_values, string_agg(x, ' | ' ORDER BY rk) FILTER (WHERE side = 'p') AS wrong_values FROM (
 SELECT *, row_number() OVER (PARTITION BY arm, source_id, drift_bucket, side ORDER BY c DESC, x) AS rk FROM (
 SELECT arm, source_id, drift_bucket, 'g' AS side, gold_value AS x, count(*) AS c FROM rv WHERE gold_value IS NOT NULL GROUP BY ALL UNION ALL SELECT arm, source_id, drift_bucket, 'p', wrong_value, count(*) FROM rv WHERE wrong_value IS NOT NULL GROUP BY ALL)) WHERE rk <= 3 GROUP BY ALL),
k AS (SELECT arm, source_id, drift_bucket, CAST(sum(c) AS BIGINT) AS residuals, string_agg(field_path || ' x' || c, ', ' ORDER BY field_path || ' x' || c) AS drift_sketch FROM (SELECT arm, source_id, drift_bucket, field_path, count(*) AS c FROM rv GROUP BY ALL) GROUP BY ALL),
t AS (SELECT source_id, CAST((row_number() OVER (ORDER BY source_id) - 1) % 4 AS INT) AS theme FROM (SELECT DISTINCT source_id FROM rv))
SELECT k.*, theme, coalesce(gold_values, '') AS gold_values, coalesce(wrong_values, '') AS wrong_values FROM k JOIN t USING (source_id) LEFT JOIN v USING (arm, source_id, drift_bucket)""",
        f"""{RECORDS.strip()},
rv AS (SELECT r.*, {VALUE.format(cm="s.g_cm", rt="s.g_rt", tt="s.g_tt")} AS gold_value, {VALUE.format(cm="s.p_cm", rt="s.p_rt", tt="s.p_tt")} AS wrong_value FROM recs r JOIN scored s USING (arm, id))""",
    ).replace("\n, v", ", v"),
)
def case_design(spark, sf_dir):
    """Case-design groups with value lists, a drift sketch and a theme."""
    rows = E.counted(paired(spark, sf_dir), ["arm", "source_id"])
    return R.case_design(E.with_contents(rows, fits(drift_values(spark, sf_dir), PAIR_BYTES)))


# ---- disjointness ------------------------------------------------------------------------------

SIGNED = """sg AS (SELECT id, split, source_id AS family, input_text, g_tt || ':' || g_rt AS scope, json_extract_string(g_sl, '$."' || json_keys(g_sl)[1] || '"') AS value FROM scored WHERE arm = 'control'),
sb AS (SELECT *, CASE WHEN coalesce(value, '') = '' THEN input_text ELSE replace(input_text, value, '{slot}') END AS blank FROM sg),
st AS (SELECT split, e.k AS kind, e.v AS key FROM (SELECT split, unnest([{'k': 'sample_id', 'v': id}, {'k': 'family', 'v': family}, {'k': 'exact_input_text', 'v': sha256(input_text)},
 {'k': 'template_signature', 'v': sha256(scope || chr(10) || blank)}, {'k': 'slot_value_stripped_signature', 'v': sha256(blank)}]) AS e FROM sb))"""


@query(
    "disjointness_audit",
    with_rows(
        """SELECT kind, CAST(sum(c) AS BIGINT) AS rows, CAST(coalesce(sum(c) FILTER (WHERE hit), 0) AS BIGINT) AS overlapping_rows, count(*) FILTER (WHERE hit) AS shared_keys, coalesce(sum(c) FILTER (WHERE hit), 0) = 0 AS disjoint
FROM (SELECT kind, key, count(*) AS c, (kind, key) IN (SELECT (kind, key) FROM st WHERE split = 'train') AS hit FROM st WHERE split = 'test' GROUP BY ALL) GROUP BY kind""",
        SIGNED,
    ),
)
def disjointness_audit(spark, sf_dir):
    """Test rows whose id, family, text or template stands in the training rows."""
    rows = scored(spark, sf_dir).where("arm = 'control'")
    g = F.col("g")
    value = F.element_at(g["slot_str"], F.json_object_keys(g["slots_text"])[0])
    signed = R.signatures(rows.select("id", "split", F.col("source_id").alias("family"), "input_text", F.concat_ws(":", g["task_type"], g["route"]).alias("scope"), value.alias("value")))
    split = rows.select("id", "split")
    side = lambda s: signed.join(split.where(F.col("split") == s), "id", "left_semi")
    return R.disjointness(side("test"), side("train"))


NAMED = "CASE ordinal % 5 WHEN 0 THEN 'family-' || source_id || '-' || ordinal WHEN 1 THEN 'candidate-a-b-' || (ordinal % 3) || '-' || ordinal WHEN 2 THEN 'seed-' || ordinal WHEN 3 THEN 'plain' ELSE id END"


@query(
    "row_id_families",
    with_rows(
        f"""SELECT family, count(*) AS rows FROM (SELECT CASE WHEN starts_with(i, 'family-') THEN array_to_string(string_split(i, '-')[1:2], '-') WHEN starts_with(i, 'candidate-') THEN array_to_string(string_split(i, '-')[1:4], '-')
 WHEN starts_with(i, 'seed-') THEN 'seed' ELSE string_split(i, '-')[1] END AS family FROM (SELECT {NAMED} AS i FROM scored WHERE arm = 'control')) GROUP BY ALL"""
    ),
)
def row_id_families(spark, sf_dir):
    """families by the form of the row id."""
    ids = gold(spark, sf_dir).selectExpr(f"{NAMED} AS row_id")
    return ids.groupBy(R.row_family(F.col("row_id")).alias("family")).agg(F.count("*").alias("rows"))


CONDITION = (
    "CASE ordinal % 7 WHEN 1 THEN 'out_of_scope_action' WHEN 2 THEN 'normalization_collision' WHEN 3 THEN 'duplicate_exact' WHEN 4 THEN 'source_absent' "
    "WHEN 6 THEN 'partial_span_trap' ELSE 'exact_unique' END"
)


@query(
    "challenge_rows",
    with_rows(
        f"""SELECT 'challenge-' || id AS id, 'test' AS split, input_text, {CANONICAL_GOLD} AS target, id AS source_id, {CONDITION} AS condition_tags, sha256(input_text) AS input_hash, sha256({CANONICAL_GOLD}) AS target_contract_hash
FROM scored WHERE arm = 'control' AND split <> 'train'"""
    ),
)
def challenge_rows(spark, sf_dir):
    """Challenge rows mapped to evaluation rows with tags and hashes in the provenance."""
    rows = R.evaluation_rows(gold(spark, sf_dir).where("split <> 'train'").withColumn("condition", F.expr(CONDITION)), "v1")
    at = lambda k: F.element_at("provenance", k).alias(k)
    return rows.select("id", "split", "input_text", "target", at("source_id"), at("condition_tags"), at("input_hash"), at("target_contract_hash"))


# ---- false trust -----------------------------------------------------------------------------


def trust_counters(spark, sf_dir):
    return R.false_trust(audited(spark, sf_dir), F.expr(CONDITION))


COUNTERS = (
    AUDIT.replace("WHEN 3 THEN 'duplicate_exact'", "WHEN 1 THEN 'out_of_scope_action' WHEN 2 THEN 'normalization_collision' WHEN 3 THEN 'duplicate_exact'").replace("WHEN 5 THEN 'normalization_candidate' ", "")
    + f""",
ft AS (SELECT arm, d.n AS dimension, d.v AS value, count(*) AS observed, {n('trusted')} AS trusted, {n("trusted AND status = 'VERIFIED_NORMALIZED_UNIQUE'")} AS normalized_trusted, {n("trusted AND slot_path = 'action'")} AS action_trusted,
 {n("trusted AND condition = 'duplicate_exact'")} AS duplicate_source_false_trust, {n("trusted AND condition = 'source_absent'")} AS source_absent_false_trust, {n("trusted AND condition = 'normalization_collision'")} AS normalization_collision_false_trust,
 {n("trusted AND condition = 'partial_span_trap'")} AS partial_span_false_trust, {n("trusted AND condition = 'out_of_scope_action'")} AS out_of_scope_action_false_trust, {n('trusted AND NOT correct')} AS trusted_mismatch
 FROM (SELECT *, unnest([{{'n': 'overall', 'v': 'all'}}, {{'n': 'scope_key', 'v': scope_key}}, {{'n': 'condition', 'v': condition}}]) AS d FROM ax) GROUP BY ALL)"""
)


@query("false_trust_counters", with_rows("SELECT *, trusted_mismatch / nullif(trusted, 0)::DOUBLE AS trusted_mismatch_rate FROM ft", COUNTERS))
def false_trust_counters(spark, sf_dir):
    """The five false-trust counters overall, per scope and per condition."""
    return trust_counters(spark, sf_dir)


@query(
    "scope_review",
    with_rows(
        r"""SELECT scope_key, count(*) AS source_attested, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS gold_correct, CAST(count(*) FILTER (WHERE arm = 'control') AS BIGINT) AS control_events, CAST(count(*) FILTER (WHERE arm = 'treatment') AS BIGINT) AS treatment_events,
 CAST(count(*) FILTER (WHERE why = 'SOURCE_ABSENT_SUBSTITUTION') AS BIGINT) AS source_absent_substitutions, CAST(count(*) FILTER (WHERE why = 'NORMALIZATION_EQUIVALENCE_COLLISION') AS BIGINT) AS normalization_collisions,
 CAST(count(*) FILTER (WHERE why IN ('OVERLONG_SOURCE_SPAN', 'UNDERSPECIFIED_PARTIAL_SPAN')) AS BIGINT) AS partial_or_overlong, CAST(0 AS BIGINT) AS wrong_entities, count(*) FILTER (WHERE NOT correct) AS gold_mismatch,
 count(*) FILTER (WHERE correct) / count(*)::DOUBLE AS gold_correct_rate, CASE WHEN scope_key = 'form_fill:fill_form:field' AND count(*) FILTER (WHERE NOT correct) > 0 THEN 'PROPOSE_DISABLE' WHEN scope_key = 'extract:extract_page:target' THEN 'OBSERVE_ENABLED'
 WHEN count(*) FILTER (WHERE NOT correct) > 0 THEN 'OBSERVE_LIMITED' ELSE 'OBSERVE_ENABLED' END AS proposal FROM (SELECT *, CASE WHEN correct THEN NULL WHEN slot_path = 'action' THEN 'WRONG_SLOT_OR_SCOPE_SELECTION' WHEN condition = 'source_absent' THEN 'SOURCE_ABSENT_SUBSTITUTION'
 WHEN (lv <> '' AND (length(ls) - length(replace(ls, lv, ''))) / length(lv) > 1) OR condition = 'normalization_collision' THEN 'NORMALIZATION_EQUIVALENCE_COLLISION' WHEN condition = 'duplicate_exact' THEN 'DUPLICATE_CONTEXT_DISAMBIGUATION_FAILURE'
 WHEN gold_text IS NULL OR gt <> 'VARCHAR' THEN 'UNCLASSIFIED_SEMANTIC_MISMATCH' WHEN condition = 'partial_span_trap' AND starts_with(v, gold_text) THEN 'OVERLONG_SOURCE_SPAN'
 WHEN condition = 'partial_span_trap' OR starts_with(gold_text, v) THEN 'UNDERSPECIFIED_PARTIAL_SPAN' ELSE 'OTHER' END AS why FROM ax WHERE trusted) GROUP BY scope_key""",
        COUNTERS,
    ),
)
def scope_review(spark, sf_dir):
    """Per scope the mismatches of trusted values by mechanism and the proposal."""
    rows = audited(spark, sf_dir)
    return R.scope_review(rows, P.mismatch_ledger(rows, F.expr(CONDITION)))


# ---- faults that must be found ------------------------------------------------------------------

KEPT_TEXT, GOLD_FIELD, PRIVATE = "ordinal % 101 = 7", "ordinal % 103 = 9", "ordinal % 107 = 11"


@query(
    "sidecar_faults",
    with_rows(
        f"""SELECT arm, id, kind AS fault FROM (SELECT arm, id, unnest(list_filter([CASE WHEN {GOLD_FIELD} THEN 'has_gold_field' END, CASE WHEN {KEPT_TEXT} THEN 'keeps_span_text' END,
 CASE WHEN {PRIVATE} THEN 'has_private_value' END], lambda x: x IS NOT NULL)) AS kind FROM scored WHERE ok AND len(json_keys(p_sl)) > 0)"""
    ),
)
def sidecar_faults(spark, sf_dir):
    """Gold fields, kept text and private values that were put into sidecars, found again."""
    cars = P.sidecars(diags(spark, sf_dir)).join(scored(spark, sf_dir).select("arm", "id", "ordinal"), ["arm", "id"])
    note = F.when(F.expr(PRIVATE), F.lit("/root/keys/id"))
    extra = F.struct(
        F.when(F.expr(GOLD_FIELD), F.lit("x")).alias("gold_contract"), F.when(F.expr(KEPT_TEXT), F.lit("x")).alias("text"), note.alias("note"),
    )
    diagnostics = F.transform("slot_diagnostics", lambda d: d.withField("extra", extra))
    found = P.sidecar_privacy(cars.withColumn("slot_diagnostics", diagnostics))
    faults = ("has_gold_field", "keeps_input", "keeps_span_text", "has_private_value")
    return found.select("arm", "id", F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in faults]))).alias("fault"))


CHANGED = "ordinal % 997 = 13"


@query(
    "changed_diagnostics",
    with_rows(f"SELECT arm, id, slot_path, count(*) * 2 AS rows FROM (SELECT v.arm, v.id, v.slot_path FROM ver v JOIN scored s USING (arm, id) WHERE {CHANGED}) GROUP BY ALL", AUDIT),
)
def changed_diagnostics(spark, sf_dir):
    """Diagnostics made again with some values changed: what differs, from either side."""
    again = diags(spark, sf_dir).withColumn("value_hash", F.when(F.expr(CHANGED), F.lit("changed")).otherwise(F.col("value_hash")))
    return P.integrity(diags(spark, sf_dir), again).groupBy("arm", "id", "slot_path").agg(F.count("*").alias("rows"))


@query(
    "unreproduced_metrics",
    f"""WITH x AS ({_tall(ORACLE["strict_metrics"], E.METRIC_COLUMNS)})
SELECT arm, split, metric, value AS expected, CASE WHEN metric = 'slot_f1' THEN value - 0.25::DOUBLE END AS observed FROM x WHERE (metric = 'slot_f1' AND arm = 'control') OR (metric = 'route_accuracy' AND split = 'dev')""",
)
def unreproduced_metrics(spark, sf_dir):
    """Metrics that a second run reports otherwise or not at all."""
    keys = ["arm", "split"]
    first = E.tidy(E.strict_metrics(scored(spark, sf_dir), keys), keys, E.METRIC_COLUMNS)
    lower = (F.col("metric") == "slot_f1") & (F.col("arm") == "control")
    again = first.where("NOT (metric = 'route_accuracy' AND split = 'dev')").withColumn("value", F.when(lower, F.col("value") - 0.25).otherwise(F.col("value")))
    return C.reproduction(again, first).select("arm", "split", "metric", "expected", "observed")


# ---- safety ----------------------------------------------------------------------------------------

MISSES = """um AS (SELECT arm, split, id, ordinal, g_tt || '|' || g_rt || '|' || g_re AS gold_sketch, coalesce(CASE WHEN t_tt = 'VARCHAR' THEN p_tt END, 'unknown') || '|' || coalesce(CASE WHEN t_rt = 'VARCHAR' THEN p_rt END, 'unknown') || '|' ||
 coalesce(CASE WHEN t_re = 'VARCHAR' THEN p_re END, 'unknown') AS predicted_sketch FROM scored WHERE json_ok AND (g_al = 'false' OR g_cf = 'true') AND NOT coalesce(t_al = 'BOOLEAN' AND p_al = 'false', false) AND NOT coalesce(t_cf = 'BOOLEAN' AND p_cf = 'true', false))"""


@query("unsafe_misses", with_rows("SELECT * FROM um", MISSES))
def unsafe_misses(spark, sf_dir):
    """Rows that must stop or ask and were let through."""
    return R.unsafe_false_negatives(scored(spark, sf_dir))


@query(
    "safety_totals",
    with_rows(
        """SELECT arm, split, CAST(count(*) FILTER (WHERE family = 'unsafe_false_negative') AS BIGINT) AS unsafe_false_negative, CAST(count(*) FILTER (WHERE family = 'confirmation') AS BIGINT) AS confirmation,
 CAST(count(*) FILTER (WHERE family = 'refusal_or_clarify') AS BIGINT) AS refusal_or_clarify, CAST(count(*) FILTER (WHERE family = 'risk_level') AS BIGINT) AS risk_level
FROM (SELECT arm, split, 'unsafe_false_negative' AS family FROM um UNION ALL SELECT arm, split, family FROM res WHERE family IN ('confirmation', 'refusal_or_clarify', 'risk_level')) GROUP BY arm, split""",
        f"{MISSES}, {RESIDUALS.strip()}",
    ),
)
def safety_totals(spark, sf_dir):
    """Unsafe misses and residuals of the safety families per split."""
    return R.safety_totals(R.unsafe_false_negatives(scored(spark, sf_dir)), D.residuals(fully(spark, sf_dir)))


# ---- gates -----------------------------------------------------------------------------------------


@query(
    "projection_gate",
    with_rows(
        """, g AS (SELECT min(round(l2 - l0, 9)) AS least, max(round(l2 - l0, 9)) AS most, bool_and(round(e2 - e1, 9) >= 0) AS no_decline FROM (SELECT sum(l0) / count(*)::DOUBLE AS l0, sum(l1) / count(*)::DOUBLE AS l2,
 count(*) FILTER (WHERE ex1) / count(*)::DOUBLE AS e1, count(*) FILTER (WHERE ex2) / count(*)::DOUBLE AS e2 FROM pc GROUP BY arm, split)),
c AS (SELECT count(*) FILTER (WHERE category IN ('CORE_SLOT_FAILURE', 'MIXED_CORE_FAILURE')) AS slots, count(*) FILTER (WHERE category = 'NORMALIZED_COMMAND_ONLY') AS derived, count(*) AS total FROM pc WHERE l0 = 0),
r AS (SELECT count(*) FILTER (WHERE reason = 'supported') / count(*)::DOUBLE AS supported_rate FROM pc),
t AS (SELECT min(x) AS roundtrip FROM (SELECT count(*) FILTER (WHERE ok) / count(*)::DOUBLE AS x FROM pc WHERE (arm, id) IN (SELECT (arm, id) FROM predictions) GROUP BY arm)),
a AS (SELECT *, slots >= greatest(1, derived) AS slot_bottleneck, supported_rate >= 0.95 AND roundtrip = 1 AS renderer_passed, derived / total::DOUBLE AS derived_share FROM g, c, r, t)
SELECT CASE WHEN least >= 0.08 AND derived_share >= 0.2 AND no_decline AND renderer_passed AND NOT slot_bottleneck THEN 'PROCEED_TO_CONTRACT_V2_IMPLEMENTATION' WHEN most < 0.03 AND NOT no_decline AND slot_bottleneck THEN 'SLOT_BOTTLENECK_PERSISTS'
 ELSE 'PARTIAL_SCHEMA_BENEFIT' END AS decision_label, slot_bottleneck, renderer_passed, no_decline AS executable_non_decline, derived_share FROM a""",
        PROJ,
    ).replace("\n, g", ", g"),
)
def projection_gate(spark, sf_dir):
    """Whether the core contract is worth implementing."""
    from pactlane.functions.contract import contract_valid, parse_contract

    rows = recs(spark, sf_dir)
    df = contract_valid(parse_contract(preds(spark, sf_dir), "raw", "c"), "c").withColumn("source_kind", F.col("arm"))
    return R.projection_gate(V.metrics(rows, ["arm", "split"]), V.failure_contribution(rows), V.renderer_coverage(rows), V.compatibility(V.round_trip(df)))


@query(
    "trust_gate",
    with_rows(
        f"""SELECT CASE WHEN b = '' THEN 'CHALLENGE_V1_VERIFIER_VALIDATED_OBSERVE_ONLY' ELSE 'CHALLENGE_V1_HOOK_UNSAFE_OR_INVALID' END AS decision_label, b AS blocking_reasons, changed_outputs, unmatched_sidecars FROM (
 SELECT concat_ws(',', {", ".join(f"CASE WHEN sum({c}) > 0 THEN '{c}' END" for c in ("normalized_trusted", "action_trusted", *R.FALSE_TRUST))}, CASE WHEN any_value(changed) > 0 THEN 'changed_outputs' END, CASE WHEN any_value(lost) > 0 THEN 'unmatched_sidecars' END) AS b,
 any_value(changed) AS changed_outputs, any_value(lost) AS unmatched_sidecars FROM ft, (SELECT count(*) FILTER (WHERE {CHANGED}) AS changed, count(*) FILTER (WHERE ordinal % 1009 = 3) AS lost FROM scored WHERE ok) WHERE dimension = 'overall')""",
        COUNTERS,
    ),
)
def trust_gate(spark, sf_dir):
    """Whether the observing hook may go on, with outputs that changed and sidecars that match nothing."""
    rows = scored(spark, sf_dir).where("schema_valid").select("arm", "id", "ordinal", F.sha2("input_text", 256).alias("input_hash"), F.sha2("raw", 256).alias("prediction_hash"))
    with_hook = rows.withColumn("prediction_hash", F.when(F.expr(CHANGED), F.lit("changed")).otherwise(F.col("prediction_hash")))
    changed = with_hook.select("arm", "id", "prediction_hash").exceptAll(rows.select("arm", "id", "prediction_hash"))
    made = rows.select("ordinal", F.concat_ws(":", "arm", "id").alias("id"), F.concat_ws(":", "arm", "id", "input_hash").alias("input_hash"), "prediction_hash")
    cars = made.withColumn("input_hash", F.when(F.expr("ordinal % 1009 = 3"), F.lit("none")).otherwise(F.col("input_hash")))
    unmatched = P.match_sidecars(cars.select("id", "input_hash", "prediction_hash"), made).where("matched_id IS NULL")
    return R.trust_gate(trust_counters(spark, sf_dir), changed, unmatched)


@query(
    "remediation_ranking",
    with_rows(
        """, e AS (SELECT r.arm, r.split, r.target, s.g_tt AS task FROM (SELECT arm, id, split, CASE family WHEN 'slot_key' THEN 'slot_key_mismatch' WHEN 'slot_value' THEN 'slot_value_mismatch' WHEN 'missing_slot' THEN 'missing_slot' WHEN 'extra_slot' THEN 'extra_slot'
  WHEN 'normalized_command' THEN 'normalized_command_mismatch' WHEN 'route' THEN 'route_or_task_type_mismatch' WHEN 'task_type' THEN 'route_or_task_type_mismatch' WHEN 'confirmation' THEN 'confirmation_or_risk_mismatch' WHEN 'risk_level' THEN 'confirmation_or_risk_mismatch'
  WHEN 'invalid_output' THEN 'invalid_output' WHEN 'missing_field' THEN 'invalid_output' END AS target FROM res WHERE split IN ('dev', 'test')) r JOIN scored s USING (arm, id) WHERE target IS NOT NULL
 UNION ALL SELECT arm, split, 'unsafe_false_negative', g_tt FROM lay2 WHERE ok AND g_unsafe AND NOT p_stop AND split IN ('dev', 'test')),
k AS (SELECT arm, target, task, count(*) AS c, count(*) FILTER (WHERE split = 'dev') AS dev, count(*) FILTER (WHERE split = 'test') AS test FROM e GROUP BY ALL),
a AS (SELECT arm, target, CAST(sum(c) AS BIGINT) AS residuals, CAST(sum(dev) AS BIGINT) AS dev_count, CAST(sum(test) AS BIGINT) AS test_count, list(task ORDER BY c DESC, task)[1] AS top_task_type FROM k GROUP BY ALL)
SELECT *, residuals / (sum(residuals) OVER (PARTITION BY arm))::DOUBLE AS proportion, CAST(row_number() OVER (PARTITION BY arm ORDER BY target <> 'unsafe_false_negative', residuals DESC, target) AS INT) AS priority FROM a""",
        f"{RESIDUALS.strip()}, {LAYER.strip()}" if "lay2" not in RESIDUALS else RESIDUALS.strip(),
    ).replace("\n, e", ", e"),
)
def remediation_ranking(spark, sf_dir):
    """Residual families ranked for remediation, unsafe misses first."""
    return D.remediation_ranking(layered(spark, sf_dir), fully(spark, sf_dir))

