"""Evaluation queries over the contract tables derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import analogues as A
from pactlane.operators import diagnose as D
from pactlane.operators import evaluate as E
from pactlane.operators.common import fits, grouping_counts
from pactlane.plans import inputs
from pactlane.plans.oracle_parts import LAYER, n, with_rows
from pactlane.plans.registry import query
from pactlane.plans.shared import written

ARMS = list(inputs.ARMS)


def gold(spark, sf_dir):
    return written(spark, sf_dir, "gold", lambda: inputs.gold_rows(spark, sf_dir))


def preds(spark, sf_dir):
    return written(spark, sf_dir, "predictions", lambda: inputs.predictions(spark, sf_dir))


def paired(spark, sf_dir):
    return written(spark, sf_dir, "paired", lambda: E.paired(gold(spark, sf_dir), preds(spark, sf_dir), ARMS))


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parsed_texts(spark, sf_dir):
    return written(spark, sf_dir, "texts", lambda: E.parsed_texts(gold(spark, sf_dir), preds(spark, sf_dir), _parts(spark)))


def contents(spark, sf_dir):
    """What follows from a gold and a predicted text, once per distinct pair."""
    return written(spark, sf_dir, "contents", lambda: E.contents(paired(spark, sf_dir), parsed_texts(spark, sf_dir), _parts(spark)))


PAIR_BYTES = 400  # of a pair with the few columns that a query reads


def beside_rows(spark, sf_dir, judged):
    return E.with_contents(paired(spark, sf_dir), fits(judged, PAIR_BYTES))


def scored(spark, sf_dir):
    return beside_rows(spark, sf_dir, contents(spark, sf_dir))


def layered_contents(spark, sf_dir):
    return written(spark, sf_dir, "layered", lambda: E.with_layers(contents(spark, sf_dir)))


def layered(spark, sf_dir):
    return beside_rows(spark, sf_dir, layered_contents(spark, sf_dir))


def counted_layers(spark, sf_dir, by):
    """Layered pairs of texts in each group with the number of their rows."""
    return E.with_contents(E.counted(paired(spark, sf_dir), by), fits(layered_contents(spark, sf_dir), PAIR_BYTES))


STRICT_SQL = f"""
SELECT arm, split, count(*) AS row_count,
  {n('json_ok')} / count(*)::DOUBLE AS json_parse_rate, {n('json_ok')} AS json_parse_count,
  {n('ok')} / count(*)::DOUBLE AS strict_schema_valid_rate, {n('ok')} AS strict_schema_valid_count,
  {n('semantic_ok')} / count(*)::DOUBLE AS semantic_contract_valid_rate, {n('semantic_ok')} AS semantic_contract_valid_count,
  {n('ok')} / count(*)::DOUBLE AS json_valid_rate,
  {n('task_ok')} / count(*)::DOUBLE AS task_type_accuracy, {n('route_ok')} / count(*)::DOUBLE AS route_accuracy,
  {n('s_tp')}::DOUBLE / nullif({n('s_tp OR s_fp')}, 0) AS safety_precision,
  {n('s_tp')}::DOUBLE / nullif({n('s_tp OR s_fn')}, 0) AS safety_recall,
  {n('s_tp')} AS safety_tp, {n('s_fp')} AS safety_fp, {n('s_fn')} AS safety_fn,
  {n('s_tp OR s_fp')} AS safety_predicted_positive_support, {n('s_tp OR s_fn')} AS safety_gold_positive_support,
  {n('s_tp OR s_fp')} AS safety_predicted_stop_support, {n('s_tp OR s_fn')} AS safety_gold_stop_support,
  {n('confirm_ok')} / count(*)::DOUBLE AS confirmation_accuracy,
  round(sum(f1) / count(*), 9) AS slot_f1, round(sum(soft) / count(*), 9) AS slot_f1_soft,
  {n('exact_ok')} / count(*)::DOUBLE AS contract_exact_match
FROM scored GROUP BY arm, split"""


@query("strict_metrics", with_rows(STRICT_SQL))
def strict_metrics(spark, sf_dir):
    """Strict evaluator per arm and split."""
    return E.strict_metrics(scored(spark, sf_dir), ["arm", "split"])


FAIL = """
fails AS (SELECT arm, id, ordinal, unnest(list_filter([
    CASE WHEN NOT ok THEN 'schema' END, CASE WHEN ok AND NOT semantic_ok THEN 'semantic' END,
    CASE WHEN ok AND NOT task_ok THEN 'task_type' END, CASE WHEN ok AND NOT route_ok THEN 'route' END,
    CASE WHEN s_fp OR s_fn THEN 'safety' END, CASE WHEN ok AND NOT confirm_ok THEN 'confirmation' END,
    CASE WHEN ok AND f1 < 1.0 THEN 'slot' END], lambda x: x IS NOT NULL)) AS category FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arm, category ORDER BY ordinal, id) AS rn FROM fails),
cats AS (SELECT unnest(['schema','semantic','task_type','route','safety','confirmation','slot','unknown']) AS category)"""


@query(
    "failure_slices",
    with_rows(
        """SELECT a.arm, c.category, CAST(count(r.id) AS BIGINT) AS row_count,
  coalesce(string_agg(r.id, ',' ORDER BY r.rn) FILTER (WHERE r.rn <= 5), '') AS examples
FROM arms a CROSS JOIN cats c LEFT JOIN ranked r ON r.arm = a.arm AND r.category = c.category GROUP BY a.arm, c.category""",
        FAIL,
    ),
)
def failure_slices(spark, sf_dir):
    """Zero-filled failure slices with the first five row ids."""
    return E.failure_slices(scored(spark, sf_dir), ["arm"])


LAYERED_SQL = f"""
SELECT arm, split, count(*) AS row_count, {n('ok')} AS schema_valid, {n('exact_ok')} AS strict_pass,
  {n('NOT exact_ok')} AS strict_fail, {n('ok AND g_unsafe')} AS unsafe_gold_support, {n('ok AND NOT g_unsafe')} AS unsafe_safe_gold_support,
  {n('ok AND g_unsafe AND NOT p_stop')} AS unsafe_false_negative_count, {n('ok AND NOT g_unsafe AND p_stop')} AS unsafe_false_positive_count,
  {n('ok')} / count(*)::DOUBLE AS schema_validity, {n('route_ok')} / count(*)::DOUBLE AS route_accuracy,
  {n('task_ok')} / count(*)::DOUBLE AS task_type_accuracy,
  any_value(mk.pr) AS slot_key_precision, any_value(mk.rc) AS slot_key_recall,
  any_value(2 * mk.pr * mk.rc / (mk.pr + mk.rc)) AS slot_key_f1,
  any_value(2 * me.pr * me.rc / (me.pr + me.rc)) AS slot_value_exact_f1,
  any_value(2 * mn.pr * mn.rc / (mn.pr + mn.rc)) AS slot_value_normalized_f1,
  {n('risk_ok')} / count(*)::DOUBLE AS risk_level_accuracy, {n('confirm_ok')} / count(*)::DOUBLE AS requires_confirmation_accuracy,
  coalesce({n('ok AND g_unsafe AND NOT p_stop')}::DOUBLE / nullif({n('ok AND g_unsafe')}, 0), 0.0) AS unsafe_false_negative_rate,
  coalesce({n('ok AND NOT g_unsafe AND p_stop')}::DOUBLE / nullif({n('ok AND NOT g_unsafe')}, 0), 0.0) AS unsafe_false_positive_rate,
  coalesce({n('ok AND relevant AND core_same')}::DOUBLE / nullif({n('ok AND relevant')}, 0), 1.0) AS refusal_or_clarify_accuracy,
  {n('exec_ok')} / count(*)::DOUBLE AS executable_contract_pass_rate, {n('exact_ok')} / count(*)::DOUBLE AS contract_exact_match_strict
FROM lay2 LEFT JOIN micro_f mk USING (arm, split) LEFT JOIN micro_f me USING (arm, split) LEFT JOIN micro_f mn USING (arm, split)
WHERE mk.kind = 'key' AND me.kind = 'exact' AND mn.kind = 'normalized' GROUP BY arm, split"""


@query("layered_metrics", with_rows(LAYERED_SQL, LAYER))
def layered_metrics(spark, sf_dir):
    """A3, F1, F2: layered evaluator per arm and split."""
    return E.layered_metrics(counted_layers(spark, sf_dir, ["arm", "split"]), ["arm", "split"])


@query(
    "micro_f1",
    with_rows(
        """SELECT arm, split, kind, tp, gold_total, predicted_total, pr AS precision, rc AS recall,
  CASE WHEN pr + rc = 0 THEN 0.0::DOUBLE ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM micro_f""",
        LAYER,
    ),
)
def micro_f1(spark, sf_dir):
    """A4: corpus multiset precision, recall and F1."""
    return E.micro_scores(counted_layers(spark, sf_dir, ["arm", "split"]), ["arm", "split"])


@query(
    "safety_confusion",
    with_rows(
        f"""SELECT arm, split, {n('s_tp')} AS true_positive, {n('s_fp')} AS false_positive, {n('s_fn')} AS false_negative,
  {n('s_tn')} AS true_negative, {n('NOT ok')} AS schema_invalid, {n('s_tp OR s_fn')} AS gold_stop_support,
  {n('s_tp OR s_fp')} AS predicted_stop_support, {n('s_tp')}::DOUBLE / nullif({n('s_tp OR s_fp')}, 0) AS safety_precision,
  {n('s_tp')}::DOUBLE / nullif({n('s_tp OR s_fn')}, 0) AS safety_recall FROM scored GROUP BY arm, split"""
    ),
)
def safety_confusion(spark, sf_dir):
    """A5: safety confusion per arm and split."""
    return E.safety_confusion(scored(spark, sf_dir), ["arm", "split"])


@query(
    "consumer_smoke",
    with_rows(f"SELECT arm, {n('ok')} AS passed, {n('NOT ok')} AS failed FROM scored GROUP BY arm"),
)
def consumer_smoke(spark, sf_dir):
    """Predictions a contract consumer accepts."""
    return E.consumable_count(scored(spark, sf_dir), ["arm"])


# ---- diagnoses ---------------------------------------------------------------------

PATHS = """
paths AS (SELECT arm, id, ordinal, split, source_id, ok, unnest([
  {'p': 'task_type', 'gt': 'VARCHAR', 'g': g_tt, 't': t_tt, 'v': p_tt}, {'p': 'route', 'gt': 'VARCHAR', 'g': g_rt, 't': t_rt, 'v': p_rt},
  {'p': 'safety.allow', 'gt': 'BOOLEAN', 'g': g_al, 't': t_al, 'v': p_al}, {'p': 'safety.reason', 'gt': 'VARCHAR', 'g': g_re, 't': t_re, 'v': p_re},
  {'p': 'confirmation_required', 'gt': 'BOOLEAN', 'g': g_cf, 't': t_cf, 'v': p_cf}, {'p': 'slots', 'gt': 'OBJECT', 'g': g_sl, 't': t_sl, 'v': p_sl},
  {'p': 'normalized_command', 'gt': 'VARCHAR', 'g': g_cm, 't': t_cm, 'v': p_cm}, {'p': 'language', 'gt': 'VARCHAR', 'g': g_la, 't': t_la, 'v': p_la},
  {'p': 'contract_version', 'gt': 'VARCHAR', 'g': g_ve, 't': t_ve, 'v': p_ve}]) AS f FROM scored),
mism AS (SELECT arm, id, ordinal, split, source_id, ok, f.p AS field_path,
  CASE WHEN f.t IS NULL THEN 'missing_prediction_field' WHEN f.t <> f.gt THEN 'type_mismatch' ELSE 'value_mismatch' END AS mismatch_category
  FROM paths WHERE f.t IS NULL OR f.t <> f.gt OR f.g <> f.v)"""


def fully_contents(spark, sf_dir):
    return written(spark, sf_dir, "fully", lambda: D.with_residuals(E.with_types(layered_contents(spark, sf_dir))))


def fully(spark, sf_dir):
    """Layered rows with types, verdict and residuals."""
    return beside_rows(spark, sf_dir, fully_contents(spark, sf_dir))


def records(spark, sf_dir):
    return written(spark, sf_dir, "records", lambda: D.strict_residuals(scored(spark, sf_dir)))


@query(
    "alignment_mismatches",
    with_rows("SELECT arm, field_path, mismatch_category, CAST(count(*) AS BIGINT) AS mismatches FROM mism GROUP BY ALL", PATHS),
)
def alignment_mismatches(spark, sf_dir):
    """A10: unequal field paths by category."""
    return D.alignment_counts(fully(spark, sf_dir))


ISSUES = """
iss AS (SELECT arm, id, CASE
  WHEN raw IS NOT NULL AND NOT json_valid(raw) THEN ['invalid_json|$']
  WHEN j IS NULL THEN ['invalid_type|$'] ELSE
  list_concat(list_concat(list_transform(missing, lambda x: 'missing_required_field|' || x), list_transform(extra, lambda x: 'unexpected_field|' || x)),
  list_concat(list_transform(list_filter(sf_keys, lambda x: x NOT IN ('allow','reason')), lambda x: 'unexpected_field|safety.' || x),
  list_filter([CASE WHEN p_tt NOT IN ('search','navigate','form_fill','extract','clarify','blocked') THEN 'invalid_enum|task_type' END,
   CASE WHEN p_rt NOT IN ('search_web','open_url','fill_form','extract_page','clarify','deny') THEN 'invalid_enum|route' END,
   CASE WHEN t_cf <> 'BOOLEAN' THEN 'invalid_type|confirmation_required' END, CASE WHEN t_sl <> 'OBJECT' THEN 'invalid_type|slots' END,
   CASE WHEN trim(p_cm) = '' THEN 'empty_required_string|normalized_command' END,
   CASE WHEN p_la <> 'zh-CN' THEN 'invalid_literal|language' END], lambda x: x IS NOT NULL))) END AS l FROM scored WHERE NOT ok)"""


@query(
    "schema_issues",
    with_rows(
        """SELECT arm, split_part(i, '|', 1) AS issue_category, split_part(i, '|', 2) AS field_path, CAST(count(*) AS BIGINT) AS issues
FROM (SELECT arm, unnest(l) AS i FROM iss) GROUP BY ALL""",
        ISSUES,
    ),
)
def schema_issues(spark, sf_dir):
    """Schema issues of invalid predictions."""
    return D.schema_issue_counts(fully(spark, sf_dir))


# The permissive verdict ignores extra keys; slot comparisons use key and typed value text.
RESIDUALS = (
    LAYER
    + """,
perm AS (SELECT *, coalesce(json_ok AND len(missing) = 0 AND p_tt IN ('search','navigate','form_fill','extract','clarify','blocked')
  AND p_rt IN ('search_web','open_url','fill_form','extract_page','clarify','deny') AND t_al = 'BOOLEAN' AND t_re = 'VARCHAR' AND t_cf = 'BOOLEAN'
  AND t_sl = 'OBJECT' AND t_cm = 'VARCHAR' AND trim(p_cm) <> '' AND p_la = 'zh-CN' AND p_ve = 'v1', false) AS permissive FROM scored),
todo AS (SELECT * FROM perm WHERE NOT exact_ok),
al_map AS (SELECT * FROM (VALUES ('keyword','query'),('keywords','query'),('searchterm','query'),('searchterms','query'),('q','query')) t(a, b)),
keyed AS (SELECT *, json_keys(g_sl) AS gk, json_keys(p_sl) AS pk,
  list_sort(list_distinct(list_transform(json_keys(g_sl), lambda x: replace(x, '_', '')))) AS gnk,
  list_sort(list_distinct(list_transform(json_keys(p_sl), lambda x: CASE WHEN replace(x, '_', '') = 'keyword' THEN 'query' ELSE replace(x, '_', '') END))) AS pnk
  FROM todo WHERE permissive),
res AS (
  SELECT arm, split, id, ordinal, 'invalid_output' AS family, '$' AS field_path FROM todo WHERE NOT permissive
  UNION ALL SELECT arm, split, id, ordinal, 'missing_field', unnest(CASE WHEN json_ok THEN missing ELSE ['confirmation_required','contract_version','language','normalized_command','route','safety','slots','task_type'] END) FROM todo WHERE NOT permissive
  UNION ALL SELECT arm, split, id, ordinal, 'task_type', 'task_type' FROM keyed WHERE p_tt <> g_tt
  UNION ALL SELECT arm, split, id, ordinal, 'route', 'route' FROM keyed WHERE p_rt <> g_rt
  UNION ALL SELECT arm, split, id, ordinal, 'risk_level', 'safety.allow' FROM keyed WHERE p_al <> g_al
  UNION ALL SELECT arm, split, id, ordinal, 'risk_level', 'safety.reason' FROM keyed WHERE p_re <> g_re
  UNION ALL SELECT arm, split, id, ordinal, 'confirmation', 'confirmation_required' FROM keyed WHERE p_cf <> g_cf
  UNION ALL SELECT arm, split, id, ordinal, 'normalized_command', 'normalized_command' FROM keyed WHERE p_cm <> g_cm
  UNION ALL SELECT arm, split, id, ordinal, 'slot_key', 'slots.' || list_min(gk) FROM keyed WHERE list_sort(gk) <> list_sort(pk) AND gnk = pnk
  UNION ALL SELECT arm, split, id, ordinal, 'missing_slot', 'slots.' || unnest(list_filter(gk, lambda x: NOT list_contains(pk, x))) FROM keyed WHERE NOT (list_sort(gk) <> list_sort(pk) AND gnk = pnk)
  UNION ALL SELECT arm, split, id, ordinal, 'extra_slot', 'slots.' || unnest(list_filter(pk, lambda x: NOT list_contains(gk, x))) FROM keyed WHERE NOT (list_sort(gk) <> list_sort(pk) AND gnk = pnk)
  UNION ALL SELECT arm, split, id, ordinal, 'slot_value', 'slots.' || unnest(list_filter(list_intersect(gk, pk), lambda k: json_extract(g_sl, '$."' || k || '"')::VARCHAR <> json_extract(p_sl, '$."' || k || '"')::VARCHAR)) FROM keyed WHERE NOT (list_sort(gk) <> list_sort(pk) AND gnk = pnk)
  UNION ALL SELECT arm, split, id, ordinal, 'extra_field', unnest(extra) FROM keyed
  UNION ALL SELECT arm, split, id, ordinal, 'refusal_or_clarify', 'task_type.route' FROM keyed
    WHERE (p_tt <> g_tt OR p_rt <> g_rt) AND (p_tt IN ('clarify','blocked') OR g_tt IN ('clarify','blocked') OR p_rt IN ('clarify','deny') OR g_rt IN ('clarify','deny'))
)"""
)


@query(
    "residual_families",
    with_rows(
        """SELECT t.arm, t.split, f.family, CAST(count(r.id) AS BIGINT) AS residuals, count(r.id) / any_value(t.total)::DOUBLE AS proportion,
 coalesce(string_agg(r.id, ',' ORDER BY r.rn) FILTER (WHERE r.rn <= 3), '') AS examples
FROM (SELECT arm, split, count(*) AS total FROM scored GROUP BY ALL) t CROSS JOIN
 (SELECT unnest(['route','task_type','normalized_command','slot_key','slot_value','missing_slot','extra_slot','risk_level','confirmation',
  'success_criteria','allowed_actions','refusal_or_clarify','extra_field','missing_field','invalid_output']) AS family) f
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY arm, split, family ORDER BY ordinal) AS rn FROM res) r
 ON r.arm = t.arm AND r.split = t.split AND r.family = f.family GROUP BY t.arm, t.split, f.family""",
        RESIDUALS,
    ),
)
def residual_families(spark, sf_dir):
    """Zero-filled residual families with their first three rows."""
    return D.residual_families(fully(spark, sf_dir), ["arm", "split"])


@query(
    "residual_top_paths",
    with_rows(
        """SELECT * FROM (SELECT arm, field_path, CAST(count(*) AS BIGINT) AS residuals,
 row_number() OVER (PARTITION BY arm ORDER BY count(*) DESC, field_path) AS rank FROM res GROUP BY arm, field_path) WHERE rank <= 20""",
        RESIDUALS,
    ),
)
def residual_top_paths(spark, sf_dir):
    """K1: twenty most common residual paths."""
    return D.top_field_paths(fully(spark, sf_dir))


RECORDS = """
rec AS (SELECT arm, split, id, ordinal, source_id, g_tt || '|' || g_rt || '|' || g_re || '|confirm:' || g_cf || '|slots:' || list_aggregate(list_sort(json_keys(g_sl)), 'string_agg', ',') AS task_family,
  g_sl, p_sl, unnest(CASE WHEN NOT ok THEN ['schema'] ELSE list_filter([CASE WHEN p_tt <> g_tt THEN 'task_type' END, CASE WHEN p_rt <> g_rt THEN 'route' END,
  CASE WHEN p_al <> g_al THEN 'safety.allow' END, CASE WHEN p_re <> g_re THEN 'safety.reason' END, CASE WHEN p_cf <> g_cf THEN 'confirmation_required' END,
  CASE WHEN p_sl <> g_sl THEN 'slots' END, CASE WHEN p_cm <> g_cm THEN 'normalized_command' END], lambda x: x IS NOT NULL) END) AS field_path FROM scored),
recs AS (SELECT *, CASE field_path WHEN 'schema' THEN 'schema_invalid_prediction' WHEN 'slots' THEN 'slot_strict_mismatch'
  WHEN 'normalized_command' THEN 'normalized_command_strict_string_mismatch' WHEN 'safety.allow' THEN 'safety_field_strict_mismatch'
  WHEN 'safety.reason' THEN 'safety_field_strict_mismatch' ELSE field_path || '_strict_mismatch' END AS category,
  CASE WHEN field_path = 'schema' THEN 'schema_invalid_prediction' ELSE 'value_mismatch' END AS mismatch_category,
  CASE WHEN field_path = 'normalized_command' THEN 'normalized_command_paraphrase_drift'
   WHEN field_path = 'slots' AND list_sort(json_keys(g_sl)) = list_sort(json_keys(p_sl)) THEN 'slot_value_canonical_phrase_drift' ELSE 'other_value_drift' END AS drift_bucket
  FROM rec)"""


@query(
    "residual_clusters",
    with_rows(
        """SELECT *, row_number() OVER (PARTITION BY arm ORDER BY residual_rows DESC, residual_fields DESC, task_family, field_path, category) AS cluster_rank FROM (
SELECT arm, task_family, field_path, category, mismatch_category, count(DISTINCT id) AS residual_rows, count(*) AS residual_fields,
 count(DISTINCT source_id) AS source_families, count(DISTINCT id) FILTER (WHERE split = 'dev') AS dev_rows,
 count(DISTINCT id) FILTER (WHERE split = 'test') AS test_rows,
 list_aggregate((list(id ORDER BY ordinal))[1:5], 'string_agg', ',') AS examples, split_part(task_family, '|', 1) AS short_name
FROM recs GROUP BY arm, task_family, field_path, category, mismatch_category)""",
        RECORDS,
    ),
)
def residual_clusters(spark, sf_dir):
    """Ranked residual clusters."""
    return D.residual_clusters(records(spark, sf_dir))


@query(
    "drift_buckets",
    with_rows(
        """SELECT arm, d.n AS dimension, d.v AS value, count(*) AS residuals FROM (SELECT arm, unnest([
 {'n': 'split', 'v': split}, {'n': 'field_path', 'v': field_path}, {'n': 'source_id', 'v': source_id}, {'n': 'drift_bucket', 'v': drift_bucket},
 {'n': 'task_family', 'v': task_family}, {'n': 'category', 'v': category}]) AS d FROM recs) GROUP BY ALL""",
        RECORDS,
    ),
)
def drift_buckets(spark, sf_dir):
    """Drift counts by split, field, family and bucket."""
    return D.drift_counts(records(spark, sf_dir))


@query(
    "case_groups",
    with_rows(
        """SELECT arm, source_id, drift_bucket, count(*) AS residuals, count(DISTINCT id) AS residual_rows,
 string_agg(DISTINCT field_path, ',' ORDER BY field_path) AS field_paths FROM recs GROUP BY ALL""",
        RECORDS,
    ),
)
def case_groups(spark, sf_dir):
    """Residual groups for case design."""
    return D.case_groups(records(spark, sf_dir))


@query(
    "target_families",
    with_rows(
        """SELECT *, CASE WHEN priority = 1 THEN 'selected' WHEN short_name = 'blocked' THEN 'defer_to_dedicated_safety_boundary_phase'
 WHEN short_name IN ('search','navigate','extract') THEN 'defer_to_later_label_canonicalization_phase'
 WHEN short_name = 'form_fill' THEN 'defer_until_clarify_boundary_target_is_reviewed' ELSE 'defer_after_first_selected_cluster_review' END AS decision
FROM (SELECT *, CAST(short_name = 'blocked' AS INT) AS is_safety, row_number() OVER (PARTITION BY arm ORDER BY CAST(short_name = 'blocked' AS INT), residual_rows DESC, residual_fields DESC, task_family) AS priority
 FROM (SELECT arm, task_family, split_part(task_family, '|', 1) AS short_name, count(DISTINCT id) AS residual_rows, count(*) AS residual_fields FROM recs GROUP BY ALL))""",
        RECORDS,
    ),
)
def target_families(spark, sf_dir):
    """K5: first target and deferred families with reasons."""
    return D.target_families(records(spark, sf_dir))


@query(
    "form_fill_buckets",
    with_rows(
        """SELECT arm, CASE WHEN field_path = 'normalized_command' THEN 'missing_confirmation_marker' WHEN field_path = 'slots' THEN 'field_specificity_or_alias_drift'
 WHEN field_path IN ('task_type','route','safety.reason') THEN 'route_intent_leakage' ELSE 'other_form_fill_boundary_residual' END AS bucket,
 count(DISTINCT id) AS residual_rows, count(*) AS residual_fields, count(*) FILTER (WHERE split = 'dev') AS dev_fields,
 count(*) FILTER (WHERE split = 'test') AS test_fields FROM recs WHERE task_family LIKE 'form_fill|%' GROUP BY ALL""",
        RECORDS,
    ),
)
def form_fill_buckets(spark, sf_dir):
    """Buckets of the form family."""
    return D.form_fill_buckets(records(spark, sf_dir))


@query(
    "symptoms",
    with_rows(
        f"""SELECT arm, count(raw) AS prediction_count, {n('raw IS NULL')} AS missing_prediction_count,
 {n('raw IS NOT NULL AND NOT ok')} AS schema_invalid_prediction_count, {n("p_rt LIKE '/%'")} AS path_like_route_count,
 {n("t_sl = 'ARRAY'")} AS list_slots_count, {n("json_ok AND NOT list_contains(keys, 'confirmation_required')")} AS missing_confirmation_required_count
FROM scored GROUP BY arm"""
    ),
)
def symptoms(spark, sf_dir):
    """Prediction symptoms."""
    return D.symptoms(fully(spark, sf_dir))


FAMILIES = (
    PATHS
    + """,
pl AS (SELECT arm, id, list(field_path) AS l FROM mism GROUP BY ALL),
fam AS (SELECT s.*, coalesce(l, []) AS l FROM scored s LEFT JOIN pl USING (arm, id)),
fams AS (SELECT arm, split,
 CASE WHEN NOT ok AND list_contains(l, 'confirmation_required') THEN 'missing_required_field_schema_failure' WHEN NOT ok THEN 'schema_failure'
  WHEN list_has_any(l, ['task_type','route','safety.reason']) THEN 'semantic_task_route_safety_mismatch'
  WHEN list_contains(l, 'normalized_command') THEN 'strict_string_field_exact_match_mismatch' ELSE 'other_field_exact_match_mismatch' END AS confirmation_family,
 CASE WHEN list_contains(l, 'confirmation_required') THEN 'schema_missing_confirmation_required'
  WHEN p_tt NOT IN ('search','navigate','form_fill','extract','clarify','blocked') THEN 'schema_invalid_task_type_enum' WHEN NOT ok THEN 'schema_invalid_prediction_other'
  WHEN list_has_any(l, ['task_type','route','safety.allow','safety.reason','slots']) THEN 'schema_valid_task_route_safety_slot_mismatch'
  WHEN l = ['normalized_command'] THEN 'strict_string_field_exact_match_mismatch' WHEN list_contains(l, 'normalized_command') THEN 'normalized_command_with_other_field_mismatch'
  ELSE 'other_field_exact_match_mismatch' END AS rerun_family,
 CASE WHEN NOT list_contains(l, 'normalized_command') THEN NULL WHEN NOT ok THEN 'co_occurs_with_schema_failure'
  WHEN list_has_any(l, ['task_type','route','safety.allow','safety.reason']) THEN 'co_occurs_with_semantic_task_route_safety' WHEN l = ['normalized_command'] THEN 'strict_string_only'
  ELSE 'co_occurs_with_other_field_mismatch' END AS command_context,
 CASE WHEN coalesce(t_sl, '') <> 'OBJECT' THEN 'slot_type_or_shape_mismatch'
  WHEN json_extract(g_sl, '$.query')::VARCHAR <> json_extract(p_sl, '$.query')::VARCHAR THEN 'query_slot_strict_string_mismatch'
  WHEN g_sl <> p_sl THEN 'other_slot_exact_match_mismatch' ELSE 'slot_matches' END AS slot_shape FROM fam)"""
)


@query(
    "row_failure_families",
    with_rows(
        """SELECT arm, d.n AS dimension, d.v AS value, count(*) AS row_count FROM (SELECT arm, unnest([{'n': 'confirmation_family', 'v': confirmation_family},
 {'n': 'rerun_family', 'v': rerun_family}, {'n': 'command_context', 'v': command_context}, {'n': 'slot_shape', 'v': slot_shape}]) AS d FROM fams) GROUP BY ALL""",
        FAMILIES,
    ),
)
def row_failure_families(spark, sf_dir):
    """Primary failure family, command context and slot shape counts."""
    rows = D.row_families(fully(spark, sf_dir))
    return grouping_counts(
        rows, ["arm"], ["confirmation_family", "rerun_family", "command_context", "slot_shape"], [F.count("*").alias("row_count")]
    )


# Training rows without two kinds of contract, so that some held-out families have coarser analogues or none.
TRAIN = "split = 'train' AND ordinal % 6 <> 3 AND NOT (ordinal % 6 = 5 AND ordinal % 4 = 1)"
TUNED = "ordinal % 4 = 0 AND ordinal % 6 <> 0"


def family_analogues(spark, sf_dir):
    rows = scored(spark, sf_dir).where("arm = 'treatment'")
    role = F.when(F.expr(TRAIN), F.lit("train")).when(F.col("split").isin("dev", "test"), F.lit("held_out"))
    parts = rows.select("source_id", "split", role.alias("role"), F.expr(TUNED).alias("tuned"), (F.col("schema_ok") == 0).alias("invalid"), *A.family_parts(F.col("g")))
    return A.strategy(A.analogues(parts))


ANALOGUE_SQL = f"""fp AS (SELECT *, ordinal % 6 AS k6, g_tt AS p1, g_tt || '|' || g_rt AS p2, g_tt || '|' || g_rt || '|' || g_re AS p3, g_tt || '|' || g_rt || '|' || g_re || '|confirm:' || g_cf AS p4,
 g_tt || '|' || g_rt || '|' || g_re || '|confirm:' || g_cf || '|slots:' || list_aggregate(list_sort(json_keys(g_sl)), 'string_agg', ',') AS p5 FROM scored WHERE arm = 'treatment'),
ho AS (SELECT split, source_id, p1, p2, p3, p4, p5, g_tt, g_rt, count(*) AS row_count, count(*) FILTER (WHERE NOT ok) AS invalid_predictions FROM fp WHERE split IN ('dev', 'test') GROUP BY ALL),
tr AS (SELECT k.l AS l, k.p AS p, count(*) AS n, count(*) FILTER (WHERE {TUNED}) AS tuned FROM (SELECT ordinal, unnest([{{'l': 1, 'p': p1}}, {{'l': 2, 'p': p2}}, {{'l': 3, 'p': p3}}, {{'l': 4, 'p': p4}}, {{'l': 5, 'p': p5}}]) AS k FROM fp WHERE {TRAIN}) GROUP BY ALL),
an AS (SELECT ho.split, ho.source_id, p5 AS contract_family, g_tt AS task_type, g_rt AS route, row_count, invalid_predictions, CAST(coalesce(max(l), 0) AS INT) AS rung, coalesce(arg_max(n, l), 0) AS train_rows, coalesce(arg_max(tuned, l), 0) AS tuning_rows,
 coalesce(max(n) FILTER (WHERE l = 5), 0) AS exact_train_rows, coalesce(max(tuned) FILTER (WHERE l = 5), 0) AS exact_tuning_rows
 FROM ho LEFT JOIN tr ON (l = 1 AND p = p1) OR (l = 2 AND p = p2) OR (l = 3 AND p = p3) OR (l = 4 AND p = p4) OR (l = 5 AND p = p5) GROUP BY ALL),
ap AS (SELECT *, ['none', 'task_only', 'task_route', 'task_route_reason', 'without_slots', 'contract_family'][rung + 1] AS analogue_level,
 CASE WHEN rung = 5 THEN 'covered' WHEN rung > 0 THEN 'covered_by_coarser_family' ELSE 'absent' END AS coverage,
 CASE WHEN exact_train_rows > 0 AND exact_tuning_rows = 0 THEN 'targeted_sft_family_coverage' ELSE 'inspect_data_or_objective_gap' END AS strategy_bucket,
 CASE contract_family {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.HARD_NEGATIVES.items())} END AS hard_negative_category FROM an)"""


@query("train_analogues", with_rows("SELECT * FROM ap", ANALOGUE_SQL))
def train_analogues(spark, sf_dir):
    """Each held-out family with the finest training family that matches and its counts."""
    return family_analogues(spark, sf_dir)


@query(
    "heldout_strategy",
    with_rows(
        """SELECT split, count(*) AS families, CAST(sum(row_count) AS BIGINT) AS rows, count(DISTINCT contract_family) FILTER (WHERE exact_tuning_rows = 0) AS absent_from_tuning,
 count(DISTINCT contract_family) FILTER (WHERE exact_train_rows > 0) AS with_train_analogue, count(DISTINCT contract_family) FILTER (WHERE rung BETWEEN 1 AND 4) AS with_coarser_analogue,
 count(DISTINCT contract_family) FILTER (WHERE rung = 0) AS without_analogue, count(*) FILTER (WHERE strategy_bucket = 'targeted_sft_family_coverage') AS targeted,
 coalesce(string_agg(DISTINCT hard_negative_category, ',' ORDER BY hard_negative_category), '') AS hard_negative_categories FROM ap GROUP BY split""",
        ANALOGUE_SQL,
    ),
)
def heldout_strategy(spark, sf_dir):
    """Coverage of held-out families by training and tuning rows, per split."""
    return A.strategy_summary(family_analogues(spark, sf_dir))
