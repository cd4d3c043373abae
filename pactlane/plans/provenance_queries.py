"""Provenance, decode and streaming queries over the tables derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import decode as X
from pactlane.operators import evaluate as E
from pactlane.operators import provenance as P
from pactlane.operators import spans as S
from pactlane.operators.common import fits, grouping_counts
from pactlane.plans.evaluation_queries import _parts, contents, gold, paired, preds, scored
from pactlane.plans.inputs import table
from pactlane.plans.oracle_parts import n, with_rows
from pactlane.plans.registry import query
from pactlane.plans.shared import written
from pactlane.plans.slot_sql import MECHANISMS, MOVES, PROFILES
from pactlane.streaming.sidecar import outcome_summary, outcomes

SLOTS = r"""
sl0 AS (SELECT arm, id, ordinal, split, input_text, p_tt, p_rt, p_sl, unnest(json_keys(p_sl)) AS k FROM scored WHERE ok),
sl AS (SELECT *, json_type(p_sl, '$."' || k || '"') AS t, json_extract_string(p_sl, '$."' || k || '"') AS v FROM sl0),
sx AS (SELECT arm, id, split, input_text, p_tt || ':' || p_rt || ':' || k AS scope_key, k AS slot_path, t, v FROM sl WHERE t <> 'OBJECT'
 UNION ALL SELECT arm, id, split, input_text, p_tt || ':' || p_rt || ':' || k || s, k || s, 'X', NULL FROM sl CROSS JOIN (SELECT unnest(['.a[0]','.a[1]']) AS s) WHERE t = 'OBJECT'),
sn AS (SELECT *, scope_key IN ('search:search_web:query','form_fill:fill_form:field','extract:extract_page:target') AS enabled,
 (length(input_text) - length(replace(input_text, v, ''))) / length(v) AS n,
 regexp_replace(lower(v), '[\s\p{P}\p{Z}]', '', 'g') AS nv, regexp_replace(lower(input_text), '[\s\p{P}\p{Z}]', '', 'g') AS ns FROM sx),
sm AS (SELECT *, CASE WHEN nv = '' OR n > 0 THEN 0 ELSE (length(ns) - length(replace(ns, nv, ''))) / length(nv) END AS m FROM sn),
ver AS (SELECT *, CASE WHEN NOT enabled THEN 'OUT_OF_SCOPE' WHEN t <> 'VARCHAR' THEN 'UNSUPPORTED_VALUE_TYPE' WHEN n = 1 THEN 'VERIFIED_EXACT_UNIQUE' WHEN n > 1 OR m > 1 THEN 'AMBIGUOUS_MULTIPLE_MATCHES'
 WHEN m = 1 THEN 'VERIFIED_NORMALIZED_UNIQUE' ELSE 'NOT_FOUND' END AS status FROM sm)"""


def sources(spark, sf_dir):
    """One row for each input text with its two contract texts."""
    found = lambda: E.source_contents(paired(spark, sf_dir), contents(spark, sf_dir))
    return written(spark, sf_dir, "sources", lambda: found().repartition(_parts(spark), "id"))


def source_diags(spark, sf_dir):
    return written(
        spark, sf_dir, "diagnostics", lambda: P.diagnostics(P.slot_table(sources(spark, sf_dir)), P.default_policy(spark))
    )


def diags(spark, sf_dir):
    return E.beside_sources(paired(spark, sf_dir), source_diags(spark, sf_dir))


def gold_slots(spark, sf_dir):
    return P.slot_table(scored(spark, sf_dir), "g")


def source_audits(spark, sf_dir):
    return written(spark, sf_dir, "audits", lambda: P.audits(source_diags(spark, sf_dir), P.slot_table(sources(spark, sf_dir), "g")))


def audited(spark, sf_dir):
    return E.beside_sources(paired(spark, sf_dir), source_audits(spark, sf_dir))


CONTENT_BYTES = 100  # of a hash and a number


def mech(spark, sf_dir):
    """Mechanisms of all samples, found once per input text with its two contract texts; samples of equal
    outcome are counted (``copies``)."""
    return written(spark, sf_dir, "mechanisms", lambda: P.counted_mechanisms(profiled(spark, sf_dir), profiles(spark, sf_dir)))


def source_profiles(spark, sf_dir):
    return written(spark, sf_dir, "source_profiles", lambda: P.slot_profile_texts(sources(spark, sf_dir)).withColumn("number", F.xxhash64("profile")))


def profiles(spark, sf_dir):
    return source_profiles(spark, sf_dir).select("number", "profile").distinct()


def profiled(spark, sf_dir):
    """Rows of ``paired`` that have a valid prediction, with the number of their profile."""
    number = source_profiles(spark, sf_dir).select(F.col("id").alias("content"), F.col("number").alias("profile"))
    return E.sourced(paired(spark, sf_dir)).select("arm", "id", "split", "content").join(fits(number, CONTENT_BYTES), "content")


def condition():
    """Challenge condition of a row, from its number."""
    c = F.col("ordinal") % 7
    return (
        F.when(c == 3, F.lit("duplicate_exact")).when(c == 4, F.lit("source_absent")).when(c == 5, F.lit("normalization_candidate"))
        .when(c == 6, F.lit("partial_span_trap")).otherwise(F.lit("exact_unique"))
    )


@query(
    "span_statistics",
    with_rows(
        """SELECT arm, split, count(*) AS events, CAST(count(*) FILTER (WHERE status = 'VERIFIED_EXACT_UNIQUE') AS BIGINT) AS exact_unique, CAST(count(*) FILTER (WHERE status = 'VERIFIED_NORMALIZED_UNIQUE') AS BIGINT) AS normalized_unique,
 CAST(count(*) FILTER (WHERE status = 'AMBIGUOUS_MULTIPLE_MATCHES') AS BIGINT) AS ambiguous, CAST(count(*) FILTER (WHERE status = 'NOT_FOUND') AS BIGINT) AS not_found,
 CAST(count(*) FILTER (WHERE status = 'UNSUPPORTED_VALUE_TYPE') AS BIGINT) AS unsupported, CAST(count(*) FILTER (WHERE status = 'OUT_OF_SCOPE') AS BIGINT) AS out_of_scope, CAST(0 AS BIGINT) AS invalid_input,
 CAST(count(*) FILTER (WHERE status LIKE 'VERIFIED%') AS BIGINT) AS verified, count(*) FILTER (WHERE status LIKE 'VERIFIED%') / count(*)::DOUBLE AS verified_rate,
 count(*) FILTER (WHERE status NOT LIKE 'VERIFIED%') / count(*)::DOUBLE AS fail_closed_rate FROM ver GROUP BY arm, split""",
        SLOTS,
    ),
)
def span_statistics(spark, sf_dir):
    """Span verification of predicted slots."""
    return P.span_statistics(diags(spark, sf_dir), ["arm", "split"])


# Benchmark texts as they stand, with other separators, and their first sentences.
VARIANTS = (("whole", "text"), ("dashed", "replace(text, ' ', ' - ')"), ("sentence", "regexp_extract(text, '^[^.]{24,}', 0)"))
PASSAGES = " UNION ALL ".join(f"SELECT item_id || ':{name}' AS key, {sql} AS text FROM benchmark" for name, sql in VARIANTS)


def passages(spark, sf_dir):
    pairs = ", ".join(f"struct(item_id || ':{name}' AS key, {sql} AS text)" for name, sql in VARIANTS)
    return table(spark, sf_dir, "benchmark").selectExpr(f"inline(array({pairs}))")


def verified_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return written(spark, sf_dir, "span_verify", lambda: S.verified(S.occurrences(passages(spark, sf_dir), docs)))


SPAN_SQL = rf"""p AS MATERIALIZED (SELECT key, text AS v, regexp_replace(lower(text), '[\s\p{{P}}\p{{Z}}]+', '', 'g') AS fv FROM ({PASSAGES})),
s AS MATERIALIZED (SELECT doc_id, text AS t, regexp_replace(lower(text), '[\s\p{{P}}\p{{Z}}]+', '', 'g') AS ft FROM documents),
h AS MATERIALIZED (SELECT key, doc_id, v, t, fv, ft, list_filter(range(0, length(t) - length(v) + 1), lambda i: substr(t, i + 1, length(v)) = v) AS e,
 list_filter(range(0, length(ft) - length(fv) + 1), lambda i: substr(ft, i + 1, length(fv)) = fv) AS f FROM p JOIN s ON contains(ft, fv) AND fv <> ''),
vr AS (SELECT key, doc_id, CASE WHEN len(e) = 1 THEN 'VERIFIED_EXACT_UNIQUE' WHEN len(e) > 1 OR len(f) > 1 THEN 'AMBIGUOUS_MULTIPLE_MATCHES' ELSE 'VERIFIED_NORMALIZED_UNIQUE' END AS status,
 CASE WHEN len(e) > 0 THEN len(e) ELSE len(f) END AS n, CASE WHEN len(e) = 1 THEN e[1] WHEN len(e) = 0 AND len(f) = 1 THEN
 list_filter(range(0, length(t)), lambda i: regexp_matches(substr(t, i + 1, 1), '[^\s\p{{P}}\p{{Z}}]'))[f[1] + 1] END AS start FROM h)"""


@query(
    "span_verify",
    f"""WITH {SPAN_SQL} SELECT key AS passage_key, doc_id AS source_key, status, CASE status WHEN 'VERIFIED_EXACT_UNIQUE' THEN 'exact' WHEN 'VERIFIED_NORMALIZED_UNIQUE' THEN 'normalized' ELSE 'none' END AS match_kind,
 n AS candidate_span_count, CAST(start AS INT) AS start FROM vr""",
)
def span_verify(spark, sf_dir):
    """benchmark passages inside whole documents, exactly or up to case and separators."""
    return verified_passages(spark, sf_dir)


@query(
    "passage_statistics",
    f"""WITH {SPAN_SQL}, g AS (SELECT key, count(*) AS sources, count(*) FILTER (WHERE status = 'VERIFIED_EXACT_UNIQUE') AS exact_unique, count(*) FILTER (WHERE status = 'VERIFIED_NORMALIZED_UNIQUE') AS normalized_unique,
 count(*) FILTER (WHERE status LIKE 'AMBIG%') AS ambiguous FROM vr GROUP BY key)
SELECT key AS passage_key, coalesce(sources, 0) AS sources, coalesce(exact_unique, 0) AS exact_unique, coalesce(normalized_unique, 0) AS normalized_unique, coalesce(ambiguous, 0) AS ambiguous,
 sources IS NULL AS not_found, (exact_unique + normalized_unique) / sources::DOUBLE AS verified_rate FROM p LEFT JOIN g USING (key)""",
)
def passage_statistics(spark, sf_dir):
    """Per passage the documents that hold it, by status."""
    return S.passage_statistics(passages(spark, sf_dir), verified_passages(spark, sf_dir))


@query(
    "sidecars",
    with_rows(
        """SELECT arm, id, sha256(any_value(input_text)) AS input_hash, count(*) AS slots, CAST(count(*) FILTER (WHERE status = 'VERIFIED_EXACT_UNIQUE') AS BIGINT) AS trusted_count,
 CAST(count(*) FILTER (WHERE status = 'VERIFIED_NORMALIZED_UNIQUE') AS BIGINT) AS candidate_count,
 string_agg(d, ';' ORDER BY d) AS diagnostics FROM (SELECT *, concat_ws('/', slot_path, scope_key, status, CASE WHEN status = 'VERIFIED_EXACT_UNIQUE'
  THEN (instr(input_text, v) - 1) || '-' || (instr(input_text, v) - 1 + length(v)) END) AS d FROM ver) GROUP BY arm, id""",
        SLOTS,
    ),
)
def sidecar_rows(spark, sf_dir):
    """One sidecar per prediction."""
    cars = P.sidecars(diags(spark, sf_dir))
    return cars.select(
        "arm", "id", "input_hash", F.size("slot_diagnostics").cast("bigint").alias("slots"), F.col("trusted_count").cast("bigint").alias("trusted_count"),
        F.col("candidate_count").cast("bigint").alias("candidate_count"),
        F.array_join(F.array_sort(F.transform("slot_diagnostics", _shown)), ";").alias("diagnostics"),
    )


def _shown(e):
    """One slot diagnostic as text: path, scope, status and, for trusted values, the span."""
    span = F.when(e["trusted_provenance"], F.concat_ws("-", e["span"]["start"], e["span"]["end"]))
    return F.concat_ws("/", e["slot_path"], e["scope_key"], e["status"], span)


@query("sidecar_privacy")
def sidecar_privacy(spark, sf_dir):
    """Sidecars that leak gold, text or private values (none)."""
    return E.beside_sources(paired(spark, sf_dir), P.sidecar_privacy(P.sidecars(source_diags(spark, sf_dir))))


@query("sidecar_integrity")
def sidecar_integrity(spark, sf_dir):
    """Diagnostics regenerate identically (no difference)."""
    again = P.diagnostics(P.slot_table(scored(spark, sf_dir)), P.default_policy(spark))
    return P.integrity(diags(spark, sf_dir), again)


@query(
    "false_accepts",
    with_rows(
        "SELECT arm, count(*) AS trusted, CAST(0 AS BIGINT) AS false_accepts FROM ver WHERE status = 'VERIFIED_EXACT_UNIQUE' GROUP BY arm", SLOTS
    ),
)
def false_accepts(spark, sf_dir):
    """Trusted spans verified again."""
    return P.false_accepts(diags(spark, sf_dir))


AUDIT = (
    SLOTS
    + r""",
au AS (SELECT r.*, s.ordinal, json_type(g_sl, '$."' || slot_path || '"') AS gt, json_extract_string(g_sl, '$."' || slot_path || '"') AS gold_text, p_tt = g_tt AND p_rt = g_rt AS same_head,
 CASE s.ordinal % 7 WHEN 3 THEN 'duplicate_exact' WHEN 4 THEN 'source_absent' WHEN 5 THEN 'normalization_candidate' WHEN 6 THEN 'partial_span_trap' ELSE 'exact_unique' END AS condition
 FROM ver r JOIN scored s USING (arm, id)),
ax AS (SELECT *, status = 'VERIFIED_EXACT_UNIQUE' AS trusted, coalesce(status = 'VERIFIED_EXACT_UNIQUE' AND same_head AND gt = 'VARCHAR' AND gold_text = v, false) AS correct,
 regexp_replace(lower(v), '[\s\p{P}\p{Z}\p{S}]', '', 'g') AS lv, regexp_replace(lower(input_text), '[\s\p{P}\p{Z}\p{S}]', '', 'g') AS ls FROM au)"""
)


@query(
    "scope_metrics",
    with_rows(
        f"""SELECT *, trusted / nullif(observed, 0)::DOUBLE AS trusted_rate, trusted_correct / nullif(trusted, 0)::DOUBLE AS trusted_correct_rate FROM (
 SELECT arm, d.n AS dimension, d.v AS value, count(*) AS observed, {n('trusted')} AS trusted, {n("status = 'VERIFIED_NORMALIZED_UNIQUE'")} AS candidate,
  {n("status = 'AMBIGUOUS_MULTIPLE_MATCHES'")} AS ambiguous, {n("status = 'NOT_FOUND'")} AS not_found, {n("status = 'OUT_OF_SCOPE'")} AS out_of_scope,
  {n('correct')} AS trusted_correct, {n('trusted AND NOT correct')} AS trusted_mismatch
 FROM (SELECT *, unnest([{{'n': 'overall', 'v': 'all'}}, {{'n': 'scope_key', 'v': scope_key}}, {{'n': 'condition', 'v': condition}}]) AS d FROM ax) GROUP BY ALL)""",
        AUDIT,
    ),
)
def scope_metrics(spark, sf_dir):
    """Trust counters overall, per scope and per condition."""
    return P.scope_metrics(audited(spark, sf_dir), condition())


@query(
    "mismatch_ledger",
    with_rows(
        r"""SELECT arm, scope_key, CASE WHEN slot_path = 'action' THEN 'WRONG_SLOT_OR_SCOPE_SELECTION' WHEN condition = 'source_absent' THEN 'SOURCE_ABSENT_SUBSTITUTION'
 WHEN lv <> '' AND (length(ls) - length(replace(ls, lv, ''))) / length(lv) > 1 THEN 'NORMALIZATION_EQUIVALENCE_COLLISION' WHEN condition = 'duplicate_exact' THEN 'DUPLICATE_CONTEXT_DISAMBIGUATION_FAILURE'
 WHEN gold_text IS NULL OR gt <> 'VARCHAR' THEN 'UNCLASSIFIED_SEMANTIC_MISMATCH' WHEN condition = 'partial_span_trap' AND starts_with(v, gold_text) THEN 'OVERLONG_SOURCE_SPAN'
 WHEN condition = 'partial_span_trap' OR starts_with(gold_text, v) THEN 'UNDERSPECIFIED_PARTIAL_SPAN' WHEN nv = regexp_replace(lower(gold_text), '[\s\p{P}\p{Z}]', '', 'g')
 THEN 'CHALLENGE_FIXTURE_OR_GOLD_AMBIGUITY' ELSE 'GENERATED_VALUE_MISMATCH' END AS primary_mechanism, count(*) AS events FROM ax WHERE trusted AND NOT correct GROUP BY ALL""",
        AUDIT,
    ),
)
def mismatch_ledger(spark, sf_dir):
    """Mechanism of trusted values that disagree with gold."""
    mismatched = P.collision_audit(source_audits(spark, sf_dir).where("trusted AND gold_correct = false"))
    led = P.mismatch_ledger(E.beside_sources(paired(spark, sf_dir), mismatched), condition())
    return led.groupBy("arm", "scope_key", "primary_mechanism").agg(F.count("*").alias("events"))


GOLD_SLOTS = r"""
gs0 AS (SELECT id, g_tt, g_rt, input_text, g_sl, unnest(json_keys(g_sl)) AS k FROM scored WHERE arm = 'control'),
gs AS (SELECT *, json_type(g_sl, '$."' || k || '"') AS t, json_extract_string(g_sl, '$."' || k || '"') AS v FROM gs0),
gn AS (SELECT *, (length(input_text) - length(replace(input_text, v, ''))) / length(v) AS n, regexp_replace(lower(v), '[\s\p{P}\p{Z}]', '', 'g') AS nv,
 regexp_replace(lower(input_text), '[\s\p{P}\p{Z}]', '', 'g') AS ns FROM gs),
gv AS (SELECT g_tt, g_rt, k, t = 'VARCHAR' AND (n = 1 OR (n = 0 AND nv <> '' AND (length(ns) - length(replace(ns, nv, ''))) / length(nv) = 1)) AS good FROM gn)"""


@query(
    "scope_policy",
    with_rows(
        """SELECT task_type, route, slot_path, events, verified, verified / events::DOUBLE AS verified_rate, exclusion_reason = '' AS enabled, exclusion_reason FROM (
 SELECT *, concat_ws('; ', CASE WHEN slot_path NOT IN ('query', 'field', 'target') THEN 'slot_path_not_enabled_in_this_slice' END,
  CASE WHEN slot_path = 'action' THEN 'action_semantics_depend_on_blocked_clarify_safety_contexts' END, CASE WHEN events < 10 THEN 'sample_count_below_10' END,
  CASE WHEN verified / events::DOUBLE < 0.7 THEN 'copyable_rate_below_0.70' END) AS exclusion_reason FROM (
  SELECT g_tt AS task_type, g_rt AS route, k AS slot_path, count(*) AS events, CAST(count(*) FILTER (WHERE good) AS BIGINT) AS verified FROM gv GROUP BY ALL))""",
        GOLD_SLOTS,
    ),
)
def scope_policy(spark, sf_dir):
    """Data-driven scope policy from gold slots."""
    g = gold_slots(spark, sf_dir).where(F.col("arm") == "control")
    return P.scope_policy(g)


@query(
    "key_policy",
    with_rows(
        """SELECT g_tt AS task_type, g_rt AS route, k AS slot_path, count(*) AS rows_with_key, count(*) AS rows_total, 'required' AS rule FROM (SELECT g_tt, g_rt, unnest(json_keys(g_sl)) AS k FROM scored WHERE arm = 'control') GROUP BY ALL"""
    ),
)
def key_policy(spark, sf_dir):
    """Required and optional keys per task."""
    return P.key_policy(gold_slots(spark, sf_dir).where(F.col("arm") == "control"))


@query(
    "slot_mechanisms",
    with_rows(
        """SELECT arm, d.n AS dimension, d.v AS value, count(*) AS slots FROM (SELECT arm, unnest([{'n': 'split', 'v': split}, {'n': 'task_type', 'v': task_type}, {'n': 'route', 'v': route}, {'n': 'slot_path', 'v': slot_path},
 {'n': 'gold_support', 'v': gold_support}, {'n': 'provenance', 'v': provenance}, {'n': 'mechanism', 'v': mechanism}]) AS d FROM mx) GROUP BY ALL""",
        MECHANISMS,
    ),
)
def slot_mechanisms(spark, sf_dir):
    """Mechanism, support and provenance counts."""
    dims = ["split", "task_type", "route", "slot_path", "gold_support", "provenance", "mechanism"]
    return grouping_counts(mech(spark, sf_dir), ["arm"], dims, [F.sum("copies").alias("slots")])


@query(
    "slot_movements",
    with_rows(
        """SELECT *, recovered - regressed AS net_movement, persistent / slots::DOUBLE AS persistent_rate FROM (SELECT split, count(*) AS slots, CAST(count(*) FILTER (WHERE movement LIKE 'ERROR_IN_BOTH%') AS BIGINT) AS persistent,
 CAST(count(*) FILTER (WHERE movement IN ('RECOVERED_BY_TREATMENT', 'SLOT_ADDED_CORRECTLY')) AS BIGINT) AS recovered,
 CAST(count(*) FILTER (WHERE movement IN ('INTRODUCED_BY_TREATMENT', 'SLOT_ADDED_INCORRECTLY', 'SLOT_REMOVED_INCORRECTLY')) AS BIGINT) AS regressed FROM mo GROUP BY split)""",
        MOVES,
    ),
)
def slot_movements(spark, sf_dir):
    """Movement totals per split."""
    return P.movement_summary(P.slot_movements(mech(spark, sf_dir)))


@query(
    "slot_movement_labels",
    with_rows(
        """SELECT movement, d.n AS dimension, d.v AS value, count(*) AS slots FROM (SELECT movement, unnest([{'n': 'split', 'v': split}, {'n': 'task_type', 'v': task_type}, {'n': 'route', 'v': route}, {'n': 'slot_path', 'v': slot_path}]) AS d FROM mo) GROUP BY ALL""",
        MOVES,
    ),
)
def slot_movement_labels(spark, sf_dir):
    """The nine movement labels by split, task, route and slot."""
    return grouping_counts(P.slot_movements(mech(spark, sf_dir)), ["movement"], ["split", "task_type", "route", "slot_path"], [F.sum("copies").alias("slots")])


@query("top_mechanism_pairs", with_rows("SELECT cm, tm, count(*) AS slots FROM mo WHERE movement LIKE 'ERROR_IN_BOTH%' GROUP BY ALL ORDER BY slots DESC, cm, tm LIMIT 8", MOVES))
def top_mechanism_pairs(spark, sf_dir):
    """K2: most common persistent mechanism pairs."""
    return P.top_mechanism_pairs(P.slot_movements(mech(spark, sf_dir)))


@query("slot_profiles", with_rows("SELECT *, round(regression_rate + missing_rate + partial_rate, 9) AS pressure FROM pf ORDER BY pressure DESC, sample_count DESC, slot_path DESC LIMIT 10", PROFILES))
def slot_profiles(spark, sf_dir):
    """Slot profiles by pressure."""
    m = mech(spark, sf_dir)
    return P.pressure_profiles(P.slot_profiles(m, P.slot_movements(m)))


@query(
    "representation_feasibility",
    with_rows(
        """SELECT *, CASE WHEN n = 0 THEN 'ANALYSIS_BLOCKED_OR_INCONCLUSIVE' WHEN missing_or_extra >= greatest(1, n // 3) THEN 'TASK_SLOT_SCHEMA_CONSTRAINTS_FIRST' WHEN typed >= greatest(1, n // 2) THEN 'TYPED_NORMALIZATION_FIRST'
 WHEN representations > 1 THEN 'MIXED_SLOT_REPRESENTATION_REQUIRED' WHEN copyable = n THEN 'COPY_OR_NORMALIZE_REPRESENTATION_JUSTIFIED' ELSE 'DATA_DIVERSITY_OR_GENERALIZATION_FIRST' END AS decision_label FROM (
 SELECT count(*) AS n, CAST(count(*) FILTER (WHERE missing_rate + extra_rate >= 0.12) AS BIGINT) AS missing_or_extra, CAST(count(*) FILTER (WHERE typed_rate >= 0.20) AS BIGINT) AS typed,
 CAST(count(*) FILTER (WHERE copyable_rate >= 0.75) AS BIGINT) AS copyable, count(DISTINCT representation) AS representations FROM pf)""",
        PROFILES,
    ),
)
def representation_feasibility(spark, sf_dir):
    """Representation decision."""
    m = mech(spark, sf_dir)
    return P.feasibility(P.slot_profiles(m, P.slot_movements(m)))


@query(
    "latency_summary",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS samples, max(value) FILTER (WHERE i = round_even((n - 1) * 0.5, 0)) AS p50, max(value) FILTER (WHERE i = round_even((n - 1) * 0.95, 0)) AS p95,
 max(value) FILTER (WHERE i = round_even((n - 1) * 0.99, 0)) AS p99, max(value) AS max FROM r GROUP BY event_type""",
)
def latency_summary(spark, sf_dir):
    """Percentiles of recorded values by the index rule."""
    return P.latency(table(spark, sf_dir, "events").where("value IS NOT NULL"), ["event_type"], "value")


# ---- decoded attempts ------------------------------------------------------------------

ATT = """
att AS (SELECT arm, CASE WHEN trim(raw) = '' THEN 'empty' WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN 'json_object' WHEN json_valid(raw) THEN 'json_non_object'
 WHEN json_valid(regexp_extract(raw, '(?s)\\{.*\\}')) THEN 'json_fragment_object' ELSE 'non_json' END AS parse_status, raw FROM predictions)"""


@query(
    "decode_symptoms",
    with_rows(
        """SELECT arm, parse_status, count(*) AS attempts, CAST(count(*) FILTER (WHERE raw LIKE '%"task_type":"query_weather_request"%') AS BIGINT) AS legacy_alias_count,
 CAST(count(*) FILTER (WHERE raw LIKE '%"route":"/%') AS BIGINT) AS path_like_route_count, CAST(count(*) FILTER (WHERE NOT (raw LIKE '{%' AND rtrim(raw) LIKE '%}')) AS BIGINT) AS wrapper_count FROM att GROUP BY ALL""",
        ATT,
    ),
)
def decode_symptoms(spark, sf_dir):
    """Parse status and decode symptoms."""
    return X.decode_symptoms(preds(spark, sf_dir), "raw", ["arm"])


@query(
    "schema_guard",
    with_rows(
        """SELECT CASE WHEN a.ok THEN 'raw_attempt' WHEN b.raw IS NOT NULL AND b.ok THEN 'retry_attempt' ELSE 'none' END AS validated_source, count(*) AS row_count,
 CAST(count(*) FILTER (WHERE a.ok) AS BIGINT) AS raw_valid, CAST(count(*) FILTER (WHERE b.raw IS NOT NULL AND b.ok) AS BIGINT) AS retry_valid
FROM scored a JOIN scored b ON a.id = b.id AND a.arm = 'control' AND b.arm = 'treatment' GROUP BY ALL"""
    ),
)
def schema_guard(spark, sf_dir):
    """Raw output first, retry second."""
    wide = preds(spark, sf_dir).groupBy("id").agg(
        F.max(F.when(F.col("arm") == "control", F.col("raw"))).alias("raw"), F.max(F.when(F.col("arm") == "treatment", F.col("raw"))).alias("retry")
    )
    df = X.schema_guard(gold(spark, sf_dir).select("id").join(wide, "id", "left"), "raw", "retry")
    return df.groupBy(F.col("guard.validated_source").alias("validated_source")).agg(
        F.count("*").alias("row_count"), F.count_if("guard.raw_valid").alias("raw_valid"), F.count_if("guard.retry_valid").alias("retry_valid")
    )


@query(
    "hook_outcomes",
    with_rows(
        """SELECT arm, CASE WHEN raw IS NULL THEN 'SHADOW_INVALID_INPUT' WHEN j IS NULL THEN 'SHADOW_INVALID_INPUT' WHEN NOT ok THEN 'SHADOW_INVALID_CONTRACT' ELSE 'COMPLETED' END AS hook_status,
 CASE WHEN raw IS NULL THEN 'prediction_empty' WHEN NOT json_valid(raw) THEN 'prediction_malformed_json' WHEN j IS NULL THEN 'prediction_unsupported_type' WHEN NOT ok THEN 'prediction_schema_invalid' ELSE 'none' END AS error_code,
 count(*) AS invocations, CAST(coalesce(sum(tr), 0) AS BIGINT) AS trusted, CAST(coalesce(sum(ca), 0) AS BIGINT) AS candidates, CAST(count(*) FILTER (WHERE raw IS NULL OR j IS NULL OR NOT ok) AS BIGINT) AS isolated
FROM scored LEFT JOIN (SELECT arm, id, count(*) FILTER (WHERE status = 'VERIFIED_EXACT_UNIQUE') AS tr, count(*) FILTER (WHERE status = 'VERIFIED_NORMALIZED_UNIQUE') AS ca FROM ver GROUP BY ALL) USING (arm, id) GROUP BY ALL""",
        SLOTS,
    ),
)
def hook_outcomes(spark, sf_dir):
    """Outcome of every prediction through the stream's batch function."""
    rows = scored(spark, sf_dir).select("arm", "id", "ordinal", "split", "input_text", "raw")
    return outcome_summary(outcomes(rows, P.default_policy(spark)))
