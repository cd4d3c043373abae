"""SQL of the slot family: where gold and predicted slot values come from and what went wrong.

Written from the definitions with DuckDB's own functions; the Spark side shares nothing with it but
the fixed word lists and the derivation of the input tables.
"""

from __future__ import annotations

from pactlane.functions import constants as C
from pactlane.functions.text import URL_LIKE

DATE = r"(\d{4})[-年/](\d{1,2})[-月/](\d{1,2})日?"
NUMBER = r"^([+-]?)(\d+)(?:\.(\d+))?$"


def word(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{Nd}}]', '', 'g')"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def forms(x: str, path: str) -> str:
    """Normal forms of a text with their rule."""
    part = lambda k: f"regexp_extract(trim({x}), '{NUMBER}', {k})"
    day = lambda k, n: f"lpad(regexp_extract({x}, '{DATE}', {k}), {n}, '0')"
    number = (
        f"CASE WHEN regexp_matches(trim({x}), '{NUMBER}') THEN CASE WHEN {part(1)} = '-' THEN '-' ELSE '' END || regexp_replace({part(2)}, '^0+(.)', '\\1') || "
        f"CASE WHEN rtrim({part(3)}, '0') = '' THEN '' ELSE '.' || rtrim({part(3)}, '0') END END"
    )
    pairs = {
        "text_fold": word(x),
        "url_canonical": f"CASE WHEN contains(lower({path}), 'url') OR regexp_matches({x}, '{URL_LIKE}') THEN regexp_replace(regexp_replace(trim(lower({x})), '^https?://', ''), '/+$', '') END",
        "date_iso": f"CASE WHEN regexp_matches({x}, '{DATE}') THEN {day(1, 4)} || '-' || {day(2, 2)} || '-' || {day(3, 2)} END",
        "number_canonical": number,
        "phone_digits": rf"CASE WHEN length(regexp_replace({x}, '\D', '', 'g')) >= 7 THEN regexp_replace({x}, '\D', '', 'g') END",
        "boolean_canonical": f"CASE WHEN {word(x)} IN ({_list(C.TRUE_WORDS)}) THEN 'true' WHEN {word(x)} IN ({_list(C.FALSE_WORDS)}) THEN 'false' END",
    }
    listed = ", ".join(f"{{'r': '{r}', 'v': {v}}}" for r, v in pairs.items())
    return f"list_filter([{listed}], lambda f: f['v'] IS NOT NULL AND f['v'] <> '')"


def support(s: str) -> str:
    """Support class of side ``s`` (g or p) of a slot."""
    hit = f"list_filter({s}_forms, lambda c: list_contains(list_transform(src_forms, lambda q: q['v']), c['v']) OR contains(src_word, {word(chr(99) + chr(91) + chr(39) + 'v' + chr(39) + chr(93))}))[1]['r']"
    return f"""CASE WHEN {s}_text IS NULL OR trim({s}_text) = '' THEN 'source_absent_or_generation_required' WHEN contains(input_text, {s}_text) THEN 'exact_source_supported'
 WHEN {s}_word <> '' AND contains(src_word, {s}_word) THEN 'normalized_source_supported' WHEN {hit} IN ('text_fold', 'url_canonical') THEN 'normalized_source_supported'
 WHEN {hit} IS NOT NULL THEN 'typed_derivable' ELSE 'source_absent_or_generation_required' END"""


def overlap(a: str, b: str) -> str:
    """Containment either way or enough distinct characters in common."""
    chars = lambda x: f"list_distinct(string_split({x}, ''))"
    return f"""CASE WHEN length({a}) < 2 OR length({b}) = 0 THEN false WHEN contains({b}, {a}) OR contains({a}, {b}) THEN true
 ELSE len(list_intersect({chars(a)}, {chars(b)})) >= greatest(2, least(len({chars(a)}), 4)) END"""


def differs(rule: str) -> str:
    of = lambda s: f"list_filter({s}_forms, lambda f: f['r'] = '{rule}')[1]['v']"
    return f"coalesce({of('g')} <> {of('p')}, false)"


_TEXT = """CASE json_type({j}, '$."' || k || '"') WHEN 'BOOLEAN' THEN CASE json_extract_string({j}, '$."' || k || '"') WHEN 'true' THEN 'True' ELSE 'False' END ELSE json_extract_string({j}, '$."' || k || '"') END"""
_ALIASES = "CASE path " + " ".join(f"WHEN '{k}' THEN [{_list(v)}]" for k, v in C.SLOT_PATH_ALIASES.items()) + " ELSE [] END"
_OVERLAPS = f"({overlap('p_word', 'g_word')}) OR ({overlap('g_word', 'p_word')})"

MECHANISMS = f"""
vb AS (SELECT id FROM scored WHERE ok GROUP BY id HAVING count(DISTINCT arm) = 2),
e0 AS (SELECT id, 'gold' AS side, g_sl AS j, unnest(json_keys(g_sl)) AS k FROM scored WHERE arm = 'control' AND id IN (SELECT id FROM vb)
 UNION ALL SELECT id, arm, p_sl, unnest(json_keys(p_sl)) FROM scored WHERE id IN (SELECT id FROM vb)),
e1 AS (SELECT id, side, k AS path, json_type(j, '$."' || k || '"') AS kind, coalesce({_TEXT.format(j="j")}, '') AS text FROM e0 WHERE json_type(j, '$."' || k || '"') <> 'OBJECT'
 UNION ALL SELECT id, side, k || '.a[0]', 'VARCHAR', json_extract_string(j, '$."' || k || '".a[0]') FROM e0 WHERE json_type(j, '$."' || k || '"') = 'OBJECT'
 UNION ALL SELECT id, side, k || '.a[1]', 'UBIGINT', json_extract_string(j, '$."' || k || '".a[1]') FROM e0 WHERE json_type(j, '$."' || k || '"') = 'OBJECT'),
ev AS MATERIALIZED (SELECT *, {word("text")} AS word, {forms("text", "path")} AS forms FROM e1),
pl AS (SELECT id, side, list({{'path': path, 'vals': list_transform(forms, lambda f: f['v'])}}) AS others FROM ev GROUP BY ALL),
hd AS (SELECT id, ordinal, split, source_id, input_text, g_tt AS task_type, g_rt AS route, {word("input_text")} AS src_word, {forms("input_text", "''")} AS src_forms FROM scored WHERE arm = 'control' AND id IN (SELECT id FROM vb)),
m0 AS MATERIALIZED (SELECT h.*, q.path, a.arm, g.kind AS g_kind, g.text AS g_text, g.word AS g_word, g.forms AS g_forms, p.kind AS p_kind, p.text AS p_text, p.word AS p_word, p.forms AS p_forms, coalesce(o.others, []) AS others, {_ALIASES.replace("path", "q.path", 1)} AS names
 FROM (SELECT DISTINCT id, path FROM ev) q CROSS JOIN (SELECT unnest(['control', 'treatment']) AS arm) a JOIN hd h USING (id)
 LEFT JOIN ev g ON g.id = q.id AND g.path = q.path AND g.side = 'gold' LEFT JOIN ev p ON p.id = q.id AND p.path = q.path AND p.side = a.arm LEFT JOIN pl o ON o.id = q.id AND o.side = a.arm),
m1 AS (SELECT *, g_text IS NOT NULL AS has_gold, p_text IS NOT NULL AS has_pred, CASE WHEN g_text IS NOT NULL THEN {support("g")} END AS gold_support, CASE WHEN p_text IS NOT NULL THEN {support("p")} END AS pred_support,
 list_transform(g_forms, lambda f: f['v']) AS gv, list_transform(p_forms, lambda f: f['v']) AS pv FROM m0),
m2 AS (SELECT *, CASE WHEN p_text IS NULL OR trim(p_text) = '' THEN 'unavailable' WHEN pred_support = 'exact_source_supported' THEN 'exact_span_from_source' WHEN pred_support = 'normalized_source_supported' THEN 'normalized_span_from_source'
 WHEN pred_support = 'typed_derivable' THEN 'deterministic_derived' WHEN {overlap("p_word", "src_word")} THEN 'partial_span_from_source' ELSE 'unsupported_by_source' END AS provenance,
 len(list_filter(others, lambda e: list_contains(names, e['path']) AND len(list_intersect(e['vals'], gv)) > 0)) > 0 AS alias_hit,
 len(list_filter(others, lambda e: e['path'] <> path AND NOT list_contains(names, e['path']) AND len(list_intersect(e['vals'], gv)) > 0)) > 0 AS semantic_hit FROM m1),
mx AS MATERIALIZED (SELECT id, split, source_id, task_type, route, path AS slot_path, arm, has_gold, has_pred, gold_support, provenance, CASE WHEN NOT has_gold AND NOT has_pred THEN 'SLOT_CORRECT_ABSENT' WHEN NOT has_gold THEN 'EXTRA_SLOT_KEY'
 WHEN NOT has_pred AND alias_hit THEN 'WRONG_SLOT_KEY_ALIAS' WHEN NOT has_pred AND semantic_hit THEN 'WRONG_SLOT_KEY_SEMANTIC' WHEN NOT has_pred THEN 'MISSING_SLOT_KEY' WHEN g_kind = p_kind AND g_text = p_text THEN 'SLOT_CORRECT_EXACT'
 WHEN len(list_intersect(gv, pv)) > 0 THEN 'SLOT_CORRECT_NORMALIZED' WHEN g_kind <> p_kind THEN 'TYPE_MISMATCH' WHEN {" OR ".join(differs(r) for r in ("boolean_canonical", "phone_digits", "number_canonical", "date_iso", "url_canonical"))} THEN 'NORMALIZATION_FAILURE'
 WHEN trim(p_text) = '' THEN 'UNCLASSIFIED_SLOT_FAILURE' WHEN {_OVERLAPS} THEN 'PARTIAL_VALUE_SPAN' WHEN task_type = 'clarify' OR starts_with(path, 'ambiguity') THEN 'CLARIFY_AMBIGUITY_REPRESENTATION_FAILURE'
 WHEN gold_support = 'source_absent_or_generation_required' THEN 'UNSUPPORTED_OR_HALLUCINATED_VALUE' WHEN provenance = 'unsupported_by_source' THEN 'SOURCE_COPY_FAILURE' WHEN gold_support = 'typed_derivable' THEN 'DERIVED_VALUE_FAILURE'
 ELSE 'WRONG_ENTITY_OR_VALUE' END AS mechanism FROM m2)"""

MOVES = (
    MECHANISMS
    + """,
mo AS MATERIALIZED (SELECT c.id, c.split, c.task_type, c.route, c.slot_path, c.mechanism AS cm, t.mechanism AS tm, starts_with(c.mechanism, 'SLOT_CORRECT') AS co, starts_with(t.mechanism, 'SLOT_CORRECT') AS tr,
 CASE WHEN co AND tr THEN 'CORRECT_IN_BOTH' WHEN tr AND cm = 'MISSING_SLOT_KEY' THEN 'SLOT_ADDED_CORRECTLY' WHEN tr AND cm = 'EXTRA_SLOT_KEY' THEN 'SLOT_REMOVED_CORRECTLY' WHEN tr THEN 'RECOVERED_BY_TREATMENT'
 WHEN co AND tm = 'MISSING_SLOT_KEY' THEN 'SLOT_REMOVED_INCORRECTLY' WHEN co AND tm = 'EXTRA_SLOT_KEY' THEN 'SLOT_ADDED_INCORRECTLY' WHEN co THEN 'INTRODUCED_BY_TREATMENT' WHEN cm = tm THEN 'ERROR_IN_BOTH_SAME_MECHANISM'
 ELSE 'ERROR_IN_BOTH_DIFFERENT_MECHANISM' END AS movement FROM mx c JOIN mx t ON c.id = t.id AND c.slot_path = t.slot_path AND c.arm = 'control' AND t.arm = 'treatment')"""
)

_N = "CAST(count(*) FILTER (WHERE {}) AS BIGINT)".format
PROFILES = (
    MOVES
    + f""",
pa AS (SELECT slot_path, {_N("has_gold AND arm = 'control'")} AS gold_events, {_N("has_pred")} AS prediction_events, {_N("has_gold AND arm = 'control' AND gold_support IN ('exact_source_supported', 'normalized_source_supported')")} AS copyable,
 {_N("has_gold AND arm = 'control' AND gold_support = 'typed_derivable'")} AS typed, {_N("mechanism = 'MISSING_SLOT_KEY'")} AS missing, {_N("mechanism = 'EXTRA_SLOT_KEY'")} AS extra, {_N("mechanism = 'WRONG_ENTITY_OR_VALUE'")} AS wrong_entity,
 {_N("mechanism = 'PARTIAL_VALUE_SPAN'")} AS partial, {_N("provenance = 'unsupported_by_source'")} AS unsupported FROM mx GROUP BY slot_path),
pb AS (SELECT slot_path, count(*) AS sample_count, {_N("movement = 'ERROR_IN_BOTH_SAME_MECHANISM'")} AS persistent, {_N("movement IN ('RECOVERED_BY_TREATMENT', 'SLOT_ADDED_CORRECTLY')")} AS recovered,
 {_N("movement IN ('INTRODUCED_BY_TREATMENT', 'SLOT_ADDED_INCORRECTLY', 'SLOT_REMOVED_INCORRECTLY')")} AS regressed FROM mo GROUP BY slot_path),
pr_ AS (SELECT *, coalesce(copyable / nullif(gold_events, 0)::DOUBLE, 0) AS copyable_rate, coalesce(typed / nullif(gold_events, 0)::DOUBLE, 0) AS typed_rate, missing / greatest(1, gold_events * 2)::DOUBLE AS missing_rate,
 extra / greatest(1, sample_count * 2)::DOUBLE AS extra_rate, wrong_entity / greatest(1, gold_events * 2)::DOUBLE AS wrong_entity_rate, partial / greatest(1, gold_events * 2)::DOUBLE AS partial_rate,
 coalesce(unsupported / nullif(prediction_events, 0)::DOUBLE, 0) AS unsupported_rate, coalesce(recovered / nullif(sample_count, 0)::DOUBLE, 0) AS recovery_rate, coalesce(regressed / nullif(sample_count, 0)::DOUBLE, 0) AS regression_rate FROM pa JOIN pb USING (slot_path)),
pf AS (SELECT *, CASE WHEN missing_rate + extra_rate >= 0.12 THEN 'task_slot_schema_constraints' WHEN typed_rate >= 0.20 THEN 'typed_normalization' WHEN copyable_rate >= 0.75 AND partial_rate + unsupported_rate < 0.25 THEN 'copy_or_normalize'
 ELSE 'mixed_slot_value_representation' END AS representation, CASE WHEN sample_count >= 60 AND persistent >= 5 THEN 'HIGH' WHEN sample_count >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM pr_)"""
)
