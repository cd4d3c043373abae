"""Shared SQL fragments (DuckDB dialect) that re-derive the row-level evaluation frame.

They are written from the published semantics with DuckDB's own JSON functions and share
nothing with the Spark side except the derivation of the input tables.
"""

from __future__ import annotations

from pactlane.plans.inputs import sql_prelude

FIELDS = (
    "['confirmation_required','contract_version','language','normalized_command','route','safety','slots','task_type']"
)


ROWS = (
    sql_prelude()
    + """,
arms AS (SELECT unnest(['control','treatment']) AS arm),
al AS (
  SELECT a.arm, g.*, p.raw,
         CASE WHEN p.raw IS NOT NULL AND json_valid(p.raw) AND json_type(p.raw) = 'OBJECT' THEN p.raw END AS j
  FROM gold_rows g CROSS JOIN arms a LEFT JOIN predictions p ON p.arm = a.arm AND p.id = g.id
),
px AS (
  SELECT *, j IS NOT NULL AS json_ok,
    coalesce(json_keys(j), []) AS keys,
    json_type(j, '$.task_type') AS t_tt, json_type(j, '$.route') AS t_rt, json_type(j, '$.safety') AS t_sf,
    json_type(j, '$.safety.allow') AS t_al, json_type(j, '$.safety.reason') AS t_re,
    json_type(j, '$.confirmation_required') AS t_cf, json_type(j, '$.slots') AS t_sl,
    json_type(j, '$.normalized_command') AS t_cm, json_type(j, '$.language') AS t_la,
    json_type(j, '$.contract_version') AS t_ve,
    json_extract_string(j, '$.task_type') AS p_tt, json_extract_string(j, '$.route') AS p_rt,
    json_extract_string(j, '$.safety.allow') AS p_al, json_extract_string(j, '$.safety.reason') AS p_re,
    json_extract_string(j, '$.confirmation_required') AS p_cf, json_extract(j, '$.slots')::VARCHAR AS p_sl,
    json_extract_string(j, '$.normalized_command') AS p_cm, json_extract_string(j, '$.language') AS p_la,
    json_extract_string(j, '$.contract_version') AS p_ve,
    coalesce(json_keys(j, '$.safety'), []) AS sf_keys,
    json_extract_string(gold, '$.task_type') AS g_tt, json_extract_string(gold, '$.route') AS g_rt,
    json_extract_string(gold, '$.safety.allow') AS g_al, json_extract_string(gold, '$.safety.reason') AS g_re,
    json_extract_string(gold, '$.confirmation_required') AS g_cf, json_extract(gold, '$.slots')::VARCHAR AS g_sl,
    json_extract_string(gold, '$.normalized_command') AS g_cm, json_extract_string(gold, '$.language') AS g_la,
    json_extract_string(gold, '$.contract_version') AS g_ve
  FROM al
),
py AS (
  SELECT *,
    list_sort(list_filter("""
    + FIELDS
    + """, lambda x: NOT list_contains(keys, x))) AS missing,
    list_sort(list_filter(keys, lambda x: NOT list_contains("""
    + FIELDS
    + """, x))) AS extra
  FROM px
),
pz AS (
  SELECT *,
    coalesce(json_ok AND len(missing) = 0 AND len(extra) = 0
      AND t_tt = 'VARCHAR' AND p_tt IN ('search','navigate','form_fill','extract','clarify','blocked')
      AND t_rt = 'VARCHAR' AND p_rt IN ('search_web','open_url','fill_form','extract_page','clarify','deny')
      AND t_sf = 'OBJECT' AND list_sort(sf_keys) = ['allow','reason'] AND t_al = 'BOOLEAN'
      AND t_re = 'VARCHAR' AND trim(p_re) <> '' AND t_cf = 'BOOLEAN' AND t_sl = 'OBJECT'
      AND t_cm = 'VARCHAR' AND trim(p_cm) <> '' AND t_la = 'VARCHAR' AND p_la = 'zh-CN'
      AND t_ve = 'VARCHAR' AND p_ve = 'v1', false) AS ok,
    list_transform(json_keys(g_sl), lambda k: k || chr(1) || CASE json_type(g_sl, '$."' || k || '"')
      WHEN 'BOOLEAN' THEN CASE json_extract_string(g_sl, '$."' || k || '"') WHEN 'true' THEN 'True' ELSE 'False' END
      ELSE json_extract_string(g_sl, '$."' || k || '"') END) AS g_items,
    CASE WHEN t_sl = 'OBJECT' THEN list_transform(json_keys(p_sl), lambda k: k || chr(1) || CASE json_type(p_sl, '$."' || k || '"')
      WHEN 'BOOLEAN' THEN CASE json_extract_string(p_sl, '$."' || k || '"') WHEN 'true' THEN 'True' ELSE 'False' END
      ELSE json_extract_string(p_sl, '$."' || k || '"') END) ELSE [] END AS p_items
  FROM py
),
rules AS (
  SELECT * FROM (VALUES ('search','search_web','true','public_readonly','false','query'),
    ('navigate','open_url','true','public_readonly','false','url'),
    ('form_fill','fill_form','true','requires_confirmation','true','field'),
    ('extract','extract_page','true','public_readonly','false','target'),
    ('clarify','clarify','true','ambiguous_request','true','ambiguity'),
    ('blocked','deny','false','unsafe_payment',NULL,'reason')) t(r_tt, r_rt, r_al, r_re, r_cf, r_slot)
),
sem AS (
  SELECT pz.*, r.*,
    ok AND p_rt = r_rt AND p_al = r_al AND p_re = r_re AND (r_cf IS NULL OR p_cf = r_cf)
      AND list_contains(json_keys(p_sl), r_slot) AS sem_ok,
    ok AND p_tt = g_tt AND p_rt = g_rt AND p_al = g_al AND p_re = g_re AND p_cf = g_cf AND p_sl = g_sl
      AND p_cm = g_cm AND p_la = g_la AND p_ve = g_ve AS same_ok,
    len(list_intersect(g_items, p_items)) AS tp_items
  FROM pz LEFT JOIN rules r ON ok AND r.r_tt = pz.p_tt
),
rows_ AS (
  SELECT *, coalesce(sem_ok, false) AS semantic_ok, coalesce(same_ok, false) AS same,
    coalesce(sem_ok AND same_ok, false) AS exact_ok,
    coalesce(ok AND p_tt = g_tt, false) AS task_ok, coalesce(ok AND p_rt = g_rt, false) AS route_ok,
    coalesce(ok AND p_cf = g_cf, false) AS confirm_ok, coalesce(ok AND p_al = g_al, false) AS risk_ok,
    coalesce(ok AND p_sl = g_sl, false) AS slots_ok,
    coalesce(ok AND p_al = 'false' AND g_al = 'false', false) AS s_tp,
    coalesce(ok AND p_al = 'false' AND g_al = 'true', false) AS s_fp,
    coalesce(ok AND p_al = 'true' AND g_al = 'false', false) AS s_fn,
    coalesce(ok AND p_al = 'true' AND g_al = 'true', false) AS s_tn,
    CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN len(g_items) = 0 AND len(p_items) = 0 THEN 1.0::DOUBLE
      WHEN len(g_items) = 0 OR len(p_items) = 0 OR tp_items = 0 THEN 0.0::DOUBLE
      ELSE 2.0::DOUBLE * tp_items / (len(p_items) + len(g_items)) END AS f1
  FROM sem
),
pairs AS (
  SELECT arm, id, k, CASE json_type(g_sl, '$."' || k || '"') WHEN 'BOOLEAN' THEN 'True' ELSE json_extract_string(g_sl, '$."' || k || '"') END AS gv,
    CASE json_type(p_sl, '$."' || k || '"') WHEN 'BOOLEAN' THEN 'True' ELSE json_extract_string(p_sl, '$."' || k || '"') END AS pv
  FROM (SELECT arm, id, g_sl, p_sl, unnest(list_intersect(json_keys(g_sl), json_keys(p_sl))) AS k FROM rows_ WHERE ok)
),
sim AS (
  SELECT arm, id, sum(CASE WHEN c >= 0.7 THEN 1.0::DOUBLE WHEN c >= 0.5 THEN c ELSE 0.0::DOUBLE END) AS matched FROM (
    SELECT arm, id, CASE WHEN gv = pv THEN 1.0::DOUBLE WHEN gv = '' OR pv = '' THEN 0.0::DOUBLE ELSE
      2.0::DOUBLE * list_sum(list_transform(list_distinct(string_split(gv, '')),
        lambda ch: least(length(gv) - length(replace(gv, ch, '')), length(pv) - length(replace(pv, ch, ''))))) / (length(gv) + length(pv)) END AS c
    FROM pairs) GROUP BY arm, id
),
scored AS (
  SELECT r.*, CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN len(g_items) = 0 AND len(p_items) = 0 THEN 1.0::DOUBLE
    WHEN len(g_items) = 0 OR len(p_items) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * coalesce(matched, 0.0) / (len(p_items) + len(g_items)) END AS soft
  FROM rows_ r LEFT JOIN sim USING (arm, id)
)"""
)
ROWS = ROWS.replace("rows_", "flagged")


def with_rows(select: str, extra: str = "") -> str:
    """WITH clause holding the scored frame, more CTEs, then the final select."""
    return f"WITH {ROWS}{',' + extra if extra else ''}\n{select}"


def n(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


LAYER = """
gi AS (SELECT arm, split, id, ok, unnest(json_keys(g_sl)) AS k, g_sl FROM scored),
pi AS (SELECT arm, split, id, ok, unnest(json_keys(p_sl)) AS k, p_sl FROM scored WHERE ok),
gn AS (SELECT arm, split, id, k, CASE json_type(g_sl, '$."' || k || '"') WHEN 'BOOLEAN' THEN 'True' ELSE json_extract_string(g_sl, '$."' || k || '"') END AS v FROM gi),
pn AS (SELECT arm, split, id, k, CASE json_type(p_sl, '$."' || k || '"') WHEN 'BOOLEAN' THEN 'True' ELSE json_extract_string(p_sl, '$."' || k || '"') END AS v FROM pi),
norm AS (
  SELECT side, arm, split, id, k AS rk, v AS rv,
    CASE WHEN nk IN ('keyword','keywords','searchterm','searchterms','q') THEN 'query' ELSE nk END AS k,
    list_aggregate(list_transform(list_filter(string_split_regex(trim(lower(v)), '[\\s\\-_.,!?:;，。！？：；、（）()\\[\\]{}"''`]+'), lambda t: t <> ''),
      lambda t: CASE WHEN t IN ('open','navigate','go','visit') THEN '打开' WHEN t IN ('search','query','find') THEN '搜索' ELSE t END), 'string_agg', '') AS v
  FROM (SELECT *, regexp_replace(trim(lower(k)), '[\\s\\-_.,!?:;，。！？：；、（）()\\[\\]{}"''`]+', '', 'g') AS nk
        FROM (SELECT 'g' AS side, * FROM gn UNION ALL SELECT 'p', * FROM pn))
),
items AS (
  SELECT DISTINCT side, arm, split, id, 'key' AS kind, k AS item FROM norm
  UNION ALL SELECT DISTINCT side, arm, split, id, 'exact', rk || chr(1) || rv FROM norm
  UNION ALL SELECT DISTINCT side, arm, split, id, 'normalized', k || chr(1) || coalesce(v, '') FROM norm
),
per_item AS (SELECT arm, split, kind, item, count(*) FILTER (WHERE side = 'g') AS g, count(*) FILTER (WHERE side = 'p') AS p FROM items GROUP BY ALL),
micro AS (SELECT arm, split, kind, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(g) AS BIGINT) AS gold_total, CAST(sum(p) AS BIGINT) AS predicted_total
  FROM per_item GROUP BY ALL),
micro_f AS (SELECT *, CASE WHEN predicted_total = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / predicted_total END AS pr,
  CASE WHEN gold_total = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / gold_total END AS rc FROM micro),
covered AS (
  SELECT arm, id, bool_and(coalesce(v = pv, false)) AS cov FROM (
    SELECT g.arm, g.id, g.k, g.v, p.v AS pv FROM (SELECT * FROM norm WHERE side = 'g') g
    LEFT JOIN (SELECT * FROM norm WHERE side = 'p') p ON g.arm = p.arm AND g.id = p.id AND g.k = p.k) GROUP BY ALL
),
layered AS (
  SELECT s.*, coalesce(c.cov, true) AS cov, (g_al = 'false' OR g_cf = 'true') AS g_unsafe, (p_al = 'false' OR p_cf = 'true') AS p_stop,
    (g_tt IN ('clarify','blocked') OR g_rt IN ('clarify','deny') OR p_tt IN ('clarify','blocked') OR p_rt IN ('clarify','deny')) AS relevant
  FROM scored s LEFT JOIN covered c USING (arm, id)
),
lay AS (SELECT *, coalesce(ok AND task_ok AND route_ok AND confirm_ok AND risk_ok, false) AS core_same FROM layered),
lay2 AS (SELECT *, core_same AND NOT (g_unsafe AND NOT p_stop) AND cov AS exec_ok FROM lay)"""
