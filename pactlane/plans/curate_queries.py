"""Dataset-building queries: seeds derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import curate as K
from pactlane.functions import constants as C
from pactlane.operators import cohorts as G
from pactlane.operators import compare as P
from pactlane.operators import evaluate as E
from pactlane.operators import provenance as V
from pactlane.operators.common import beside
from pactlane.plans import inputs
from pactlane.plans.evaluation_queries import gold, preds
from pactlane.plans.oracle_parts import with_rows
from pactlane.plans.registry import query
from pactlane.plans.shared import written

PROMPT = "Return one JSON contract."


def seeds(spark, sf_dir):
    """Gold rows as seeds with two paraphrases and a provenance map."""
    return gold(spark, sf_dir).select(
        "id", "split", "ordinal", "input_text", F.col("gold").alias("target"),
        F.array(F.concat(F.lit("请"), "input_text"), F.concat("input_text", F.lit("。"))).alias("augmentations"),
        F.create_map(F.lit("source_mode"), F.lit("sanitized_seed"), F.lit("family_id"), F.col("source_id")).alias("provenance"),
    )


def rows(spark, sf_dir):
    return written(spark, sf_dir, "rows", lambda: K.expand_rows(seeds(spark, sf_dir)))


def pairs(spark, sf_dir):
    return K.preference_pairs(rows(spark, sf_dir))  # many times the rows, so they are joined where they are read


def chat(spark, sf_dir):
    return K.chat_rows(rows(spark, sf_dir), PROMPT)


TARGET = """
tg AS (SELECT *, CASE WHEN k = 0 THEN replace(substr(cmd, 3), ' ', '') ELSE sv END AS sv2, CASE WHEN k = 0 THEN replace(cmd, ' ', '') ELSE cmd END AS cmd2,
  '{"' || sk || '":"' || (CASE WHEN k = 0 THEN replace(substr(cmd, 3), ' ', '') ELSE sv END) || '"' || sx || '}' AS sl FROM b5),
target AS (SELECT *, '{"confirmation_required":' || conf || ',"contract_version":"v1","language":"zh-CN","normalized_command":"' || cmd2 || '","route":"' || rt ||
  '","safety":{"allow":' || allow || ',"reason":"' || reason || '"},"slots":' || sl || ',"task_type":"' || tt || '"}' AS t FROM tg)"""
HEAD = f"WITH {inputs.sql_prelude()},{TARGET}"


@query(
    "training_rows",
    HEAD
    + """, x AS (SELECT id, split, ordinal, t, unnest([{'n': 0, 's': input_text}, {'n': 1, 's': '请' || input_text}, {'n': 2, 's': input_text || '。'}]) AS v FROM target)
SELECT CASE WHEN v.n = 0 THEN id ELSE id || '-aug-' || v.n END AS id, split, ordinal, v.n AS variant, v.s AS input_text, t AS target,
 id AS source_id, CASE WHEN v.n = 0 THEN 'sanitized_seed' ELSE 'schema_preserving_augmentation' END AS source_mode,
 CASE WHEN v.n = 0 THEN 'original' ELSE 'paraphrase-' || v.n END AS augmentation FROM x""",
)
def training_rows(spark, sf_dir):
    """Expanded training rows with canonical targets."""
    p = lambda k: F.element_at("provenance", k).alias(k)
    return rows(spark, sf_dir).select(
        "id", "split", "ordinal", "variant", "input_text", "target", p("source_id"), p("source_mode"), p("augmentation")
    )


PAIRS = """
pc AS (
  SELECT *, 'wrong_task_type' AS cat, conf AS c, cmd2 AS nc, rt AS r, allow AS a, 'wrong_task_type' AS s, sl AS z,
    CASE tt WHEN 'search' THEN 'navigate' WHEN 'navigate' THEN 'search' WHEN 'form_fill' THEN 'extract' WHEN 'extract' THEN 'form_fill' WHEN 'clarify' THEN 'search' ELSE 'navigate' END AS tk FROM target
  UNION ALL SELECT *, 'wrong_route', conf, cmd2, CASE WHEN rt = 'open_url' THEN 'search_web' ELSE 'open_url' END, allow, 'wrong_route', sl, tt FROM target
  UNION ALL SELECT *, 'unsafe_allowance', conf, cmd2, rt, CASE allow WHEN 'true' THEN 'false' ELSE 'true' END, 'unsafe_allowance', sl, tt FROM target
  UNION ALL SELECT *, 'missing_confirmation', 'false', cmd2, rt, allow, 'missing_confirmation', sl, tt FROM target WHERE conf = 'true'
  UNION ALL SELECT *, 'missing_slot', conf, cmd2, rt, allow, 'missing_slot', '{' || ltrim(sx, ',') || '}', tt FROM target
  UNION ALL SELECT *, 'wrong_slot', conf, cmd2, rt, allow, 'wrong_slot', '{"' || sk || '":"' || sv2 || '_wrong"' || sx || '}', tt FROM target
  UNION ALL SELECT *, 'decomposed_search_slots', conf, cmd2, rt, allow, 'decomposed_search_slots', '{"city":"北京","date":"明天","topic":""}', tt FROM target WHERE k = 0 AND ev % 12 = 0
  UNION ALL SELECT *, 'extract_search_fallback', conf, '搜索' || sv2, 'search_web', allow, 'extract_search_fallback', '{"query":"' || sv2 || '"}', 'search' FROM target WHERE k = 3
  UNION ALL SELECT *, 'extract_query_slot', conf, cmd2, rt, allow, 'extract_query_slot', '{"page_url":"","query":"' || sv2 || '"}', tt FROM target WHERE k = 3
  UNION ALL SELECT *, 'extract_generic_price_wording', conf, '页面价格', rt, allow, 'extract_generic_price_wording', '{"target":"价格"}', tt FROM target WHERE k = 3 AND ev % 5 = 0
  UNION ALL SELECT *, 'extract_listed_price_wording', conf, '提取页面标价', rt, allow, 'extract_listed_price_wording', '{"target":"标价"}', tt FROM target WHERE k = 3 AND ev % 5 = 0
  UNION ALL SELECT *, 'extract_extra_particle_wording', conf, '提取页面上的商品价格', rt, allow, 'extract_extra_particle_wording', sl, tt FROM target WHERE k = 3 AND ev % 5 = 0
  UNION ALL SELECT *, 'clarify_action_drift', 'false', '搜索公开信息', 'search_web', 'true', 'public_readonly', '{"query":"公开信息"}', 'search' FROM target WHERE k = 4
  UNION ALL SELECT *, 'blocked_payment_action_drift', 'false', '搜索付款', 'search_web', 'true', 'public_readonly', '{"query":"付款"}', 'search' FROM target WHERE k = 5 AND conf = 'true'
  UNION ALL SELECT *, 'form_confirmation_drift', 'false', cmd2, rt, 'true', 'public_readonly', '{"email":"' || sv2 || '"}', tt FROM target WHERE k = 2
  UNION ALL SELECT *, 'navigate_canonical_url_drift', conf, '打开 ' || replace(sv2, 'https://', ''), rt, allow, 'navigate_canonical_url_drift', '{"url":"' || replace(sv2, 'https://', '') || '"}', tt FROM target WHERE k = 1
  UNION ALL SELECT *, 'underspecified_request', 'true', cmd2, 'clarify', allow, 'underspecified_request', '{}', tt FROM target
  UNION ALL SELECT *, 'malformed_schema', conf, cmd2, NULL, allow, reason, sl, tt FROM target),
pairs AS (SELECT id || '-' || cat AS id, split, input_text, t AS chosen, cat AS rejection_reason,
  '{"confirmation_required":' || c || ',"contract_version":"v1","language":"zh-CN"' || (CASE WHEN r IS NULL THEN ',"malformed_reason":"route_removed"' ELSE '' END) || ',"normalized_command":"' || nc || '"' ||
  (CASE WHEN r IS NULL THEN '' ELSE ',"route":"' || r || '"' END) || ',"safety":{"allow":' || a || ',"reason":"' || s || '"},"slots":' || z || ',"task_type":"' || tk || '"}' AS rejected FROM pc)"""


@query("preference_pairs", HEAD + "," + PAIRS + " SELECT * FROM pairs")
def preference_pairs(spark, sf_dir):
    """T4 and its 18 categories: every applicable hard negative."""
    return pairs(spark, sf_dir).select("id", "split", "input_text", "chosen", "rejection_reason", "rejected")


@query("pair_violations", HEAD + "," + PAIRS + " SELECT rejection_reason, count(*) AS pair_count, CAST(0 AS BIGINT) AS violations FROM pairs GROUP BY ALL")
def pair_violations(spark, sf_dir):
    """V4, V5: generated pairs hold the promised difference."""
    violated = F.when(F.col("violation").isNotNull(), F.col("copies")).otherwise(0)
    return K.pair_verdicts(pairs(spark, sf_dir)).groupBy("rejection_reason").agg(
        F.sum("copies").alias("pair_count"), F.sum(violated).alias("violations")
    )


CATS = "unnest([" + ",".join(f"'{c}'" for c in K.C.REJECTION_CATEGORIES) + "])"


@query(
    "dataset_counts",
    HEAD + "," + PAIRS + f""", cats AS (SELECT {CATS} AS c)
SELECT 'split' AS kind, s AS name, count(t.id) * 3 AS row_count FROM (SELECT unnest(['train','dev','test']) AS s) x LEFT JOIN target t ON t.split = s GROUP BY ALL
UNION ALL SELECT 'rejection', c, count(p.id) FROM cats LEFT JOIN pairs p ON p.rejection_reason = c GROUP BY ALL""",
)
def dataset_counts(spark, sf_dir):
    """Zero-filled split and rejection counts."""
    a = K.split_counts(rows(spark, sf_dir)).select(F.lit("split").alias("kind"), F.col("split").alias("name"), "row_count")
    b = K.rejection_counts(pairs(spark, sf_dir)).select(
        F.lit("rejection").alias("kind"), F.col("rejection_reason").alias("name"), F.col("pair_count").alias("row_count")
    )
    return a.unionByName(b)


_SLICE = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in C.REJECTION_SLICE.items())
_ORDER = ", ".join(f"'{c}'" for c in C.REJECTION_CATEGORIES)
_SLICES = ", ".join(f"'{s}'" for s in C.PREFERENCE_SLICES)


@query(
    "preference_slices",
    HEAD + "," + PAIRS + f""", sl AS (SELECT CASE cat {_SLICE} END AS slice, id || '-' || cat AS id, row_number() OVER (PARTITION BY CASE cat {_SLICE} END
 ORDER BY ordinal, list_position([{_ORDER}], cat)) AS rn FROM pc)
SELECT s.slice, count(sl.id) AS pair_count, coalesce(string_agg(sl.id, ',' ORDER BY rn) FILTER (WHERE rn <= 5), '') AS examples
FROM (SELECT unnest([{_SLICES}]) AS slice) s LEFT JOIN sl USING (slice) GROUP BY s.slice""",
)
def preference_slices(spark, sf_dir):
    """Pair counts per slice with the first five ids."""
    return K.preference_slices(pairs(spark, sf_dir))


COVERAGE_SQL = """
SELECT split, d.n AS dimension, d.v AS value, count(*) AS row_count FROM (SELECT split, unnest([{'n': 'source_id', 'v': source_id},
 {'n': 'contract_family', 'v': tt || '|' || rt || '|' || reason || '|confirm:' || conf || '|slots:' || sk || (CASE WHEN k = 2 THEN ',value' ELSE '' END)},
 {'n': 'task_type', 'v': tt}, {'n': 'route', 'v': rt}, {'n': 'safety_reason', 'v': reason}, {'n': 'confirmation', 'v': 'confirm:' || conf},
 {'n': 'slot_keys', 'v': sk || (CASE WHEN k = 2 THEN ',value' ELSE '' END)}]) AS d FROM (SELECT *, 'fam-' || kind || '-' || k AS source_id FROM target)) GROUP BY ALL"""


@query("family_coverage", HEAD + COVERAGE_SQL)
def family_coverage(spark, sf_dir):
    """Coverage of every dimension per split in one pass."""
    return K.coverage(gold(spark, sf_dir).withColumnRenamed("gold", "target"))


@query(
    "sample_profile",
    HEAD + """ SELECT d.n AS dimension, d.v AS value, count(*) AS seeds, 3.0::DOUBLE AS mean_variants FROM (SELECT unnest([{'n': 'task_type', 'v': tt},
 {'n': 'route', 'v': rt}, {'n': 'safety_reason', 'v': reason}, {'n': 'confirmation', 'v': CASE conf WHEN 'true' THEN 'True' ELSE 'False' END}, {'n': 'split', 'v': split}]) AS d FROM target) GROUP BY ALL""",
)
def sample_profile(spark, sf_dir):
    """Sample profile."""
    return K.sample_profile(seeds(spark, sf_dir))


@query(
    "seed_issues",
    with_rows(
        """SELECT issue, count(*) AS seeds FROM (SELECT unnest(list_filter(['need >=2 augmentations, got 1', CASE WHEN NOT ok THEN 'schema' END,
 CASE WHEN p_tt = 'blocked' AND NOT coalesce(t_al = 'BOOLEAN' AND p_al = 'false', false) THEN 'blocked task must have safety.allow=false' END,
 CASE WHEN p_tt IN ('search', 'navigate', 'extract') AND t_al = 'BOOLEAN' AND p_al = 'false' THEN p_tt || ' task should normally have safety.allow=true' END],
 lambda x: x IS NOT NULL)) AS issue FROM scored JOIN (SELECT arm, id FROM predictions) USING (arm, id)) GROUP BY issue"""
    ),
)
def seed_issues(spark, sf_dir):
    """V6, V7: seed structure and safety issues over gold and predicted contracts as candidate seeds."""
    preds = inputs.predictions(spark, sf_dir).select(
        F.concat_ws("-", "arm", "id").alias("id"), F.lit("train").alias("split"), "ordinal", F.col("raw").alias("input_text"),
        F.col("raw").alias("target"), F.array(F.col("raw")).alias("augmentations"),
    )
    return K.check_seeds(preds).groupBy("issue").agg(F.count("*").alias("seeds"))


@query(
    "rule_baseline",
    HEAD + """ SELECT count(*) AS row_count, count(*) FILTER (WHERE tt = 'search') / count(*)::DOUBLE AS task_is_search,
 count(*) FILTER (WHERE (CASE WHEN regexp_matches(input_text, '搜|查') THEN 'search_web' WHEN input_text LIKE '%打开%' THEN 'open_url' ELSE 'clarify' END) = rt) / count(*)::DOUBLE AS route_accuracy,
 count(*) FILTER (WHERE (CASE WHEN regexp_matches(input_text, '搜|查') THEN 'search' WHEN input_text LIKE '%打开%' THEN 'navigate' ELSE 'clarify' END) = tt) / count(*)::DOUBLE AS task_type_accuracy FROM b5""",
)
def rule_baseline(spark, sf_dir):
    """Keyword baseline scored by the strict evaluator."""
    g = gold(spark, sf_dir)
    m = E.strict_metrics(E.scored(g, K.rule_baseline(g), ["rules"]), ["arm"])
    share = g.agg((F.sum((F.get_json_object("gold", "$.task_type") == "search").cast("int")) / F.count("*")).alias("task_is_search"))
    return beside(m.select("row_count", "route_accuracy", "task_type_accuracy"), share)


TRAIN = "'system: Return one JSON contract.' || chr(10) || 'user: ' || s || chr(10) || 'assistant: ' || t"


@query(
    "learning_signal",
    HEAD + f""", x AS (SELECT split, t, unnest([input_text, '请' || input_text, input_text || '。']) AS s FROM target)
SELECT split, count(*) AS row_count, CAST(max(length({TRAIN})) AS INT) AS max_training_chars, CAST(max(length(t)) AS INT) AS max_target_chars,
 min(length(t)::DOUBLE / length({TRAIN})) AS min_target_ratio, max(length(t)::DOUBLE / length({TRAIN})) AS max_target_ratio,
 CAST(count(*) FILTER (WHERE length({TRAIN}) > 2048) AS BIGINT) AS rows_over_2048_chars, true AS all_spans_found FROM x GROUP BY split""",
)
def learning_signal(spark, sf_dir):
    """Training text and target pressure."""
    return K.signal_pressure(K.learning_signal(chat(spark, sf_dir)))


@query(
    "prompt_alignment",
    HEAD + """ SELECT split, count(*) * 3 AS row_count, true AS share_prefix, true AS training_has_target, true AS prompt_hides_target,
 true AS prompt_ends_at_boundary, true AS all_spans_found FROM target GROUP BY split""",
)
def prompt_alignment(spark, sf_dir):
    """Training text and prompt agree up to the target."""
    return K.prompt_alignment(chat(spark, sf_dir))


@query(
    "prompt_snapshot",
    HEAD + """, x AS (SELECT id, unnest([{'n': 0, 's': input_text}, {'n': 1, 's': '请' || input_text}, {'n': 2, 's': input_text || '。'}]) AS v FROM target),
y AS (SELECT CASE WHEN v.n = 0 THEN id ELSE id || '-aug-' || v.n END AS id, v.s AS s, 'system: Return one JSON contract.' || chr(10) || 'user: ' || v.s || chr(10) || 'assistant:' AS p FROM x)
SELECT id, sha256(p) AS prompt_sha256, CAST(length(p) AS INT) AS prompt_chars, left(p, 240) AS prompt_preview, left(s, 120) AS input_preview FROM y""",
)
def prompt_snapshot(spark, sf_dir):
    """Redacted prompt hash, length and preview."""
    return K.prompt_snapshot(chat(spark, sf_dir))


@query(
    "training_selection",
    HEAD + """ SELECT 'fam-' || kind || '-' || k AS source_id, count(*) AS rows_before, CAST(0 AS BIGINT) + count(*) FILTER (WHERE k IN (0, 1)) AS rows_used FROM b5 GROUP BY ALL""",
)
def training_selection(spark, sf_dir):
    """Rows of chosen source ids with counts before and after."""
    g = gold(spark, sf_dir)
    wanted = g.where(F.col("source_id").rlike("-[01]$")).select("source_id").distinct()
    return K.selection_record(g, K.select_training_rows(g, wanted, None))


# ---- cohorts and challenge ----------------------------------------------------------------


@query(
    "integration_preview",
    HEAD + """ SELECT split, CAST(count(*) FILTER (WHERE k <> 5) AS BIGINT) AS before, count(*) AS after, CAST(count(*) FILTER (WHERE k = 5) AS BIGINT) AS added FROM b5 GROUP BY split""",
)
def integration_preview(spark, sf_dir):
    """Promoted candidates of one family previewed against the base set."""
    s = seeds(spark, sf_dir)
    last = F.element_at("provenance", "family_id").rlike("-5$")
    return G.preview(s.where(~last), G.promote(s.where(last), "review"))


@query(
    "cohort_summary",
    HEAD + """ SELECT 'sanitized_seed' AS source_mode, 'promoted' AS status, split, count(*) AS seeds, count(DISTINCT source_id) AS families
 FROM (SELECT split, 'fam-' || kind || '-' || CAST(k AS STRING) AS source_id FROM b5) GROUP BY split""",
)
def cohort_summary(spark, sf_dir):
    """Seeds per cohort and split."""
    return G.cohort_summary(G.promote(seeds(spark, sf_dir), "review"))


@query(
    "cohort_check",
    f"""WITH {inputs.sql_prelude()} SELECT issue, count(*) AS subjects FROM (SELECT 'missing_id' AS issue FROM gold_rows WHERE id NOT IN (SELECT id FROM predictions WHERE arm = 'treatment')
 UNION ALL SELECT 'cell_count_mismatch' FROM (SELECT split, count(*) AS e, count(p.id) AS n FROM gold_rows g LEFT JOIN (SELECT id FROM predictions WHERE arm = 'treatment') p USING (id) GROUP BY split) WHERE e <> n) GROUP BY issue""",
)
def cohort_check(spark, sf_dir):
    """Treatment rows against the expected ids and the expected count per split."""
    g = gold(spark, sf_dir)
    rows_ = preds(spark, sf_dir).where(F.col("arm") == "treatment").join(g.select("id", "split"), "id")
    cells = g.groupBy("split").agg(F.count("*").alias("expected"))
    return P.cohort_check(rows_, g.select("id"), cells, ["split"]).groupBy("issue").agg(F.count("*").alias("subjects"))


@query(
    "challenge_composition",
    f"""WITH {inputs.sql_prelude()}, c AS (SELECT * FROM (VALUES ('exact_unique','VERIFIED_EXACT_UNIQUE'),('duplicate_exact','AMBIGUOUS_MULTIPLE_MATCHES'),('source_absent','NOT_FOUND'),
 ('partial_span_trap','AMBIGUOUS_MULTIPLE_MATCHES'),('normalization_candidate','VERIFIED_NORMALIZED_UNIQUE'),('normalization_collision','AMBIGUOUS_MULTIPLE_MATCHES')) t(condition, expected))
SELECT tt || ':' || rt || ':' || sk AS scope_key, condition, CASE WHEN k IN (0, 2, 3) THEN expected ELSE 'OUT_OF_SCOPE' END AS status, count(*) AS row_count FROM b5 CROSS JOIN c GROUP BY ALL""",
)
def challenge_composition(spark, sf_dir):
    """Challenge rows for every event, verified against their condition."""
    at = lambda p: F.get_json_object("gold", p)
    scopes = gold(spark, sf_dir).select(
        F.col("id").alias("origin"), at("$.task_type").alias("task_type"), at("$.route").alias("route"),
        F.json_object_keys(at("$.slots"))[0].alias("slot_path"), F.concat(F.lit("item-"), F.col("ordinal"), F.lit("-")).alias("prefix"),
    )
    grid = G.challenge_grid(scopes, 1)
    slots = grid.select(
        "condition", F.col("input_text").alias("source_text"), F.lit("STRING").alias("kind"), F.col("value").alias("text"),
        F.concat_ws(":", "task_type", "route", "slot_path").alias("scope_key"),
    )
    return V.verify(slots, V.default_policy(spark)).groupBy("scope_key", "condition", "status").agg(F.count("*").alias("row_count"))
