"""Queries over dataset operators with faults put in, so that every rule has something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import cohorts as G
from pactlane.operators import curate as K
from pactlane.operators import diagnose as D
from pactlane.operators import evaluate as E
from pactlane.operators import holdout as H
from pactlane.plans.corpus_queries import _LOCK_SQL, lockbox_rows
from pactlane.plans.curate_queries import HEAD, PAIRS, PROMPT, pairs, rows
from pactlane.plans.evaluation_queries import RECORDS, gold, preds, records
from pactlane.plans.oracle_parts import with_rows
from pactlane.plans.registry import query

# ---- rows, pairs and manifest -------------------------------------------------------------

# Fault of a row by its number: the first that holds is found.
BROKEN = {
    "missing_id": "ordinal % 31 = 1", "invalid_split": "ordinal % 37 = 2", "missing_input_text": "ordinal % 41 = 3", "invalid_contract": "ordinal % 43 = 4",
    "missing_provenance": "ordinal % 47 = 5",
}
EXPANDED = ", ex AS (SELECT id, split, ordinal, unnest(range(3)) AS variant FROM target)"
FIRST_FAULT = "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in BROKEN.items()) + " END"


def broken_rows(spark, sf_dir):
    spoil = lambda name, fault, value: F.when(F.expr(BROKEN[fault]), value).otherwise(F.col(name)).alias(name)
    return rows(spark, sf_dir).select(
        "ordinal", spoil("id", "missing_id", F.lit(" ")), spoil("split", "invalid_split", F.lit("holdout")), spoil("input_text", "missing_input_text", F.lit("\n")),
        spoil("target", "invalid_contract", F.lit('{"task_type":"search"}')), spoil("provenance", "missing_provenance", F.lit(None)),
    )


@query("row_violations", HEAD + EXPANDED + f" SELECT coalesce({FIRST_FAULT}, 'none') AS violation, count(*) AS rows FROM ex GROUP BY ALL")
def row_violations(spark, sf_dir):
    """V3: training rows by the first rule they break."""
    return K.check_rows(broken_rows(spark, sf_dir)).groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("rows"))


WEAK, UNKNOWN, SHOWN = "event_no % 53 = 6", "event_no % 59 = 7", "event_no % 61 = 8"


@query(
    "artifact_failures",
    HEAD + EXPANDED + "," + PAIRS.strip()
    + f""", f AS (SELECT 'schema' AS category, {FIRST_FAULT} AS message FROM ex
 UNION ALL SELECT 'preference_pair', CASE WHEN {UNKNOWN} THEN 'unknown_rejection_reason' WHEN {SHOWN} THEN 'invalid_chosen' WHEN {WEAK} THEN 'weak_pair' END FROM (SELECT id, rejection_reason, CAST(string_split(id, '-')[2] AS BIGINT) AS event_no FROM pairs)
 UNION ALL SELECT 'manifest', unnest(['sft_rows count mismatch', 'preference_pairs count mismatch']))
SELECT category, message, count(*) AS failures FROM f WHERE message IS NOT NULL GROUP BY ALL""",
)
def artifact_failures(spark, sf_dir):
    """V8: failures of rows, pairs and a manifest with wrong counts."""
    p = pairs(spark, sf_dir).withColumn("event_no", F.split("id", "-")[1].cast("long"))
    p = p.withColumn("rejected", F.when(F.expr(WEAK), F.col("chosen")).otherwise(F.col("rejected")))
    p = p.withColumn("chosen", F.when(F.expr(SHOWN), F.lit("{}")).otherwise(F.col("chosen")))
    p = p.withColumn("rejection_reason", F.when(F.expr(UNKNOWN), F.lit("other")).otherwise(F.col("rejection_reason")))
    manifest = spark.createDataFrame([("m", -1, -1)], "manifest_id string, sft_rows long, preference_pairs long")
    return K.counted_failures(broken_rows(spark, sf_dir), p, manifest)


@query("preference_export", HEAD + "," + PAIRS.strip() + f" SELECT id, 'system,user' AS roles, sha256('{PROMPT}' || chr(10) || input_text) AS prompt_sha256, sha256(chosen) AS chosen_sha256, sha256(rejected) AS rejected_sha256, rejection_reason FROM pairs")
def preference_export(spark, sf_dir):
    """Prompt messages, chosen and rejected texts."""
    out = K.preference_export(pairs(spark, sf_dir), PROMPT)
    joined = lambda f: F.transform("prompt", lambda m: m[f])
    return out.select(
        "id", F.array_join(joined("role"), ",").alias("roles"), F.sha2(F.array_join(joined("content"), "\n"), 256).alias("prompt_sha256"),
        F.sha2("chosen", 256).alias("chosen_sha256"), F.sha2("rejected", 256).alias("rejected_sha256"), "rejection_reason",
    )


# ---- candidates ----------------------------------------------------------------------------

FAMILIES = "SELECT event_type AS family, row_number() OVER (ORDER BY event_type) - 1 AS position FROM (SELECT DISTINCT event_type FROM events)"


def families(spark, sf_dir):
    kinds = gold(spark, sf_dir).select(F.split("source_id", "-")[1].alias("family")).distinct()
    return kinds.selectExpr("family", "CAST(row_number() OVER (ORDER BY family) - 1 AS INT) AS position")


@query(
    "seed_grid",
    f"""SELECT 'family-' || family || '-' || lpad(i::VARCHAR, 2, '0') AS id, family, CAST(i AS INT) AS index, ['train', 'dev', 'test'][(i - 1) % 3 + 1] AS split, CAST(position * 12 + i - 1 AS INT) AS ordinal
FROM ({FAMILIES}) CROSS JOIN (SELECT unnest(range(1, 13)) AS i)""",
)
def seed_grid(spark, sf_dir):
    """Family times index seeds with a round-robin split."""
    return G.seed_grid(families(spark, sf_dir), 12)


TEXT, TARGET = "请处理{value}", '{"value":"{value}"}'


def candidate_spec(spark, sf_dir):
    g = gold(spark, sf_dir).where("split <> 'train'")
    return g.select(F.when(F.expr("ordinal % 4 = 0"), F.col("id")).otherwise(F.concat(F.lit("cand-"), "id")).alias("id"), "split", "ordinal", F.split("source_id", "-")[1].alias("family"), F.concat(F.lit("item "), "ordinal").alias("value"))


@query(
    "candidate_seeds",
    with_rows(
        """SELECT CASE WHEN ordinal % 4 = 0 THEN id ELSE 'cand-' || id END AS id, split, replace('请处理{value}', '{value}', 'item ' || ordinal) AS input_text, replace('{"value":"{value}"}', '{value}', 'item ' || ordinal) AS target,
 string_split(source_id, '-')[2] AS family, 'pending_review' AS status, ordinal % 4 = 0 AS clashes FROM scored WHERE arm = 'control' AND split <> 'train'"""
    ),
)
def candidate_seeds(spark, sf_dir):
    """Candidates filled into templates, with those whose id exists already."""
    kinds = families(spark, sf_dir)
    made = G.materialize(candidate_spec(spark, sf_dir), kinds.select("family", F.lit(TEXT).alias("text"), F.lit(TARGET).alias("contract")))
    known = G.clashes(gold(spark, sf_dir), made).withColumn("clashes", F.lit(True))
    at = lambda k: F.element_at("provenance", k)
    out = made.join(known, "id", "left").withColumn("clashes", F.coalesce("clashes", F.lit(False)))
    return out.select("id", "split", "input_text", "target", at("candidate_family").alias("family"), at("status").alias("status"), "clashes")


@query(
    "candidate_merge",
    with_rows("SELECT split, count(*) AS rows, CAST(count(*) FILTER (WHERE new) AS BIGINT) AS merged FROM (SELECT split, false AS new FROM scored WHERE arm = 'control' UNION ALL SELECT split, true FROM scored WHERE arm = 'control' AND split <> 'train' AND ordinal % 4 <> 0) GROUP BY split"),
)
def candidate_merge(spark, sf_dir):
    """The base set with the candidates that do not clash."""
    base = gold(spark, sf_dir).select("id", "split", F.lit(False).alias("new"))
    spec = candidate_spec(spark, sf_dir).select("id", "split", F.lit(True).alias("new"))
    merged = G.merge(base, spec.join(G.clashes(base, spec), "id", "left_anti"))
    return merged.groupBy("split").agg(F.count("*").alias("rows"), F.count_if("new").alias("merged"))


@query("holdout_rows", _LOCK_SQL + " SELECT row_id AS id, 'test' AS split, ordinal FROM t")
def holdout_rows(spark, sf_dir):
    """Held-out rows in the shape of evaluation rows."""
    return H.evaluation_rows(lockbox_rows(spark, sf_dir)).select("id", "split", "ordinal")


# ---- selection, labels, budgets -----------------------------------------------------------------


@query("first_training_rows", with_rows("SELECT id, ordinal FROM scored WHERE arm = 'control' AND source_id LIKE '%-1' ORDER BY ordinal LIMIT 37"))
def first_training_rows(spark, sf_dir):
    """The first rows of chosen sources in input order."""
    g = gold(spark, sf_dir)
    wanted = g.where(F.col("source_id").endswith("-1")).select("source_id").distinct()
    return K.select_training_rows(g, wanted, 37).select("id", "ordinal")


@query(
    "last_predictions",
    with_rows("SELECT arm, count(*) AS ids, CAST(count(*) FILTER (WHERE ordinal % 10 = 3) AS BIGINT) AS replaced FROM scored WHERE raw IS NOT NULL GROUP BY arm"),
)
def last_predictions(spark, sf_dir):
    """Later predictions of an id replace earlier ones."""
    first = preds(spark, sf_dir)
    again = first.where("ordinal % 10 = 3").withColumn("ordinal", F.col("ordinal") + 1_000_000_000).withColumn("raw", F.lit("again"))
    return E.last_prediction(first.unionByName(again)).groupBy("arm").agg(F.count("*").alias("ids"), F.count_if(F.col("raw") == "again").alias("replaced"))


HEADER = "user: x assistant: "
# Characters as tokens; some rows lose an offset, some have a token across the border, some no target.
SHORT, ACROSS, NONE = "ordinal % 17 = 1", "ordinal % 19 = 2", "ordinal % 23 = 3"
GAP = f"CASE WHEN {SHORT} THEN 'label_token_offset_length_mismatch' WHEN {ACROSS} THEN 'assistant_span_token_boundary_unavailable' WHEN {NONE} THEN 'assistant_target_tokens_unavailable' END"


def labelled(spark, sf_dir):
    n = F.lit(len(HEADER)) + F.length("gold")
    places = F.sequence(F.lit(0), n - 1)
    start = F.lit(len(HEADER))
    token = F.transform(places, lambda k: F.struct(F.when(F.expr(ACROSS) & (k == start), k - 1).otherwise(k).alias("start"), (k + 1).alias("end")))
    offsets = F.when(F.expr(SHORT), F.slice(token, 2, n)).otherwise(token)
    end = F.when(F.expr(NONE), start).otherwise(n)
    rows_ = gold(spark, sf_dir).select("id", "ordinal", F.transform(places, lambda k: k.cast("long")).alias("input_ids"), offsets.alias("offsets"), start.alias("span_start"), end.alias("span_end"))
    return K.target_labels(rows_)


@query(
    "label_gaps",
    with_rows(f"SELECT coalesce(gap, 'none') AS gap, count(*) AS rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS target_tokens FROM (SELECT {GAP} AS gap, CASE WHEN {GAP} IS NULL THEN length(gold) END AS n FROM scored WHERE arm = 'control') GROUP BY ALL"),
)
def label_gaps(spark, sf_dir):
    """labels that keep the target only, with the reasons why some rows have none."""
    out = labelled(spark, sf_dir).groupBy(F.coalesce("gap", F.lit("none")).alias("gap"))
    return out.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(F.col("target_tokens") > 0, F.col("target_tokens"))), F.lit(0)).cast("long").alias("target_tokens"))


@query(
    "exposure_budget",
    with_rows(
        f"""SELECT n AS train_rows, t AS target_tokens_per_pass, 32 AS effective_batch_size, CAST(3200 AS BIGINT) AS examples_seen, CAST(round_even(t * 3200 / n::DOUBLE, 0) AS BIGINT) AS target_tokens_seen
FROM (SELECT count(*) AS n, CAST(sum(length(gold)) FILTER (WHERE {GAP} IS NULL) AS BIGINT) AS t FROM scored WHERE arm = 'control')"""
    ),
)
def exposure_budget(spark, sf_dir):
    """Examples and target tokens that a run of given steps sees."""
    return K.exposure_budget(labelled(spark, sf_dir), 4, 8, 100, 1.0)


@query(
    "residual_coverage",
    with_rows(
        """SELECT arm, task_family, families AS source_families, rows AS residual_rows, coalesce(labels, 0) AS field_labels, coalesce(labels, 0) / families::DOUBLE AS coverage FROM (
 SELECT arm, task_family, count(DISTINCT source_id) AS families, count(DISTINCT id) AS rows FROM recs GROUP BY ALL) LEFT JOIN (SELECT task_family, count(DISTINCT field_path) AS labels FROM recs WHERE arm = 'control' AND split = 'train' GROUP BY ALL) USING (task_family)""",
        RECORDS,
    ),
)
def residual_coverage(spark, sf_dir):
    """Field labels of candidate cases over the source families of a cluster."""
    rec = records(spark, sf_dir)
    cases = rec.where("arm = 'control' AND split = 'train'").select("task_family", F.col("field_path").alias("label"))
    return D.coverage_ratio(rec, cases)


@query(
    "stop_reasons",
    """SELECT CASE WHEN event_id % 11 = 0 THEN 'fixture_no_generation' WHEN event_id % 5 = 2 THEN 'tokenizer_eos_observed' WHEN event_id % 40 >= 32 THEN 'max_new_tokens_reached_without_tokenizer_eos' ELSE 'not_recorded_below_max_without_tokenizer_eos' END AS reason,
 count(*) AS attempts FROM events GROUP BY ALL""",
)
def stop_reasons(spark, sf_dir):
    """why generation stopped, from token ids, the end id and the maximum."""
    g = gold(spark, sf_dir).withColumn("tokens", F.sequence(F.lit(100), F.expr("CAST(100 + ordinal % 40 AS INT)")))
    tokens = F.when(F.expr("ordinal % 5 = 2"), F.concat("tokens", F.array(F.lit(2)))).otherwise(F.col("tokens"))
    finish = F.when(F.expr("ordinal % 11 = 0"), F.lit("fixture_no_generation"))
    reason = K.stop_reason(tokens, F.lit(2), F.lit(33), finish)
    return g.groupBy(reason.alias("reason")).agg(F.count("*").alias("attempts"))
