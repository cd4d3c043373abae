"""Queries over files, streams and raw outputs: what is written is read back and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pactlane.functions.contract import is_one_json_value
from pactlane.operators import decode as X
from pactlane.operators import leakscan as L
from pactlane.operators import provenance as P
from pactlane.plans.corpus_queries import IP_RE, NOTE, PATH_RE, SECRET_RE, SSH_RE
from pactlane.plans.evaluation_queries import gold, preds, scored
from pactlane.plans.inputs import table
from pactlane.plans.oracle_parts import with_rows
from pactlane.plans.provenance_queries import SLOTS
from pactlane.plans.registry import ORACLE, query
from pactlane.session import ensure_checkpoint_dir
from pactlane.sources import rows as R
from pactlane.streaming.sidecar import PREDICTION_SCHEMA, forget_last_commit, outcome_summary, start_sidecar_stream


def folder(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---- a tree of files ----------------------------------------------------------------------

MAX_ROWS = 1500
# 50 documents or 250 events in a file; every third thousand of events is one file of too many rows.
DOC_FILE = "'documents/' || CAST(doc_id // 50 AS STRING) || '.txt'"
EVENT_BLOCK = "CASE WHEN event_id // 1000 % 3 = 0 THEN event_id // 1000 * 4 ELSE event_id // 250 END"
EVENT_FILE = f"CASE WHEN ({EVENT_BLOCK}) % 8 = 5 THEN '.git/' ELSE 'events/' END || CAST({EVENT_BLOCK} AS STRING) || '.jsonl'"
REQUESTED = ("documents", "events", "absent/folder", "events/x.jsonl")
BROKEN = "doc_id // 50 % 7 = 3"  # files that start with a byte of no encoding


def _spark(sql: str) -> str:
    return sql.replace("//", "div")


def _files(df, path: str, key: str, text: str, broken: str = "false"):
    rows = df.selectExpr(f"{_spark(path)} AS path", f"{key} AS k", f"{text} AS text", f"{_spark(broken)} AS broken")
    body = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda e: e["text"]), "\n").alias("text"), F.bool_or("broken").alias("broken"))
    return body.select("path", F.concat(F.when(F.col("broken"), F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))), F.col("text").cast("binary")).alias("content"))


TREE = f"""fl AS (SELECT {DOC_FILE} AS path, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents WHERE NOT ({BROKEN}) GROUP BY ALL
 UNION ALL SELECT path, string_agg(note, chr(10) ORDER BY event_id) FROM (SELECT {EVENT_FILE} AS path, {NOTE} AS note, event_id FROM events) WHERE path NOT LIKE '.git/%' GROUP BY path),
s AS (SELECT path, string_split_regex(text, '\\r\\n|[\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM fl),
l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS body FROM s)"""


@query(
    "file_tree_scan",
    f"""WITH {TREE}
SELECT path, CAST(line AS INT) AS line, h.c AS category, h.d AS detail FROM (SELECT path, line, unnest(list_filter([
 CASE WHEN regexp_matches(body, '{PATH_RE}') THEN {{'c': 'private_path', 'd': 'local absolute path'}} END,
 CASE WHEN regexp_matches(body, '{SECRET_RE}') THEN {{'c': 'secret', 'd': 'secret-like token'}} END,
 CASE WHEN regexp_matches(body, '{IP_RE}') THEN {{'c': 'private_ip', 'd': 'private IP address'}} END,
 CASE WHEN regexp_matches(body, '{SSH_RE}') THEN {{'c': 'ssh_detail', 'd': 'SSH command or key detail'}} END,
 CASE WHEN path LIKE '%.jsonl' AND body LIKE '%"public_safe":false%' THEN {{'c': 'raw_private_row', 'd': 'public JSONL row marked private'}} END], lambda x: x IS NOT NULL)) AS h FROM l)
UNION ALL SELECT path, 0, 'oversized_public_corpus', (len(list_filter(ls, lambda x: trim(x) <> ''))) || ' rows exceeds {MAX_ROWS}' FROM s WHERE path LIKE '%.jsonl' AND len(list_filter(ls, lambda x: trim(x) <> '')) > {MAX_ROWS}
UNION ALL SELECT p, 0, 'missing_path', 'scan input path does not exist' FROM (SELECT unnest({list(REQUESTED)}) AS p) WHERE NOT EXISTS (SELECT 1 FROM fl WHERE path = p OR starts_with(path, p || '/'))""",
)
def file_tree_scan(spark, sf_dir):
    """Leak scan of a written tree with undecodable, oversized, skipped and missing files."""
    root = folder(spark, "tree")
    R.write_tree(_files(table(spark, sf_dir, "documents"), DOC_FILE, "doc_id", "text", BROKEN), root)
    R.write_tree(_files(table(spark, sf_dir, "events"), EVENT_FILE, "event_id", NOTE), root)
    files = R.read_tree(spark, root).withColumn("path", F.substring_index("path", root.rpartition("/")[2] + "/", -1))
    requested = spark.createDataFrame([(p,) for p in REQUESTED], "path string")
    return L.scan(files, requested, MAX_ROWS).select("path", "line", "category", "detail")


@query(
    "held_contracts",
    with_rows("SELECT g.ordinal, 1 + CAST(c.ok AS INT) + CAST(t.ok AS INT) AS contracts FROM scored c JOIN scored t ON c.id = t.id AND c.arm = 'control' AND t.arm = 'treatment' JOIN gold_rows g ON g.id = c.id"),
)
def held_contracts(spark, sf_dir):
    """Valid contracts of records that hold a target, a chosen and a rejected one."""
    wide = preds(spark, sf_dir).groupBy("id").pivot("arm", ["control", "treatment"]).agg(F.first("raw"))
    held = lambda c, name: F.when(is_one_json_value(F.col(c)) & F.json_object_keys(c).isNotNull(), F.concat(F.lit(f',"{name}":'), F.col(c))).otherwise(F.lit(""))
    rows = gold(spark, sf_dir).join(wide, "id", "left").withColumn("gold_part", F.concat(F.lit('{"input_text":"x","target_contract":'), F.col("gold")))
    raw = rows.select("ordinal", F.concat("gold_part", held("control", "chosen_contract"), held("treatment", "rejected_contract"), F.lit("}")).alias("raw"))
    return R.contracts_of(raw).groupBy("ordinal").agg(F.count("*").cast("int").alias("contracts"))


# ---- stream -------------------------------------------------------------------------------

# Every fiftieth prediction arrives twice, as a source that sends again would do.
AGAIN = "ordinal % 50 = 7"


@query("hook_stream", ORACLE["hook_outcomes"].replace("FROM scored LEFT JOIN", f"FROM (SELECT * FROM scored UNION ALL SELECT * FROM scored WHERE {AGAIN}) LEFT JOIN"))
def hook_stream(spark, sf_dir):
    """The sidecar as a stream, its last batch run twice; the outcomes are those of one batch run."""
    source, out, state = (folder(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    rows = scored(spark, sf_dir).select("arm", "id", F.col("ordinal").cast("long").alias("ordinal"), "split", "input_text", "raw")
    sent = rows.withColumn("__times", F.explode(F.expr(f"sequence(1, CASE WHEN {AGAIN} THEN 2 ELSE 1 END)"))).drop("__times")
    sent.repartition(6, "ordinal").write.parquet(source)
    arriving = lambda: spark.readStream.schema(PREDICTION_SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
    start_sidecar_stream(arriving(), P.default_policy(spark), out, state).awaitTermination()
    forget_last_commit(spark, state)
    start_sidecar_stream(arriving(), P.default_policy(spark), out, state).awaitTermination()
    return outcome_summary(spark.read.parquet(out))


# ---- sidecars and predictions ---------------------------------------------------------------

# Sidecars name the prediction by hashes: some are repeated, some name none.
CAR_OUTPUT = "CASE WHEN ordinal % 19 = 4 THEN 'unknown' ELSE raw END"


@query(
    "sidecar_matches",
    with_rows(
        f"""SELECT c.arm, c.id, u.matched_id FROM (SELECT arm, id, sha256(input_text) AS ih, sha256({CAR_OUTPUT}) AS ph FROM scored WHERE raw IS NOT NULL) c LEFT JOIN
 (SELECT sha256(input_text) AS ih, sha256(raw) AS ph, min(arm || ':' || id) AS matched_id FROM scored WHERE raw IS NOT NULL GROUP BY ALL HAVING count(*) = 1) u USING (ih, ph)"""
    ),
)
def sidecar_matches(spark, sf_dir):
    """Sidecars matched to predictions by input and output hash, only where one prediction has both."""
    rows = scored(spark, sf_dir).where("raw IS NOT NULL")
    hashes = lambda output: [F.sha2("input_text", 256).alias("input_hash"), F.sha2(F.expr(output), 256).alias("prediction_hash")]
    made = rows.select(F.concat_ws(":", "arm", "id").alias("id"), *hashes("raw"))
    return P.match_sidecars(rows.select("arm", "id", *hashes(CAR_OUTPUT)), made).select("arm", "id", "matched_id")


# ---- objects inside damaged outputs -----------------------------------------------------------

DAMAGED = (
    "CASE ordinal % 7 WHEN 1 THEN 'Answer: ' || raw || ' or {none}' WHEN 2 THEN '```json' || chr(10) || raw || chr(10) || '```' WHEN 3 THEN left(raw, 60) "
    "WHEN 4 THEN '{\"text\":\"a } and \\\\\" { b\",\"n\":{}} {' WHEN 5 THEN '[' || raw || ']' WHEN 6 THEN '  ' ELSE raw END"
)
DAMAGED_SQL = DAMAGED.replace("\\\\", "\\")


def _whole(c: str) -> str:
    return f"coalesce(json_valid({c}), false)"


@query(
    "object_payloads",
    with_rows(
        rf"""SELECT arm, id, CASE WHEN whole THEN t END AS strict, CASE WHEN whole THEN t WHEN {_whole("cut")} THEN cut END AS fragment,
 CASE WHEN whole THEN t WHEN kind = 1 AND {_whole("regexp_replace(raw, ' extra$', '')")} AND raw LIKE '{{%' THEN regexp_replace(raw, ' extra$', '') WHEN kind = 1 AND j IS NULL AND starts_with(raw, 'Answer: ') AND {_whole("substr(raw, 9)")} THEN substr(raw, 9)
  WHEN kind = 4 THEN '{{"text":"a }} and \" {{ b","n":{{}}}}' WHEN {_whole("cut")} THEN cut END AS balanced FROM (
 SELECT *, {_whole("t")} AS whole, CASE WHEN t LIKE '%{{%}}%' THEN substr(t, instr(t, '{{'), length(t) - instr(reverse(t), '}}') + 2 - instr(t, '{{')) END AS cut FROM (
 SELECT arm, id, raw, j, ordinal % 7 AS kind, trim({DAMAGED_SQL}, ' ' || chr(10)) AS t FROM scored WHERE raw IS NOT NULL))"""
    ),
)
def object_payloads(spark, sf_dir):
    """Objects taken out of damaged outputs: strictly, by outer braces and by balanced braces."""
    rows = scored(spark, sf_dir).where("raw IS NOT NULL").select("arm", "id", F.expr(DAMAGED).alias("t"))
    value = lambda payload: X.once(payload, lambda p: F.when(is_one_json_value(p), p))
    return rows.select("arm", "id", *[value(f(F.col("t"))).alias(n) for n, f in (("strict", X.strict_payload), ("fragment", X.fragment_payload), ("balanced", X.balanced_payload))])
