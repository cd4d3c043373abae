"""Leak scan, held-out guard, near-duplicate and split queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlane.operators import holdout as H
from pactlane.operators import leakscan as L
from pactlane.operators import neardup as N
from pactlane.operators.split import stratified_split
from pactlane.plans import inputs
from pactlane.plans.inputs import table
from pactlane.plans.registry import query
from pactlane.plans.shared import written


# One short row file per event, some lines carrying something that must not be published.
NOTE = (
    "'{\"id\":' || event_id || '}' || chr(10) || (CASE event_id % 11 WHEN 0 THEN 'saved under /tmp/run' || user_id || '/out' "
    "WHEN 1 THEN 'api_key: abcd' || (10000 + user_id) WHEN 2 THEN 'host 192.168.1.' || (user_id % 200) WHEN 3 THEN 'ssh dev@host' "
    "WHEN 4 THEN '{\"provenance\":{\"public_safe\":false}}' WHEN 5 THEN 'plain 172.40.1.1' ELSE event_type END)"
)


def files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id"), F.lit(".txt")).alias("path"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    notes = table(spark, sf_dir, "events").selectExpr("'events/' || event_id || '.jsonl' AS path", f"{NOTE} AS text")
    return docs.unionByName(pages).unionByName(notes)


# Patterns of paths, secrets, addresses and SSH details.
PATH_RE = r"""(/Users/[^\s"'')]+|/root/[^\s"'')]+|/tmp/[^\s"'')]+|/mnt/data/[^\s"'')]+)"""
SECRET_RE = r"(sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|(?i:(?:api[_-]?key|secret|token)\s*[:=]\s*[A-Za-z0-9_./+=-]{8,}))"
IP_RE = r"\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b"
SSH_RE = r"(?i)(\bssh\s+[^@\s]+@|ssh-rsa|BEGIN OPENSSH PRIVATE KEY|^\s*HostName\s+\S+|^\s*IdentityFile\s+\S+)"
FILES = f"""f AS (SELECT 'documents/' || doc_id || '.txt' AS path, text FROM documents UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages
 UNION ALL SELECT 'events/' || event_id || '.jsonl', {NOTE} FROM events)"""


@query(
    "leak_scan",
    f"""WITH {FILES}, s AS (SELECT path, string_split_regex(text, '\\r\\n|[\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM f),
l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS body FROM s)
SELECT path, CAST(line AS INT) AS line, h.c AS category, h.d AS detail FROM (SELECT path, line, unnest(list_filter([
 CASE WHEN regexp_matches(body, '{PATH_RE}') THEN {{'c': 'private_path', 'd': 'local absolute path'}} END,
 CASE WHEN regexp_matches(body, '{SECRET_RE}') THEN {{'c': 'secret', 'd': 'secret-like token'}} END,
 CASE WHEN regexp_matches(body, '{IP_RE}') THEN {{'c': 'private_ip', 'd': 'private IP address'}} END,
 CASE WHEN regexp_matches(body, '{SSH_RE}') THEN {{'c': 'ssh_detail', 'd': 'SSH command or key detail'}} END,
 CASE WHEN path LIKE '%.jsonl' AND body LIKE '%"public_safe":false%' THEN {{'c': 'raw_private_row', 'd': 'public JSONL row marked private'}} END], lambda x: x IS NOT NULL)) AS h FROM l)""",
)
def leak_scan(spark, sf_dir):
    """Findings per line of whole documents and pages."""
    return L.scan(files(spark, sf_dir)).select("path", "line", "category", "detail")


@query(
    "redacted_texts",
    f"""WITH {FILES}, r AS (SELECT path, text, regexp_replace(regexp_replace(regexp_replace(text, '{PATH_RE}', '<private_path>', 'g'), '{IP_RE}', '<private_ip>', 'g'), '{SECRET_RE}', '<secret>', 'g') AS t FROM f)
SELECT path, sha256(t) AS redacted_sha256, CAST(length(t) AS INT) AS redacted_chars FROM r WHERE t <> text""",
)
def redacted_texts(spark, sf_dir):
    """hash and length of every text that redaction changes."""
    df = L.redacted(files(spark, sf_dir), "text").where("redacted <> text")
    return df.select("path", F.sha2("redacted", 256).alias("redacted_sha256"), F.length("redacted").alias("redacted_chars"))


@query(
    "unsafe_records",
    f"""WITH {FILES} SELECT rule, count(*) AS records FROM (SELECT CASE WHEN regexp_matches(text, '{PATH_RE}') THEN 'private_path'
 WHEN regexp_matches(text, '{SECRET_RE}') THEN 'secret' WHEN regexp_matches(text, '{IP_RE}') THEN 'private_ip' END AS rule FROM f) WHERE rule IS NOT NULL GROUP BY rule""",
)
def unsafe_records(spark, sf_dir):
    """V9: first violated public-safety rule per record."""
    df = files(spark, sf_dir).select(L.first_unsafe(F.col("text")).alias("rule")).where("rule IS NOT NULL")
    return df.groupBy("rule").agg(F.count("*").alias("records"))


# ---- held-out guard -------------------------------------------------------------------
# Labelled documents are the held-out side, the unlabelled ones the reference pool.


def held_docs(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = docs.join(labels, "doc_id", "left_semi")
    rest = docs.join(labels, "doc_id", "left_anti")
    as_keys = lambda df: df.select(
        F.col("doc_id").cast("string").alias("row_id"), F.col("text").alias("input_text"), H.T.holdout_text(F.col("text")).alias("normalized_text"),
        F.concat_ws("|", "lang", "source").alias("family_id"),
    )
    return as_keys(held), as_keys(rest)


@query(
    "contamination",
    r"""WITH d AS (SELECT doc_id::VARCHAR AS id, text, regexp_replace(lower(text), '[\s\x1c-\x1f\p{P}\p{S}]+', '', 'g') AS nt, doc_id IN (SELECT doc_id FROM labels) AS held FROM documents)
SELECT a.id AS row_id, 'exact_input_text_overlap' AS category, b.id AS reference_row_id, 'train' AS reference_source FROM d a JOIN d b ON a.held AND NOT b.held AND a.text = b.text AND a.text <> ''
UNION ALL SELECT a.id, 'normalized_input_text_overlap', b.id, 'train' FROM d a JOIN d b ON a.held AND NOT b.held AND a.nt = b.nt AND a.nt <> ''""",
)
def contamination(spark, sf_dir):
    """Held-out documents equal to a reference document, one failure per match."""
    held, rest = held_docs(spark, sf_dir)
    pool = rest.select(
        F.col("row_id").alias("reference_row_id"), F.lit("train").alias("reference_source"), F.array("row_id").alias("reference_ids"),
        "input_text", "normalized_text", "family_id",
    )
    return H.overlaps(held, pool)


LOCK = [
    (
        "row_id",
        "CASE ev % 19 WHEN 12 THEN 'lock-dup-' || CAST(ev % 3 AS STRING) ELSE 'lock-' || CAST(ev AS STRING) END",
    ),
    (
        "body",
        "'\"analysis_seen\":' || (CASE ev % 19 WHEN 2 THEN 'true' WHEN 3 THEN '\"no\"' ELSE 'false' END)",
    ),
    (
        "anc",
        "CASE ev % 19 WHEN 7 THEN '\"none\"' WHEN 8 THEN '[\"evt-' || CAST(ev - ev % 10 AS STRING) || '\"]' WHEN 9 THEN '[\"remediation batch\"]' "
        "WHEN 10 THEN '[{\"derived_from\":[\"analysis\"],\"id\":\"x-1\"}]' ELSE '[]' END",
    ),
    (
        "src",
        "CASE ev % 19 WHEN 4 THEN '\"s\"' WHEN 5 THEN '{\"category\":\"Training\",\"provenance\":{\"a\":1}}' WHEN 6 THEN '{\"category\":\"human\",\"provenance\":{}}' "
        "ELSE '{\"category\":\"human\",\"provenance\":{\"a\":1}}' END",
    ),
]
LOCK_ROW = [
    (
        "canon",
        "'{' || body || ',\"derived_from\":' || anc || ',\"gold_contract\":{\"confirmation_required\":' || conf || ',\"contract_version\":\"v1\",\"language\":\"zh-CN\",\"normalized_command\":\"' || cmd || '\",\"route\":\"' || rt || "
        "'\",\"safety\":{\"allow\":' || allow || ',\"reason\":\"' || reason || '\"},\"slots\":{\"' || sk || '\":\"' || sv || '\"' || sx || '},\"task_type\":\"' || tt || '\"},\"input_text\":\"' || input_text || '\",\"row_id\":\"' || row_id || '\"' || "
        "(CASE WHEN ev % 19 = 1 THEN '' ELSE ',\"semantic_family_id\":\"fam-' || kind || '-' || CAST(k AS STRING) || '\"' END) || ',\"source\":' || src || '}'",
    )
]


def lock_parts(spark, sf_dir):
    df = inputs.add(inputs._parts(spark, sf_dir), LOCK)
    return inputs.add(df, LOCK_ROW)


def lockbox(spark, sf_dir):
    """Test rows as held-out JSON rows with a declared hash; some break a rule."""
    df = lock_parts(spark, sf_dir).where("split = 'test'")
    declared = F.when(F.col("ev") % 19 == 11, F.lit("0" * 64)).otherwise(F.sha2("canon", 256))
    raw = F.concat(F.lit('{"content_hash":"'), declared, F.lit('",'), F.expr("substring(canon, 2)"))
    return df.select("ordinal", raw.alias("raw"))


def lockbox_rows(spark, sf_dir):
    return written(spark, sf_dir, "lockbox", lambda: lockbox(spark, sf_dir))


def train_pool(spark, sf_dir):
    """Train rows as reference JSON rows."""
    df = inputs.gold_rows(spark, sf_dir).where("split = 'train'")
    return df.select("ordinal", F.to_json(F.struct("id", "input_text", F.struct("source_id").alias("provenance"))).alias("raw"))


_LOCK_SQL = f"""WITH {inputs.sql_prelude()}, lk0 AS ({inputs._cte(LOCK, "b5")}), lk AS ({inputs._cte(LOCK_ROW, "lk0")}),
t AS (SELECT * FROM lk WHERE split = 'test')"""


@query(
    "holdout_row_failures",
    _LOCK_SQL
    + """ SELECT category, message, count(*) AS failures FROM (SELECT unnest(list_filter([
 CASE ev % 19 WHEN 1 THEN {'category': 'missing_required_field', 'message': 'semantic_family_id is required'} WHEN 2 THEN {'category': 'analysis_seen_violation', 'message': 'final lockbox rows must set analysis_seen=false'}
 WHEN 3 THEN {'category': 'missing_required_field', 'message': 'analysis_seen must be a boolean'} WHEN 4 THEN {'category': 'missing_provenance', 'message': 'source must contain category and provenance'}
 WHEN 5 THEN {'category': 'forbidden_source_category', 'message': 'lockbox row source.category must not be train, analysis, or remediation'}
 WHEN 6 THEN {'category': 'missing_provenance', 'message': 'source.provenance must be a non-empty object'} WHEN 7 THEN {'category': 'missing_required_field', 'message': 'derived_from must be a list'}
 WHEN 11 THEN {'category': 'content_hash_mismatch', 'message': 'declared content_hash does not match deterministic row hash'} END], lambda x: x IS NOT NULL), recursive := true) FROM t)
 GROUP BY ALL""",
)
def holdout_row_failures(spark, sf_dir):
    """Held-out row rules and content hashes."""
    return H.row_failures(H.read_rows(lockbox_rows(spark, sf_dir))).groupBy("category", "message").agg(F.count("*").alias("failures"))


@query(
    "holdout_duplicates",
    _LOCK_SQL
    + """ SELECT row_id, CAST(count(*) - 1 AS BIGINT) AS repeats, 'first at ' || min(ordinal) AS message FROM t GROUP BY row_id HAVING count(*) > 1""",
)
def holdout_duplicates(spark, sf_dir):
    """Repeated row ids pointing at their first row."""
    return H.duplicates(H.read_rows(lockbox_rows(spark, sf_dir)), "row_id", "duplicate_row_id").groupBy("row_id", "message").agg(
        F.count("*").alias("repeats")
    )


@query(
    "forbidden_ancestry",
    _LOCK_SQL
    + """ SELECT row_id, 'evt-' || (ev - ev % 10) AS ancestor FROM t WHERE ev % 19 = 8 UNION SELECT row_id, 'remediation batch' FROM t WHERE ev % 19 = 9
 UNION SELECT row_id, 'analysis' FROM t WHERE ev % 19 = 10""",
)
def forbidden_ancestry(spark, sf_dir):
    """Ancestors that reach train rows or forbidden sources."""
    pool = H.reference_pool(H.read_rows(train_pool(spark, sf_dir)), "train")
    return H.forbidden_ancestry(H.read_rows(lockbox_rows(spark, sf_dir)), pool)


@query(
    "holdout_manifest",
    """SELECT 'm-1' AS row_id, unnest(['manifest_count_mismatch', 'manifest_timestamp_missing', 'manifest_hash_mismatch']) AS category,
 unnest(['manifest row_count must match lockbox row count', 'manifest must declare created_at or frozen_at', 'content_hashes must match row hashes in order']) AS message
 FROM (SELECT count(*) AS n FROM events WHERE event_id % 10 >= 8) WHERE n > 1""",
)
def holdout_manifest(spark, sf_dir):
    """A manifest with a wrong count, no timestamp and too short a list against the frozen set."""
    rows = lockbox_rows(spark, sf_dir)
    facts = H.freeze_manifest(rows)
    manifest = facts.select(
        F.to_json(
            F.struct(
                F.lit("m-1").alias("manifest_id"), F.lit(True).alias("frozen"), (F.col("row_count") + 1).alias("row_count"), "family_count",
                F.lit("v1").alias("schema_version"), F.create_map(F.lit("a"), F.lit(1)).alias("provenance_summary"), F.col("ordered_hash").alias("lockbox_hash"),
                F.array(F.lit("0" * 64)).alias("content_hashes"),
            )
        ).alias("raw")
    )
    return H.manifest_failures(rows, manifest)


def tree_sql(leaf: str, source: str, order: str) -> str:
    """The digest tree in SQL: leaves, then 1024 at a time."""
    levels = [f"t0 AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS p, sha256({leaf}) AS h, 1 AS n FROM {source})"]
    for k in range(1, H.LEVELS + 1):
        levels.append(f"t{k} AS (SELECT p >> {H.FAN_BITS} AS p, sha256(string_agg(h, ',' ORDER BY t{k - 1}.p)) AS h, sum(n) AS n FROM t{k - 1} GROUP BY t{k - 1}.p >> {H.FAN_BITS})")
    return ", ".join(levels)


@query(
    "ordered_hash",
    f"""WITH {tree_sql("'\"' || sha256(text) || '\"'", "documents", "doc_id")} SELECT CAST(n AS BIGINT) AS row_count, h AS ordered_hash FROM t{H.LEVELS}""",
)
def ordered_hash(spark, sf_dir):
    """ordered digest over the hashes of all documents."""
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("h"))
    return H.ordered_hash(df, "h")


@query(
    "ordered_line_hash",
    f"""WITH {tree_sql("text || chr(10)", "documents", "doc_id")} SELECT CAST(n AS BIGINT) AS row_count, h AS ordered_hash FROM t{H.LEVELS}""",
)
def ordered_line_hash(spark, sf_dir):
    """newline form of the ordered digest."""
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text")
    return H.ordered_hash(df, "text", "lines")


# ---- near-duplicates and split ----------------------------------------------------------


def user_turns(spark, sf_dir):
    """Whole user turns as candidate seed texts."""
    df = table(spark, sf_dir, "conversations").where("role = 'user'")
    return df.select(F.format_string("%012d-%08d", "conv_id", "turn").alias("key"), "text")


@query(
    "near_dup_turns",
    """WITH u AS (SELECT text, min(printf('%012d-%08d', conv_id, turn)) AS k FROM conversations WHERE role = 'user' GROUP BY text)
SELECT a.k AS i, b.k AS j, CAST(levenshtein(a.text, b.text) AS INT) AS distance, levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text))::DOUBLE AS ratio
FROM u a JOIN u b ON a.k < b.k AND abs(length(a.text) - length(b.text)) < 0.3 * greatest(length(a.text), length(b.text))
WHERE levenshtein(a.text, b.text) < 0.3::DOUBLE * greatest(length(a.text), length(b.text))""",
)
def near_dup_turns(spark, sf_dir):
    """Distinct user turns closer than 0.3 of the longer length."""
    return N.edit_pairs(N.first_texts(user_turns(spark, sf_dir), "key", "text"))


DOCUMENT_RATIO = 0.05  # of the longer document
# DuckDB compares bytes, so letters of two bytes become single unused ones.
LETTERS = "äöüßÄÖÜéèêëÉÈÊçÇñÑáíóúÁÍÓÚ"
SPARE = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32)][: len(LETTERS)])
# Every pair of close texts shares 12 characters so often; short texts are all compared.
NEAR_DOCUMENTS = f"""u AS (SELECT text, min(doc_id) AS k FROM documents GROUP BY text),
x AS MATERIALIZED (SELECT k, translate(text, '{LETTERS}', {SPARE}) AS t, length(text) AS n FROM u),
g AS MATERIALIZED (SELECT k, n, h, count(*) AS c FROM (SELECT k, n, hash(substr(t, i, 12)) AS h FROM (SELECT k, n, t, unnest(range(1, n - 10)) AS i FROM x WHERE n >= 60)) GROUP BY ALL),
c AS (SELECT a.k AS i, b.k AS j FROM g a JOIN g b ON a.h = b.h AND a.k < b.k AND abs(a.n - b.n) < {DOCUMENT_RATIO} * greatest(a.n, b.n)
 GROUP BY a.k, b.k, a.n, b.n HAVING sum(least(a.c, b.c)) >= 0.4 * greatest(a.n, b.n) - 11
 UNION SELECT a.k, b.k FROM x a JOIN x b ON a.k < b.k AND least(a.n, b.n) < 60 AND abs(a.n - b.n) < {DOCUMENT_RATIO} * greatest(a.n, b.n)),
e AS MATERIALIZED (SELECT i, j, levenshtein(a.t, b.t) AS d, greatest(a.n, b.n) AS m FROM c JOIN x a ON a.k = i JOIN x b ON b.k = j WHERE d < {DOCUMENT_RATIO}::DOUBLE * m)"""


def document_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return written(spark, sf_dir, "document_pairs", lambda: N.edit_pairs(N.first_texts(docs, "doc_id", "text"), DOCUMENT_RATIO))


@query("near_dup_pairs", f"WITH {NEAR_DOCUMENTS} SELECT i, j, CAST(d AS INT) AS distance, d / m::DOUBLE AS ratio FROM e")
def near_dup_pairs(spark, sf_dir):
    """Distinct whole documents closer than a twentieth of the longer length."""
    return document_pairs(spark, sf_dir)


@query(
    "greedy_dedupe",
    f"""WITH RECURSIVE {NEAR_DOCUMENTS},
r(gone) AS (SELECT []::BIGINT[] UNION SELECT coalesce((SELECT list_sort(list(DISTINCT e.j)) FROM e
 WHERE e.i NOT IN (SELECT f.j FROM e f WHERE NOT list_contains(r.gone, f.i))), []) FROM r)
SELECT doc_id, doc_id = k AND NOT list_contains((SELECT gone FROM r ORDER BY len(gone) DESC LIMIT 1), doc_id) AS kept FROM documents JOIN u USING (text)""",
)
def greedy_dedupe(spark, sf_dir):
    """Greedy removal of near duplicates among whole documents, identical to the sequential loop."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return N.greedy_kept(docs, "doc_id", "text", DOCUMENT_RATIO, document_pairs(spark, sf_dir)).select("doc_id", "kept")


@query(
    "jaccard_overlaps",
    """WITH d AS (SELECT doc_id, text, doc_id IN (SELECT doc_id FROM labels) AS held FROM documents),
g AS (SELECT doc_id, held, list_distinct(CASE WHEN length(text) < 3 THEN [text] ELSE list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)) END) AS s FROM d),
e AS (SELECT doc_id, held, len(s) AS n, unnest(s) AS t FROM g),
x AS (SELECT a.doc_id AS left_key, b.doc_id AS right_key, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.held AND NOT b.held AND a.t = b.t
 AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY ALL)
SELECT left_key, right_key, c / (na + nb - c)::DOUBLE AS jaccard FROM x WHERE c / (na + nb - c)::DOUBLE >= 0.8""",
)
def jaccard_overlaps(spark, sf_dir):
    """Held-out documents with a reference document of 3-gram Jaccard >= 0.8."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    side = lambda how: docs.join(labels, "doc_id", how).select(F.col("doc_id").alias("key"), "text")
    return N.jaccard_pairs(side("left_semi"), side("left_anti"))


@query(
    "stratified_split",
    """WITH s AS (SELECT d.doc_id, d.lang || '|' || coalesce(l.quality::VARCHAR, 'none') AS stratum FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM s)
SELECT doc_id, stratum, CASE WHEN rn <= greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train' WHEN rn <= greatest(1, floor(n * 0.7::DOUBLE)) + greatest(1, floor(n * 0.15::DOUBLE)) THEN 'dev' ELSE 'test' END AS split FROM r""",
)
def split_query(spark, sf_dir):
    """Exact stratified split of documents by language and quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    df = docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", F.concat_ws("|", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("none"))).alias("stratum")
    )
    return stratified_split(df, "stratum", "doc_id")


@query(
    "label_confusion",
    """SELECT lang, count(*) AS row_count, CAST(count(*) FILTER (WHERE n_chars >= 300 AND quality = 1) AS BIGINT) AS true_positive,
 CAST(count(*) FILTER (WHERE n_chars >= 300 AND quality = 0) AS BIGINT) AS false_positive, CAST(count(*) FILTER (WHERE n_chars < 300 AND quality = 1) AS BIGINT) AS false_negative,
 count(*) FILTER (WHERE n_chars >= 300 AND quality = 1)::DOUBLE / nullif(count(*) FILTER (WHERE n_chars >= 300), 0) AS precision,
 count(*) FILTER (WHERE n_chars >= 300 AND quality = 1)::DOUBLE / nullif(count(*) FILTER (WHERE quality = 1), 0) AS recall
FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def label_confusion(spark, sf_dir):
    """A5 on labels: nullable precision and recall of a length rule per language."""
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    said, real = F.col("n_chars") >= 300, F.col("quality") == 1
    agg = df.groupBy("lang").agg(
        F.count("*").alias("row_count"), F.count_if(said & real).alias("true_positive"), F.count_if(said & ~real).alias("false_positive"),
        F.count_if(~said & real).alias("false_negative"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return agg.select("*", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))
