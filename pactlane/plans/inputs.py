"""Contract tables derived from the ``events`` table.

Each expression is plain SQL text understood by Spark and by DuckDB, so the same derivation
feeds the Spark queries and the SQL that checks them. Every event becomes one gold row; two
arms predict it, each breaking a different set of rows in a different way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BASE = [
    ("id", "'evt-' || CAST(event_id AS STRING)"),
    ("ordinal", "event_id"),
    (
        "split",
        "CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'dev' ELSE 'test' END",
    ),
    ("k", "event_id % 6"),
    ("ev", "event_id"),
    ("kind", "event_type"),
    ("num", "CAST(user_id % 50 AS STRING)"),
    ("val", "event_type || '-' || CAST(user_id % 50 AS STRING)"),
]

PARTS = [
    (
        "tt",
        "CASE k WHEN 0 THEN 'search' WHEN 1 THEN 'navigate' WHEN 2 THEN 'form_fill' WHEN 3 THEN 'extract' "
        "WHEN 4 THEN 'clarify' ELSE 'blocked' END",
    ),
    (
        "rt",
        "CASE k WHEN 0 THEN 'search_web' WHEN 1 THEN 'open_url' WHEN 2 THEN 'fill_form' WHEN 3 THEN 'extract_page' "
        "WHEN 4 THEN 'clarify' ELSE 'deny' END",
    ),
    ("allow", "CASE WHEN k = 5 THEN 'false' ELSE 'true' END"),
    (
        "reason",
        "CASE WHEN k = 2 THEN 'requires_confirmation' WHEN k = 4 THEN 'ambiguous_request' "
        "WHEN k = 5 THEN 'unsafe_payment' ELSE 'public_readonly' END",
    ),
    ("conf", "CASE WHEN k IN (2, 4) OR (k = 5 AND ev % 4 = 1) THEN 'true' ELSE 'false' END"),
    (
        "sk",
        "CASE k WHEN 0 THEN 'query' WHEN 1 THEN 'url' WHEN 2 THEN 'field' WHEN 3 THEN 'target' "
        "WHEN 4 THEN 'ambiguity' ELSE 'reason' END",
    ),
    (
        "ak",
        "CASE k WHEN 0 THEN 'keyword' WHEN 1 THEN 'link' WHEN 2 THEN 'field_name' WHEN 3 THEN 'content' "
        "WHEN 4 THEN 'missing_info' ELSE 'rationale' END",
    ),
    (
        "sv",
        "CASE WHEN k = 0 AND ev % 12 = 0 THEN '北京明天天气' WHEN k = 1 THEN 'https://' || kind || '.example.com/' || num "
        "WHEN k = 3 AND ev % 5 = 0 THEN '商品价格' WHEN k = 5 THEN 'payment_requires_user_control' ELSE val END",
    ),
    ("sx", "CASE WHEN k = 2 THEN ',\"value\":' || num ELSE '' END"),
]

GOLD = [
    (
        "cmd",
        "CASE WHEN k = 0 AND ev % 12 = 0 THEN '搜索北京明天 天气' WHEN k = 0 THEN '搜索' || sv WHEN k = 1 THEN '打开 ' || sv "
        "WHEN k = 2 THEN '填写' || sv || '并确认' WHEN k = 3 THEN '提取页面' || sv WHEN k = 4 THEN '请求澄清' || sv "
        "ELSE '拒绝付款' END",
    ),
    (
        "input_text",
        "(CASE k WHEN 0 THEN '帮我搜索' WHEN 1 THEN '打开' WHEN 2 THEN '填写' WHEN 3 THEN '提取页面' WHEN 4 THEN '处理' "
        "ELSE '付款' END) || (CASE ev % 7 WHEN 3 THEN sv || ' 或 ' || sv WHEN 4 THEN '目标' "
        "WHEN 5 THEN upper(kind) || ' ' || num WHEN 6 THEN kind ELSE sv || '，谢谢' END)",
    ),
    (
        "gold",
        "'{\"task_type\":\"' || tt || '\",\"route\":\"' || rt || '\",\"safety\":{\"allow\":' || allow || ',\"reason\":\"' || reason || "
        "'\"},\"confirmation_required\":' || conf || ',\"slots\":{\"' || sk || '\":\"' || sv || '\"' || sx || '},\"normalized_command\":\"'",
    ),
]
GOLD_TAIL = ("gold", "gold || cmd || '\",\"language\":\"zh-CN\",\"contract_version\":\"v1\"}'")

# One prediction piece per contract part; m selects which part (if any) is broken.
PREDICTION = [
    (
        "p_head",
        "'{\"task_type\":\"' || (CASE m WHEN 6 THEN 'query_weather_request' WHEN 20 THEN 'clarify' ELSE tt END) || '\",\"route\":\"' || "
        "(CASE m WHEN 5 THEN '/search/path' WHEN 10 THEN (CASE WHEN rt = 'open_url' THEN 'search_web' ELSE 'open_url' END) "
        "WHEN 20 THEN 'clarify' ELSE rt END) || '\",\"safety\":{\"allow\":' || "
        "(CASE WHEN m = 9 THEN (CASE WHEN allow = 'true' THEN 'false' ELSE 'true' END) ELSE allow END) || ',\"reason\":\"' || "
        "(CASE WHEN m = 18 THEN 'other_reason' ELSE reason END) || '\"' || (CASE WHEN m = 22 THEN ',\"level\":\"x\"' ELSE '' END) || '}'",
    ),
    (
        "p_conf",
        "CASE m WHEN 3 THEN '' WHEN 7 THEN ',\"confirmation_required\":\"true\"' "
        "WHEN 19 THEN ',\"confirmation_required\":' || (CASE WHEN conf = 'true' THEN 'false' ELSE 'true' END) "
        "ELSE ',\"confirmation_required\":' || conf END",
    ),
    (
        "p_slots",
        "CASE m WHEN 8 THEN '[]' WHEN 11 THEN '{\"' || sk || '\":\"' || sv || '_x\"' || sx || '}' "
        "WHEN 12 THEN '{\"' || ak || '\":\"' || sv || '\"' || sx || '}' WHEN 13 THEN '{}' "
        "WHEN 14 THEN '{\"' || sk || '\":\"' || sv || '\"' || sx || ',\"extra\":true}' "
        "WHEN 17 THEN '{\"' || sk || '\":\"' || upper(sv) || '!\"' || sx || '}' WHEN 24 THEN '{\"' || sk || '\":\"' || kind || '\"' || sx || '}' "
        "WHEN 25 THEN '{\"other\":\"' || sv || '\"}' WHEN 26 THEN '{\"' || sk || '\":5}' "
        "WHEN 27 THEN '{\"' || sk || '\":{\"a\":[\"' || sv || '\",1]}}' "
        "WHEN 29 THEN '{\"' || sk || '\":\"完全不同\"' || sx || '}' "
        "ELSE '{\"' || sk || '\":\"' || sv || '\"' || sx || '}' END",
    ),
    (
        "p_cmd",
        "CASE m WHEN 15 THEN cmd || '吧' WHEN 23 THEN '' ELSE cmd END",
    ),
]
PREDICTION_TEXT = (
    "raw",
    "CASE m WHEN 0 THEN NULL WHEN 1 THEN '{\"task_type\": \"search\", ' WHEN 21 THEN 'null' ELSE "
    "(CASE WHEN m = 2 THEN 'Answer: ' ELSE '' END) || p_head || p_conf || ',\"slots\":' || p_slots || "
    "',\"normalized_command\":\"' || p_cmd || '\",\"language\":\"' || (CASE WHEN m = 16 THEN 'en' ELSE 'zh-CN' END) || "
    "'\",\"contract_version\":\"v1\"' || (CASE WHEN m = 4 THEN ',\"note\":\"x\"' ELSE '' END) || '}' || "
    "(CASE WHEN m = 28 THEN ' extra' ELSE '' END) END",
)
ARMS = {"control": "ev % 41", "treatment": "ev % 37"}

GOLD_COLUMNS = ("id", "ordinal", "split", "input_text", "gold")
SOURCE_ID = ("source_id", "'fam-' || kind || '-' || CAST(k AS STRING)")


def add(df: DataFrame, exprs) -> DataFrame:
    """One projection per expression group; later groups may use earlier names."""
    names = {name for name, _ in exprs}
    keep = [f"`{c}`" for c in df.columns if c not in names]
    return df.selectExpr(*keep, *[f"{sql} AS {name}" for name, sql in exprs])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row group holds many events, and each becomes several long texts: deal the narrow columns out first
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id").repartition(parts, "event_id")
    df = df.selectExpr(*[f"{sql} AS {name}" for name, sql in BASE])
    df = add(df, PARTS[:7])
    df = add(df, PARTS[7:])
    df = add(df, GOLD[:1])
    df = add(df, GOLD[1:])
    return add(df, [GOLD_TAIL])


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ordinal, split, input_text, gold (JSON text), source_id."""
    df = add(_parts(spark, sf_dir), [SOURCE_ID])
    return df.select(*GOLD_COLUMNS, "source_id")


def predictions(spark: SparkSession, sf_dir: str, arms=tuple(ARMS)) -> DataFrame:
    """Tall table arm, id, ordinal, raw; an absent prediction has no row."""
    pairs = ", ".join(f"struct('{arm}' AS arm, CAST({ARMS[arm]} AS INT) AS m)" for arm in arms)
    df = _parts(spark, sf_dir).selectExpr("*", f"explode(array({pairs})) AS am")
    df = df.selectExpr("*", "am.arm AS arm", "am.m AS m").drop("am")
    df = add(add(df, PREDICTION), [PREDICTION_TEXT])
    return df.where("raw IS NOT NULL").select("arm", "id", "ordinal", "raw")


def _cte(exprs, source: str, keep: str = "*") -> str:
    names = ", ".join(name for name, _ in exprs)
    del names
    cols = ", ".join(f"{sql} AS {name}" for name, sql in exprs)
    return f"SELECT {keep}, {cols} FROM {source}" if keep else f"SELECT {cols} FROM {source}"


def sql_prelude() -> str:
    """DuckDB CTEs b0..gold_rows and predictions holding the same derivation."""
    parts = [
        f"b0 AS ({_cte(BASE, 'events', '')})",
        f"b1 AS ({_cte(PARTS[:7], 'b0')})",
        f"b2 AS ({_cte(PARTS[7:], 'b1')})",
        f"b3 AS ({_cte(GOLD[:1], 'b2')})",
        f"b4 AS ({_cte(GOLD[1:], 'b3')})",
        f"b5 AS (SELECT * REPLACE ({GOLD_TAIL[1]} AS gold) FROM b4)",
        f"gold_rows AS (SELECT id, ordinal, split, input_text, gold, {SOURCE_ID[1]} AS source_id FROM b5)",
    ]
    arm_sql = []
    for arm, m in ARMS.items():
        parts.append(f"{arm}_0 AS (SELECT *, {m} AS m FROM b5)")
        parts.append(f"{arm}_1 AS ({_cte(PREDICTION, arm + '_0')})")
        arm_sql.append(f"SELECT '{arm}' AS arm, id, ordinal, {PREDICTION_TEXT[1]} AS raw FROM {arm}_1")
    parts.append("predictions AS (SELECT * FROM (" + " UNION ALL ".join(arm_sql) + ") WHERE raw IS NOT NULL)")
    return ",\n".join(parts)
