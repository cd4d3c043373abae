"""Raw model outputs: parse status, schema guard and decode symptoms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.functions import constants as C
from pactlane.functions import text as T
from pactlane.functions.contract import is_one_json_value, with_contract
from pactlane.operators.common import count_if


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def fragment(text: Column) -> Column:
    """Text between the first ``{`` and the last ``}``, NULL when there is none."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & text.contains("}") & (last > first), text.substr(first, last - first + 1))


def parse_status(raw: Column) -> Column:
    text = T.strip_ws(T.redact(raw))
    part = fragment(text)
    is_object = lambda t: F.json_object_keys(t).isNotNull()
    return (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(text == "", F.lit("empty"))
        .when(is_one_json_value(text) & is_object(text), F.lit("json_object"))
        .when(is_one_json_value(text), F.lit("json_non_object"))
        .when(part.isNotNull() & is_one_json_value(part) & is_object(part), F.lit("json_fragment_object"))
        .otherwise(F.lit("non_json"))
    )


def attempt(raw: Column) -> Column:
    """Status, hash, length and 240-character ends of one redacted output."""
    clean = T.redact(raw)
    return F.struct(
        parse_status(raw).alias("parse_status"), F.sha2(clean, 256).alias("sha256"), F.length(clean).alias("chars"),
        F.left(clean, F.lit(240)).alias("prefix"), F.right(clean, F.lit(240)).alias("suffix"), (clean != raw).alias("sanitized"),
    )


def strict_payload(raw: Column) -> Column:
    """The text itself when it is one JSON value, else its redacted form."""
    return once(T.strip_ws(raw), lambda text: F.when(is_one_json_value(text), text).otherwise(T.redact(text)))


def _whole_or_part(raw: Column, taken: Callable[[Column], Column]) -> Column:
    part_or_redacted = lambda text: once(taken(text), lambda part: F.when(is_one_json_value(part), part).otherwise(T.redact(text)))
    return once(T.strip_ws(raw), lambda text: F.when(is_one_json_value(text), text).otherwise(part_or_redacted(text)))


def fragment_payload(raw: Column) -> Column:
    """One JSON value, else the braces fragment, else the redacted text."""
    return _whole_or_part(raw, fragment)


def balanced_object(text: Column) -> Column:
    """The first object of a text, from its opening brace to the one that closes it; braces inside JSON
    strings do not count. NULL without a closed object. One pass over the characters."""
    begin = F.instr(text, "{")
    body = F.substring(text, begin, F.length(text))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("string"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(s["string"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        closed = (s["end"] == 0) & ~s["string"] & (c == "}") & (depth == 0)
        return F.struct(
            (s["at"] + 1).alias("at"), depth.alias("depth"), F.when(quote, ~s["string"]).otherwise(s["string"]).alias("string"),
            (s["string"] & (c == "\\") & ~s["escaped"]).alias("escaped"), F.when(closed, s["at"] + 1).otherwise(s["end"]).alias("end"),
        )

    end = F.when(begin > 0, F.aggregate(F.split(body, ""), start, step, lambda s: s["end"]))
    return once(end, lambda end: F.when(end > 0, F.substring(body, F.lit(1), end)))


def balanced_payload(raw: Column) -> Column:
    """One JSON value, else the first closed object, else the redacted text."""
    return _whole_or_part(raw, balanced_object)


def schema_guard(df: DataFrame, raw: str, retry: str) -> DataFrame:
    """Choose the raw output if valid, else the retry if valid, else none."""
    kept = df.columns
    df = with_contract(df, raw, "__a", "__at", "__as")
    df = with_contract(df, retry, "__b", "__bt", "__bs")
    a, b = F.col("__as"), F.col("__bs")
    retried = F.col(retry).isNotNull()
    source = F.when(a["schema_valid"], F.lit("raw_attempt")).when(retried & b["schema_valid"], F.lit("retry_attempt")).otherwise(F.lit("none"))
    return df.select(
        *kept,
        F.struct(
            a["schema_valid"].alias("raw_valid"), a["validation_error"].alias("raw_error"), a["missing_required_fields"].alias("raw_missing"),
            F.when(retried, b["schema_valid"]).alias("retry_valid"), F.when(retried, b["validation_error"]).alias("retry_error"),
            (source != "none").alias("validated"), source.alias("validated_source"),
        ).alias("guard"),
    )


def _first_value(text: Column, field: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f'"{field}"\\s*:\\s*"([^"]+)"'), F.lit(1))


def legacy_alias(value: Column) -> Column:
    known = value.isin(*C.TASK_TYPES)
    alias = (
        value.isin(*C.ROUTES) | value.isin("search_web", "open_url", "query_weather_request") | value.rlike("^(query_|search_|open_)")
        | value.rlike("(_request|_action)$")
    )
    return ~known & alias


def decode_symptoms(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Parse-status counts with alias, path-like route and wrapper symptoms."""
    text = T.redact(F.col(column))
    stripped = T.strip_ws(text)
    status = parse_status(F.col(column))
    wrapper = status.startswith("json_fragment") | ((stripped != "") & (~stripped.startswith("{") | ~stripped.endswith("}") | stripped.contains("```")))
    rows = df.where(F.col(column).isNotNull()).select(
        *by, status.alias("parse_status"), F.exists(_first_value(text, "task_type"), legacy_alias).alias("alias"),
        F.exists(_first_value(text, "route"), T.path_like).alias("path_route"), wrapper.alias("wrapper"),
    )
    return rows.groupBy(*by, "parse_status").agg(
        F.count("*").alias("attempts"), count_if(F.col("alias")).alias("legacy_alias_count"), count_if(F.col("path_route")).alias("path_like_route_count"),
        count_if(F.col("wrapper")).alias("wrapper_count"),
    )
