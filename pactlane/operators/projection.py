"""Core projection of the contract: renderer, round trip, projection metrics and failure shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.functions import constants as C
from pactlane.functions import text as T
from pactlane.functions.contract import fields_equal
from pactlane.operators.common import count_if, flag, rate
from pactlane.operators.curate import render_contract, slot_json


def core(c: Column) -> Column:
    """The five core fields."""
    return F.struct(*[c[f].alias(f) for f in ("task_type", "route", "safety_allow", "safety_reason", "confirmation_required")], c["c_slots"].alias("slots"))


def core_valid(c: Column, fields: Column) -> Column:
    """Exactly the five core fields, typed."""
    return F.coalesce(
        (F.array_sort(fields) == F.array(*[F.lit(f) for f in sorted(C.CORE_FIELDS)]))
        & c["task_type"].isin(*C.TASK_TYPES) & c["route"].isin(*C.ROUTES) & c["safety_allow"].isNotNull()
        & (T.strip_ws(c["safety_reason"]) != "") & c["confirmation_required"].isNotNull() & c["slot_keys"].isNotNull(),
        F.lit(False),
    )


def render(c: Column) -> Column:
    """(supported, reason, command) display text by task and route."""
    text = lambda k: F.when(
        F.element_at(c["slot_types"], k) != "NULL", F.nullif(T.strip_ws(F.element_at(c["slot_str"], k)), F.lit(""))
    )
    is_ = lambda task: (c["task_type"] == task) & (c["route"] == C.TASK_RULES[task][0])

    def simple(task: str, key: str, prefix: str) -> Column:
        return F.when(text(key).isNull(), _out(False, f"missing_{key}_slot", F.lit(None))).otherwise(
            _out(True, "supported", F.concat(F.lit(prefix), text(key)))
        )

    value = F.coalesce(F.concat(F.lit("为"), text("value")), F.lit(""))
    confirm = F.when(c["confirmation_required"], F.lit("并确认")).otherwise(F.lit(""))
    form = F.when(text("field").isNull(), _out(False, "missing_field_slot", F.lit(None))).otherwise(
        _out(True, "supported", F.concat(F.lit("填写"), text("field"), value, confirm))
    )
    return (
        F.when(is_("search"), simple("search", "query", "搜索"))
        .when(is_("navigate"), simple("navigate", "url", "打开"))
        .when(is_("extract"), simple("extract", "target", "提取"))
        .when(is_("form_fill"), form)
        .when(is_("clarify"), _out(True, "supported", F.concat(F.lit("请求澄清"), F.coalesce(text("ambiguity"), F.lit("目标")))))
        .when(is_("blocked"), _out(True, "supported", F.concat(F.lit("拒绝"), F.coalesce(text("reason"), T.strip_ws(c["safety_reason"])))))
        .otherwise(_out(False, "unsupported_task_route", F.lit(None)))
    )


def _out(supported: bool, reason: str, command: Column) -> Column:
    return F.struct(F.lit(supported).alias("supported"), F.lit(reason).alias("reason"), command.cast("string").alias("command"))


def records(layered: DataFrame) -> DataFrame:
    """Row-level projection flags and failure class per arm."""
    g, p, ok = F.col("g"), F.col("p"), F.col("schema_valid")
    eq = {path: fields_equal(g, p, path) for path in C.FIELD_PATHS}
    diff = lambda *paths: _any([~eq[x] for x in paths])
    slot, route_task, both = diff("slots"), diff("route", "task_type"), ~eq["route"] & ~eq["task_type"]
    safety = diff("safety.allow", "safety.reason", "confirmation_required")
    command, meta = diff("normalized_command"), diff("language", "contract_version")
    category = (
        F.when(~ok, F.lit("INVALID_OR_UNPARSEABLE"))
        .when(~slot & ~route_task & ~safety & ~command & ~meta, F.lit("EXACT_MATCH"))
        .when(~slot & ~route_task & ~safety & command & ~meta, F.lit("NORMALIZED_COMMAND_ONLY"))
        .when(~slot & ~route_task & ~safety & ~command, F.lit("METADATA_ONLY"))
        .when(~slot & ~route_task & ~safety, F.lit("DERIVED_FIELD_ONLY"))
        .when(both & ~safety, F.lit("CORE_ROUTE_TASK_FAILURE"))
        .when(slot & ~route_task & ~safety, F.lit("CORE_SLOT_FAILURE"))
        .when(route_task & ~slot & ~safety, F.lit("CORE_ROUTE_TASK_FAILURE"))
        .when(safety & ~slot & ~route_task, F.lit("CORE_SAFETY_CONFIRMATION_FAILURE"))
        .otherwise(F.lit("MIXED_CORE_FAILURE"))
    )
    df = layered.withColumn("r", F.when(ok, render(p)))
    no_command = _all([eq[x] for x in C.FIELD_PATHS if x != "normalized_command"])
    core_same = _all([eq[x] for x in C.FIELD_PATHS[:6]])
    cover = F.col("executable_cover")
    base = (F.col("task_ok") == 1) & (F.col("route_ok") == 1) & (F.col("confirm_ok") == 1)
    return df.withColumn("executable_cover", _slots_cover()).select(
        "arm", "id", "ordinal", "split", g["task_type"].alias("task_type"), flag(ok).alias("v2_schema_valid"),
        flag(ok & (F.col("same_ok") == 1)).alias("l0_exact"), flag(ok & no_command).alias("l1_exact"), flag(ok & core_same).alias("l2_exact"),
        flag(base & (F.col("risk_ok") == 1) & cover).alias("v1_executable"),
        flag(base & eq["safety.allow"] & eq["safety.reason"] & cover).alias("v2_executable"),
        F.coalesce(F.col("r.supported").cast("int"), F.lit(0)).alias("renderer_supported"),
        F.coalesce("r.reason", F.lit("invalid_or_unparseable")).alias("renderer_reason"),
        category.alias("category"),
    )


def _slots_cover() -> Column:
    from pactlane.operators.evaluate import last_value

    return F.forall(
        "g_norm", lambda e: F.coalesce(last_value(F.col("p_norm"), e["k"]) == last_value(F.col("g_norm"), e["k"]), F.lit(False))
    )


def _any(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _all(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def metrics(recs: DataFrame, by: list[str]) -> DataFrame:
    """Exact and executable rates at the three levels with counterfactual deltas."""
    avg = lambda c: F.sum(c) / F.count("*")
    agg = recs.groupBy(*by).agg(
        F.count("*").alias("row_count"), avg("l0_exact").alias("l0_exact_rate"), avg("l1_exact").alias("l1_exact_rate"), avg("l2_exact").alias("l2_exact_rate"),
        avg("v2_schema_valid").alias("v2_schema_validity"), avg("v1_executable").alias("v1_executable_rate"), avg("v2_executable").alias("v2_executable_rate"),
        avg("renderer_supported").alias("renderer_supported_rate"),
    )
    d = lambda a, b: F.round(F.col(a) - F.col(b), 9)
    return agg.select(
        "*", d("l1_exact_rate", "l0_exact_rate").alias("l1_minus_l0"), d("l2_exact_rate", "l0_exact_rate").alias("l2_minus_l0"),
        d("l2_exact_rate", "l1_exact_rate").alias("l2_minus_l1"), d("v2_executable_rate", "v1_executable_rate").alias("v2_minus_v1_executable"),
    )


def failure_contribution(recs: DataFrame) -> DataFrame:
    """Failure classes per arm and split (and over everything) with shares and what the core removes."""
    fails = recs.where("l0_exact = 0")
    cells = fails.groupingSets([["arm", "split", "category"], ["category"]], "arm", "split", "category").agg(
        F.count("*").alias("failures"), F.sum("l2_exact").cast("bigint").alias("eliminated")
    )
    total = cells.groupBy("arm", "split").agg(F.sum("failures").alias("total"))
    joined = cells.alias("a").join(
        total.alias("b"), F.col("a.arm").eqNullSafe(F.col("b.arm")) & F.col("a.split").eqNullSafe(F.col("b.split"))
    )
    return joined.select(
        F.coalesce("a.arm", F.lit("all")).alias("arm"), F.coalesce("a.split", F.lit("all")).alias("split"), "category", "failures", "eliminated",
        (F.col("failures") / F.col("total")).alias("share"),
    )


def renderer_coverage(recs: DataFrame) -> DataFrame:
    return recs.groupBy("arm", "renderer_reason").agg(F.count("*").alias("row_count"), count_if(F.col("renderer_supported") == 1).alias("supported"))


def round_trip(parsed: DataFrame) -> DataFrame:
    """Rebuild each contract from core plus preserved display fields and compare per field.

    Input: (source_kind, c parsed contract, raw, schema_valid).
    """
    c = F.col("c")
    rebuilt = render_contract(c, slot_json(c))
    df = parsed.withColumn("rebuilt", F.when(F.col("schema_valid"), rebuilt))
    from pactlane.functions.contract import parse_contract

    df = parse_contract(df, "rebuilt", "b")
    b = F.col("b")
    ok = F.col("schema_valid")
    same = {path: ok & fields_equal(c, b, path) for path in C.FIELD_PATHS}
    return df.select(
        "source_kind", flag(ok).alias("v1_valid"), flag(_all(list(same.values()))).alias("roundtrip_exact"),
        flag(same["safety.allow"] & same["safety.reason"]).alias("safety_preserved"),
        flag(same["confirmation_required"]).alias("confirmation_preserved"), flag(same["slots"]).alias("slots_preserved"),
        flag(same["normalized_command"]).alias("command_preserved"), flag(same["language"]).alias("language_preserved"),
        flag(same["contract_version"]).alias("version_preserved"), flag(ok & render(c)["supported"]).alias("display_supported"), "rebuilt",
    )


def compatibility(trips: DataFrame) -> DataFrame:
    """Preservation rates per source kind."""
    cols = [c for c in trips.columns if c not in ("source_kind", "rebuilt")]
    return trips.groupBy("source_kind").agg(F.count("*").alias("contracts"), *[rate(F.sum(c), F.count("*")).alias(f"{c}_rate") for c in cols])
