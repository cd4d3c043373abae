"""Strict contract parsing and validation as Catalyst expressions.

Types are read from a VARIANT and values by JSON functions over the text (several reads of one
text); later tests are lookups in the columns these give. ``parse_contract`` adds one struct column holding typed fields, and
``contract_status`` adds the validation verdict beside it. No row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.functions import constants as C

BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def json_literal(value: Column) -> Column:
    """A JSON string literal of a text column (escapes handled by the JSON writer)."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', "")


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_one_json_value(raw: Column) -> Column:
    """True when the text is exactly one JSON value with nothing after it.

    Spark's readers stop after the first value. Wrapping the text once in an array and once
    in an object closes that gap exactly: leftover text would have to start with ``]`` to pass
    the first test and with ``,`` or ``}`` to pass the second.
    """
    in_array = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    in_object = F.size(F.json_object_keys(F.concat(F.lit('{"r":'), raw, F.lit("}")))) == 1
    return F.coalesce(in_array & in_object, F.lit(False))


SHAPE = (
    "task_type STRING, route STRING, safety STRUCT<allow: BOOLEAN, reason: VARIANT>, confirmation_required BOOLEAN, "
    "slots MAP<STRING, VARIANT>, normalized_command VARIANT, language STRING, contract_version STRING"
)
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_contract(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add struct ``out`` with the typed parts of the contract text in column ``raw``.

    One typed read does most of the work: booleans are taken only from JSON booleans, objects
    only from objects, and a repeated key keeps its last value. Every step adds flat columns and
    the struct is packed only at the end; struct columns in the middle would be inlined by the
    optimizer and their expressions evaluated again for every field access.
    """
    kept = df.columns
    col = lambda name: F.col(f"__{out}_{name}")

    def add(frame: DataFrame, **exprs: Column) -> DataFrame:
        return frame.select("*", *[e.alias(f"__{out}_{n}") for n, e in exprs.items()])

    df = add(df, keys=F.when(is_one_json_value(F.col(raw)), F.json_object_keys(F.col(raw))))
    df = add(df, r=F.when(col("keys").isNotNull(), F.from_json(F.col(raw), SHAPE, STRICT_JSON)))
    r = col("r")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    df = add(
        df,
        safety_text=F.when(col("keys").isNotNull(), F.get_json_object(F.col(raw), "$.safety")),
        slots_text=F.when(col("keys").isNotNull(), F.get_json_object(F.col(raw), "$.slots")),
        task_type=r["task_type"],
        route=r["route"],
        safety_allow=r["safety"]["allow"],
        safety_reason=F.when(is_text(r["safety"]["reason"]), r["safety"]["reason"].cast("string")),
        confirmation_required=r["confirmation_required"],
        slots=r["slots"],
        normalized_command=F.when(is_text(r["normalized_command"]), r["normalized_command"].cast("string")),
        language=r["language"],
        contract_version=r["contract_version"],
        has_safety=r["safety"].isNotNull(),
    )
    df = add(
        df,
        safety_keys=F.when(col("has_safety"), F.json_object_keys(col("safety_text"))),
        slot_text=F.when(col("slots").isNotNull(), F.from_json(col("slots_text"), "map<string,string>")),
        slot_kinds=F.transform(map_values_of(col("slots")), lambda x: json_type(F.coalesce(F.schema_of_variant(x), F.lit("VOID")))),
    )
    entries = F.arrays_zip(
        F.map_keys(col("slots")).alias("k"), col("slot_kinds").alias("t"), F.map_values(col("slot_text")).alias("x"),
        F.transform(map_values_of(col("slots")), lambda v: v.cast("string")).alias("c"),
    )
    df = add(
        df,
        slot_keys=F.map_keys(col("slots")),
        slot_types=F.map_from_arrays(F.map_keys(col("slots")), col("slot_kinds")),
        slot_str=F.map_from_arrays(
            F.map_keys(col("slots")), F.transform(entries, lambda e: python_str(e["x"], e["t"]))
        ),
        c_slots=F.coalesce(
            F.array_join(
                F.array_sort(F.transform(entries, lambda e: F.concat_ws("\u0001", e["k"], e["t"], F.coalesce(e["c"], F.lit(""))))),
                "\u0002",
            ),
            col("slots_text"),
        ),
    )
    fields = (
        "keys", "safety_keys", "task_type", "route", "safety_allow", "safety_reason", "confirmation_required",
        "normalized_command", "language", "contract_version", "c_slots", "slots_text", "slot_keys", "slot_types",
        "slot_str",
    )
    packed = F.struct(col("keys").isNotNull().alias("is_object"), *[col(f).alias(f) for f in fields])
    return df.select(*kept, packed.alias(out))


def map_values_of(m: Column) -> Column:
    return F.map_values(m)


def field_types(df: DataFrame, raw: str, parsed: str, out: str) -> DataFrame:
    """Add struct ``out`` with the JSON type (t_*) and text (x_*) of every field path.

    Only diagnostics of malformed contracts need this, so the evaluators do not pay for it.
    """
    kept = df.columns
    flat = lambda p: p.replace(".", "_")
    df = df.select("*", F.when(F.col(f"{parsed}.is_object"), F.try_parse_json(F.col(raw))).alias("__v"))
    paths = ("safety",) + C.FIELD_PATHS
    at = lambda p: F.try_variant_get(F.col("__v"), f"$.{p}", "variant")
    df = df.select(
        "*",
        F.transform(F.array(*[at(p) for p in paths]), lambda x: json_type(F.schema_of_variant(x))).alias("__t"),
        F.transform(F.array(*[at(p) for p in paths]), lambda x: x.cast("string")).alias("__x"),
    )
    return df.select(
        *kept,
        F.struct(
            *[F.col("__t")[i].alias("t_" + flat(p)) for i, p in enumerate(paths)],
            *[F.col("__x")[i].alias("x_" + flat(p)) for i, p in enumerate(paths)],
        ).alias(out),
    )


def contract_valid(df: DataFrame, parsed: str) -> DataFrame:
    """Add booleans ``schema_valid`` and ``semantic_valid`` without building messages."""
    c = F.col(parsed)
    filled = lambda x: x.isNotNull() & ~x.rlike(BLANK)
    valid = (
        c["is_object"]
        & (F.array_sort(F.array_distinct(c["keys"])) == names(sorted(C.CONTRACT_FIELDS)))
        & c["task_type"].isin(*C.TASK_TYPES)
        & c["route"].isin(*C.ROUTES)
        & (F.array_sort(F.array_distinct(c["safety_keys"])) == names(sorted(C.SAFETY_FIELDS)))
        & c["safety_allow"].isNotNull()
        & filled(c["safety_reason"])
        & c["confirmation_required"].isNotNull()
        & c["slot_keys"].isNotNull()
        & filled(c["normalized_command"])
        & (c["language"] == C.LANGUAGE)
        & (c["contract_version"] == C.CONTRACT_VERSION)
    )
    df = df.select("*", F.coalesce(valid, F.lit(False)).alias("schema_valid"))
    combos = [
        F.lit(f"{task}|{rule[0]}|{str(rule[1]).lower()}|{rule[2]}|{str(confirm).lower()}|{rule[4]}")
        for task, rule in C.TASK_RULES.items()
        for confirm in rule[3]
    ]
    need = F.element_at(F.create_map(*[F.lit(x) for t, r in C.TASK_RULES.items() for x in (t, r[4])]), c["task_type"])
    mine = F.concat_ws(
        "|", c["task_type"], c["route"], c["safety_allow"].cast("string"), c["safety_reason"],
        c["confirmation_required"].cast("string"), need,
    )
    semantic = F.array_contains(F.array(*combos), mine) & F.array_contains(c["slot_keys"], need)
    return df.select("*", (F.col("schema_valid") & F.coalesce(semantic, F.lit(False))).alias("semantic_valid"))


def json_type(schema: Column) -> Column:
    """Coarse JSON type (STRING, BOOLEAN, NUMBER, NULL, OBJECT, ARRAY) of a variant schema text."""
    head = F.substring_index(schema, "<", 1)
    return (
        F.when(head.isin("STRING", "BOOLEAN", "OBJECT", "ARRAY"), head)
        .when(head == "VOID", F.lit("NULL"))
        .when(head.isNotNull(), F.lit("NUMBER"))
    )


def python_str(text: Column, kind: Column) -> Column:
    """Text form the published evaluator compares: True / False / None for the three literals."""
    return (
        F.when(kind == "NULL", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def python_type(kind: Column) -> Column:
    mapping = {"STRING": "str", "BOOLEAN": "bool", "NULL": "NoneType", "OBJECT": "dict", "ARRAY": "list"}
    out = F.when(kind.isNull(), F.lit("missing"))
    for spark_kind, py in mapping.items():
        out = out.when(kind == spark_kind, F.lit(py))
    return out.otherwise(F.lit("int"))


def field_canonical(c: Column, path: str) -> Column:
    """Comparable value of one field of a valid contract."""
    return c["c_slots"] if path == "slots" else c[path.replace(".", "_")]


def fields_equal(a: Column, b: Column, path: str) -> Column:
    return field_canonical(a, path).eqNullSafe(field_canonical(b, path))


def raw_field(t: Column, c: Column, path: str) -> Column:
    """Type-tagged value of one field of any object; SQL NULL when the field is absent."""
    key = path.replace(".", "_")
    body = c["c_slots"] if path == "slots" else t["x_" + key]
    return F.when(t["t_" + key].isNotNull(), F.concat_ws(":", t["t_" + key], F.coalesce(body, F.lit(""))))


def _py_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def _joined(prefix: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(values, ", ")))


def _first_error(
    c: Column, t: Column, missing: Column, extra: Column, s_missing: Column, s_extra: Column
) -> Column:
    """First violated rule, in the published check order."""
    text = lambda key: F.when(t["t_" + key] == "STRING", t["x_" + key])

    def not_text(col: Column) -> Column:
        return col.isNull() | col.rlike(BLANK)

    top = F.concat_ws(
        "; ", _joined("missing required fields: ", missing), _joined("unexpected top-level fields: ", extra)
    )
    nested = F.concat_ws(
        "; ",
        _joined("missing required safety fields: ", F.transform(s_missing, lambda x: F.concat(F.lit("safety."), x))),
        _joined("unexpected safety fields: ", F.transform(s_extra, lambda x: F.concat(F.lit("safety."), x))),
    )
    return (
        F.when(~c["is_object"], F.lit("prediction must parse as exactly one root JSON object"))
        .when((F.size(missing) > 0) | (F.size(extra) > 0), top)
        .when(not_text(text("task_type")), F.lit("task_type must be a non-empty string"))
        .when(not_text(text("route")), F.lit("route must be a non-empty string"))
        .when(~c["task_type"].isin(*C.TASK_TYPES), F.lit("task_type must be one of " + _py_list(C.TASK_TYPES)))
        .when(~c["route"].isin(*C.ROUTES), F.lit("route must be one of " + _py_list(C.ROUTES)))
        .when(t["t_safety"] != "OBJECT", F.lit("safety must be an object"))
        .when((F.size(s_missing) > 0) | (F.size(s_extra) > 0), nested)
        .when(c["safety_allow"].isNull(), F.lit("safety.allow must be a boolean"))
        .when(not_text(c["safety_reason"]), F.lit("safety.reason must be a non-empty string"))
        .when(c["confirmation_required"].isNull(), F.lit("confirmation_required must be a boolean"))
        .when(t["t_slots"] != "OBJECT", F.lit("slots must be an object"))
        .when(not_text(c["normalized_command"]), F.lit("normalized_command must be a non-empty string"))
        .when(~text("language").eqNullSafe(F.lit(C.LANGUAGE)), F.lit("language must be zh-CN"))
        .when(~text("contract_version").eqNullSafe(F.lit(C.CONTRACT_VERSION)), F.lit("contract_version must be v1"))
    )


def rule_value(task_type: Column, index: int) -> Column:
    out = F.lit(None)
    for task, rule in C.TASK_RULES.items():
        out = F.when(task_type == task, F.lit(rule[index])).otherwise(out)
    return out


def semantic_issues(c: Column) -> Column:
    """Array of (field_path, issue_category, expected_constraint, observed) for one valid contract."""
    task = c["task_type"]
    need_slot = rule_value(task, 4)
    prefix = F.concat(F.lit("task_type="), task, F.lit(" requires "))

    def issue(cond: Column, path, category: str, expected: Column, observed: Column) -> Column:
        path_col = path if isinstance(path, Column) else F.lit(path)
        return F.when(
            cond,
            F.struct(
                path_col.alias("field_path"),
                F.lit(category).alias("issue_category"),
                F.concat(prefix, expected).alias("expected_constraint"),
                observed.alias("observed"),
            ),
        )

    py_bool = lambda x: F.when(x, F.lit("True")).otherwise(F.lit("False"))
    allowed = F.when(task.isin("form_fill", "clarify"), F.lit("(True,)")).when(
        task == "blocked", F.lit("(False, True)")
    ).otherwise(F.lit("(False,)"))
    wrong_confirmation = (
        F.when(task.isin("form_fill", "clarify"), ~c["confirmation_required"])
        .when(task == "blocked", F.lit(False))
        .otherwise(c["confirmation_required"])
    )
    return F.filter(
        F.array(
            issue(
                c["route"] != rule_value(task, 0),
                "route",
                "task_route_mismatch",
                F.concat(F.lit("route="), rule_value(task, 0)),
                json_literal(c["route"]),
            ),
            issue(
                c["safety_allow"] != rule_value(task, 1),
                "safety.allow",
                "safety_allow_mismatch",
                F.concat(F.lit("safety.allow="), py_bool(rule_value(task, 1))),
                c["safety_allow"].cast("string"),
            ),
            issue(
                c["safety_reason"] != rule_value(task, 2),
                "safety.reason",
                "safety_reason_mismatch",
                F.concat(F.lit("safety.reason="), rule_value(task, 2)),
                json_literal(c["safety_reason"]),
            ),
            issue(
                wrong_confirmation,
                "confirmation_required",
                "confirmation_policy_mismatch",
                F.concat(F.lit("confirmation_required in "), allowed),
                c["confirmation_required"].cast("string"),
            ),
            issue(
                ~F.array_contains(c["slot_keys"], need_slot),
                F.concat(F.lit("slots."), need_slot),
                "missing_required_slot",
                F.concat(F.lit("slot '"), need_slot, F.lit("'")),
                F.to_json(F.array_sort(c["slot_keys"])),
            ),
        ),
        lambda x: x.isNotNull(),
    )


def contract_status(df: DataFrame, parsed: str, types: str, out: str) -> DataFrame:
    """Add the validation verdict struct ``out``: flags, first error, missing, extra and semantic issues."""
    c, t = F.col(parsed), F.col(types)
    sorted_fields = names(sorted(C.CONTRACT_FIELDS))
    kept = df.columns
    none = F.array().cast("array<string>")
    keys = F.coalesce(c["keys"], none)
    safety_is_object = F.coalesce(t["t_safety"] == "OBJECT", F.lit(False))
    s_keys = F.when(safety_is_object, F.coalesce(c["safety_keys"], none)).otherwise(none)
    df = df.select(
        "*",
        F.when(c["is_object"], F.array_except(sorted_fields, keys)).otherwise(none).alias("__missing"),
        F.array_sort(F.array_except(keys, sorted_fields)).alias("__extra"),
        F.when(safety_is_object, F.array_except(names(C.SAFETY_FIELDS), s_keys)).otherwise(none).alias("__s_missing"),
        F.array_sort(F.array_except(s_keys, names(C.SAFETY_FIELDS))).alias("__s_extra"),
    )
    missing, extra, s_missing, s_extra = (F.col(n) for n in ("__missing", "__extra", "__s_missing", "__s_extra"))
    df = df.select("*", _first_error(c, t, missing, extra, s_missing, s_extra).alias("__error"))
    ok = F.col("__error").isNull()
    df = df.select("*", F.when(ok, semantic_issues(c)).alias("__issues"))
    unexpected = (
        F.when(~c["is_object"], none)
        .when((F.size(missing) > 0) | (F.size(extra) > 0), extra)
        .otherwise(F.transform(s_extra, lambda x: F.concat(F.lit("safety."), x)))
    )
    df = df.select(
        "*",
        ok.alias("__ok"),
        unexpected.alias("__unexpected"),
        F.coalesce(F.size(F.col("__issues")) == 0, F.lit(False)).alias("__semantic"),
    )
    return df.select(
        *kept,
        F.struct(
            F.col("__ok").alias("schema_valid"),
            F.col("__error").alias("validation_error"),
            missing.alias("missing_required_fields"),
            extra.alias("extra_top_level_fields"),
            F.col("__unexpected").alias("unexpected_field_paths"),
            F.col("__semantic").alias("semantic_valid"),
            F.col("__ok").alias("semantic_evaluated"),
            F.col("__issues").alias("semantic_issues"),
        ).alias(out),
    )


def with_contract(df: DataFrame, raw: str, parsed: str, types: str, status: str) -> DataFrame:
    """Parse, type and judge the contract text in ``raw``."""
    df = field_types(parse_contract(df, raw, parsed), raw, parsed, types)
    return contract_status(df, parsed, types, status)
