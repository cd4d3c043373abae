"""Field-level diagnoses: schema issues, alignment mismatches, residual families and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.functions import constants as C
from pactlane.functions import text as T
from pactlane.functions.contract import fields_equal, is_one_json_value, raw_field
from pactlane.operators.common import count_if, examples, first_k, ranked_all
from pactlane.operators.evaluate import permissive_valid

KEEP = ["arm", "id", "ordinal", "split", "source_id"]
GOLD_KIND = {"safety.allow": "BOOLEAN", "confirmation_required": "BOOLEAN", "slots": "OBJECT"}


def gold_field(path: str) -> Column:
    value = F.col("g.c_slots") if path == "slots" else F.col("g." + path.replace(".", "_")).cast("string")
    return F.concat_ws(":", F.lit(GOLD_KIND.get(path, "STRING")), value)


def _kind(tagged: Column) -> Column:
    return F.substring_index(tagged, ":", 1)


def _body(path: str, tagged: Column) -> Column:
    return F.substring(tagged, F.locate(":", tagged) + 1, F.length(tagged))


def gold_family() -> Column:
    g = F.col("g")
    return T.family_key(g["task_type"], g["route"], g["safety_reason"], g["confirmation_required"], g["slot_keys"])


def alignment(typed: DataFrame) -> DataFrame:
    """One row per unequal field path of the raw prediction object."""
    g, p, t = F.col("g"), F.col("p"), F.col("t")

    def entry(path: str) -> Column:
        gold, pred = gold_field(path), raw_field(t, p, path)
        category = (
            F.when(pred.isNull(), F.lit("missing_prediction_field"))
            .when(_kind(gold) != _kind(pred), F.lit("type_mismatch"))
            .otherwise(F.lit("value_mismatch"))
        )
        body = lambda col: g["slots_text"] if path == "slots" and col is gold else (
            p["slots_text"] if path == "slots" else _body(path, col)
        )
        return F.when(
            ~gold.eqNullSafe(pred),
            F.struct(
                F.lit(path).alias("field_path"),
                category.alias("mismatch_category"),
                T.value_summary(_kind(gold), body(gold)).alias("gold_value_summary"),
                F.when(pred.isNull(), F.lit("missing"))
                .otherwise(T.value_summary(_kind(pred), body(pred)))
                .alias("prediction_value_summary"),
            ),
        )

    mismatches = F.array_compact(F.array(*[entry(path) for path in C.FIELD_PATHS]))
    return typed.select(
        *KEEP, "schema_valid", "st.missing_required_fields", F.explode(mismatches).alias("m")
    ).select(*KEEP, "schema_valid", "missing_required_fields", "m.*")


def alignment_counts(typed: DataFrame) -> DataFrame:
    return alignment(typed).groupBy("arm", "field_path", "mismatch_category").agg(F.count("*").alias("mismatches"))


def schema_issues(typed: DataFrame) -> DataFrame:
    """One row per schema issue of an invalid prediction."""
    p, t, st = F.col("p"), F.col("t"), F.col("st")

    def issue(cond: Column, path, category: str, expected: str) -> Column:
        path_col = path if isinstance(path, Column) else F.lit(path)
        return F.when(
            cond,
            F.struct(
                path_col.alias("field_path"), F.lit(category).alias("issue_category"), F.lit(expected).alias("expected_constraint")
            ),
        )

    def has(key: str) -> Column:
        return F.array_contains(p["keys"], key)

    def many(values: Column, prefix: str, category: str, expected: str) -> Column:
        return F.transform(
            values,
            lambda x: F.struct(
                F.concat(F.lit(prefix), x).alias("field_path"),
                F.lit(category).alias("issue_category"),
                F.lit(expected).alias("expected_constraint"),
            ),
        )

    empty = lambda key: t["x_" + key].rlike(r"(?U)^[\s\x1c-\x1f]*$")
    safety_object = t["t_safety"] == "OBJECT"
    s_keys = F.coalesce(p["safety_keys"], F.array().cast("array<string>"))
    fixed = F.array_compact(
        F.array(
            issue(has("task_type") & ~F.coalesce((t["t_task_type"] == "STRING") & t["x_task_type"].isin(*C.TASK_TYPES), F.lit(False)),
                  "task_type", "invalid_enum", "must be a known task type"),
            issue(has("route") & ~F.coalesce((t["t_route"] == "STRING") & t["x_route"].isin(*C.ROUTES), F.lit(False)),
                  "route", "invalid_enum", "must be a known route"),
            issue(has("safety") & ~safety_object, "safety", "invalid_type",
                  "must be an object with boolean allow and non-empty string reason"),
            issue(safety_object & t["t_safety_allow"].isNull(), "safety.allow", "missing_required_field", "must be a boolean"),
            issue(safety_object & (t["t_safety_allow"] != "BOOLEAN"), "safety.allow", "invalid_type", "must be a boolean"),
            issue(safety_object & t["t_safety_reason"].isNull(), "safety.reason", "missing_required_field",
                  "must be a non-empty string"),
            issue(safety_object & (t["t_safety_reason"] != "STRING"), "safety.reason", "invalid_type",
                  "must be a non-empty string"),
            issue(safety_object & (t["t_safety_reason"] == "STRING") & empty("safety_reason"), "safety.reason",
                  "empty_required_string", "must be a non-empty string"),
            issue(has("confirmation_required") & (t["t_confirmation_required"] != "BOOLEAN"), "confirmation_required",
                  "invalid_type", "must be a boolean"),
            issue(has("slots") & (t["t_slots"] != "OBJECT"), "slots", "invalid_type", "must be an object"),
            issue(has("normalized_command") & (t["t_normalized_command"] != "STRING"), "normalized_command", "invalid_type",
                  "must be a non-empty string"),
            issue((t["t_normalized_command"] == "STRING") & empty("normalized_command"), "normalized_command",
                  "empty_required_string", "must be a non-empty string"),
            issue(has("language") & ~F.coalesce(p["language"] == C.LANGUAGE, F.lit(False)), "language", "invalid_literal", "must be zh-CN"),
            issue(has("contract_version") & ~F.coalesce(p["contract_version"] == C.CONTRACT_VERSION, F.lit(False)),
                  "contract_version", "invalid_literal", "must be v1"),
        )
    )
    object_issues = F.concat(
        many(st["missing_required_fields"], "", "missing_required_field", "this top-level field is required"),
        many(st["extra_top_level_fields"], "", "unexpected_field", "unknown top-level fields are not allowed"),
        F.when(safety_object, many(F.array_sort(F.array_except(s_keys, F.array(F.lit("allow"), F.lit("reason")))), "safety.",
             "unexpected_field", "unknown safety fields are not allowed")).otherwise(F.array().cast("array<struct<field_path:string,issue_category:string,expected_constraint:string>>")),
        fixed,
    )
    root = lambda category, text: F.array(issue(F.lit(True), "$", category, text))
    issues = (
        F.when(F.col("schema_valid"), F.lit(None))
        .when(F.col("raw").isNotNull() & ~is_one_json_value(F.col("raw")), root("invalid_json", "must be a JSON object"))
        .when(~p["is_object"], root("invalid_type", "must be an object"))
        .when(F.size(object_issues) > 0, object_issues)
        .otherwise(root("schema_validation_error", "must satisfy the contract validator"))
    )
    return typed.select(*KEEP, F.explode(issues).alias("i")).select(*KEEP, "i.*")


def schema_issue_counts(typed: DataFrame) -> DataFrame:
    return schema_issues(typed).groupBy("arm", "issue_category", "field_path").agg(F.count("*").alias("issues"))


# ---- residual attribution ------------------------------------------------------------


def _summary(kind: Column, text: Column) -> Column:
    clean = F.left(T.redact(text), F.lit(80))
    return (
        F.when(kind.isNull(), F.lit("missing"))
        .when(kind == "STRING", F.concat(F.lit("string("), F.length(text), F.lit("): "), clean))
        .when(kind == "OBJECT", F.concat(F.lit("object keys: "), F.array_join(F.slice(F.array_sort(F.json_object_keys(text)), 1, 8), ",")))
        .when(kind == "ARRAY", F.concat(F.lit("array("), F.json_array_length(text), F.lit(")")))
        .when(kind == "NULL", F.lit("null"))
        .when(kind == "BOOLEAN", F.concat(F.lit("bool: "), F.initcap(text)))
        .otherwise(F.concat(F.lit("int: "), clean))
    )


def _res(family, path, gold: Column, pred: Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_col(family).alias("family"),
        as_col(path).alias("field_path"),
        gold.alias("gold_value_summary"),
        pred.alias("prediction_value_summary"),
    )


RES_TYPE = "array<struct<family:string,field_path:string,gold_value_summary:string,prediction_value_summary:string>>"
FIELD_FAMILY = {
    "route": "route",
    "task_type": "task_type",
    "normalized_command": "normalized_command",
    "confirmation_required": "confirmation",
    "safety.allow": "risk_level",
    "safety.reason": "risk_level",
    "language": "extra_field",
    "contract_version": "extra_field",
}


def with_residuals(typed: DataFrame) -> DataFrame:
    """Add array ``found`` with the residuals of a prediction; they follow from the two texts alone."""
    g, p, t, st = (F.col(x) for x in ("g", "p", "t", "st"))
    none = F.array().cast(RES_TYPE)
    missing = F.lit("missing")
    g_keys, p_keys = g["slot_keys"], F.coalesce(p["slot_keys"], F.array().cast("array<string>"))
    norm = lambda pairs: F.array_sort(F.array_distinct(F.transform(pairs, lambda e: e["k"])))
    renamed = (F.array_sort(g_keys) != F.array_sort(p_keys)) & (norm(F.col("g_norm")) == norm(F.col("p_norm")))

    def slot(side: Column, key: Column) -> Column:
        kind = F.element_at(side["slot_types"], key)
        return _summary(kind, F.element_at(side["slot_str"], key))

    def per_key(keys: Column, family: str, gold_fn, pred_fn) -> Column:
        return F.transform(
            F.array_sort(keys), lambda k: _res(family, F.concat(F.lit("slots."), k), gold_fn(k), pred_fn(k))
        )

    differs = lambda k: ~(
        F.element_at(g["slot_types"], k).eqNullSafe(F.element_at(p["slot_types"], k))
        & F.element_at(g["slot_str"], k).eqNullSafe(F.element_at(p["slot_str"], k))
    )
    slot_res = F.when(
        renamed,
        F.array(
            _res("slot_key", F.concat(F.lit("slots."), F.array_min(g_keys)), _summary(F.lit("OBJECT"), g["slots_text"]),
                 _summary(F.lit("OBJECT"), p["slots_text"]))
        ),
    ).otherwise(
        F.concat(
            per_key(F.array_except(g_keys, p_keys), "missing_slot", lambda k: slot(g, k), lambda k: missing),
            per_key(F.array_except(p_keys, g_keys), "extra_slot", lambda k: missing, lambda k: slot(p, k)),
            per_key(F.filter(F.array_intersect(g_keys, p_keys), differs), "slot_value", lambda k: slot(g, k), lambda k: slot(p, k)),
        )
    )

    def field(path: str) -> Column:
        if path == "slots":
            return F.when(~fields_equal(g, p, path), slot_res).otherwise(none)
        kind = F.lit(GOLD_KIND.get(path, "STRING"))
        text = lambda c: c[path.replace(".", "_")].cast("string")
        one = F.array(_res(FIELD_FAMILY[path], path, _summary(kind, text(g)), _summary(kind, text(p))))
        return F.when(~fields_equal(g, p, path), one).otherwise(none)

    stop_words = lambda c: c["task_type"].isin("clarify", "blocked") | c["route"].isin("clarify", "deny")
    drift = (stop_words(g) | stop_words(p)) & ((g["task_type"] != p["task_type"]) | (g["route"] != p["route"]))
    pair = lambda c: _summary(F.lit("STRING"), F.concat_ws("/", c["task_type"], c["route"]))
    extras = F.transform(st["extra_top_level_fields"], lambda k: _res("extra_field", k, missing, F.lit("present")))
    core = F.concat(
        *[field(path) for path in C.FIELD_PATHS],
        extras,
        F.when(drift, F.array(_res("refusal_or_clarify", "task_type.route", pair(g), pair(p)))).otherwise(none),
    )
    absent = F.when(
        p["is_object"], st["missing_required_fields"]
    ).otherwise(F.array(*[F.lit(x) for x in sorted(C.CONTRACT_FIELDS)]))
    broken = F.concat(
        F.array(_res("invalid_output", "$", F.lit("string(14): valid contract"), F.when(F.col("raw").isNull(), F.lit("null")).otherwise(
            _summary(F.when(p["is_object"], F.lit("OBJECT")).otherwise(F.lit("STRING")), F.col("raw"))))),
        F.transform(absent, lambda k: _res("missing_field", k, F.lit("present"), missing)),
    )
    strict_pass = F.col("exact_ok") == 1
    found = F.when(strict_pass, none).otherwise(F.when(permissive_valid(), core).otherwise(broken))
    return typed.withColumn("found", found)


def residuals(typed: DataFrame, **more: Column) -> DataFrame:
    """One row per residual of every prediction that is not a strict pass, with further columns of its row."""
    rows = typed if "found" in typed.columns else with_residuals(typed)
    kept = rows.select(*KEEP, *[c.alias(n) for n, c in more.items()], F.posexplode("found").alias("position", "r"))
    return kept.select(*KEEP, *more, "position", "r.*")


def residual_families(typed: DataFrame, by: list[str]) -> DataFrame:
    """Zero-filled residual count per family with its share of all rows and three examples."""
    res = residuals(typed)
    total = typed.groupBy(*by).agg(F.count("*").alias("total"))
    counts = res.groupBy(*by, "family").agg(F.count("*").alias("residuals"))
    grid = total.select(*by, "total", F.explode(F.array(*[F.lit(f) for f in C.RESIDUAL_FAMILIES])).alias("family"))
    shown = examples(
        res.select(*by, "family", F.struct("ordinal", "position").alias("place"), T.safe_id_runs(F.col("id")).alias("row_id")),
        [*by, "family"], "place", "row_id", 3, "examples",
    )
    out = grid.join(counts, [*by, "family"], "left").join(shown, [*by, "family"], "left")
    n = F.coalesce("residuals", F.lit(0)).cast("bigint")
    return out.select(
        *by, "family", n.alias("residuals"), (n / F.col("total")).alias("proportion"), F.coalesce("examples", F.lit("")).alias("examples")
    )


def top_field_paths(typed: DataFrame, k: int = 20) -> DataFrame:
    """Most common residual paths per arm, ties by name."""
    counts = residuals(typed).groupBy("arm", "field_path").agg(F.count("*").alias("residuals"))
    return first_k(counts, ["arm"], [F.desc("residuals"), F.col("field_path")], k)


# ---- strict residual records, clusters and targets ---------------------------------------


def _strict_records(soft_only: Column) -> Column:
    """Strict mismatches of a row as an array of records."""
    g, p = F.col("g"), F.col("p")

    def category(path: str) -> Column:
        if path == "slots":
            return F.when(soft_only, F.lit("slot_value_strict_mismatch_soft_match")).otherwise(F.lit("slot_strict_mismatch"))
        if path == "normalized_command":
            return F.lit("normalized_command_strict_string_mismatch")
        if path.startswith("safety."):
            return F.lit("safety_field_strict_mismatch")
        return F.lit(path.replace(".", "_") + "_strict_mismatch")

    keys_equal = F.array_sort(g["slot_keys"]) == F.array_sort(p["slot_keys"])
    low = lambda c: F.lower(T.strip_ws(F.element_at(c["slot_str"], F.lit("field"))))
    language_pair = (
        (F.array_sort(g["slot_keys"]) == F.array(F.lit("field")))
        & keys_equal
        & (F.array_sort(F.array(low(g), low(p))) == F.array(F.lit("email"), F.lit("邮箱")))
    )
    slot_bucket = (
        F.when(language_pair, F.lit("slot_value_language_variant"))
        .when(keys_equal, F.lit("slot_value_canonical_phrase_drift"))
        .otherwise(F.lit("other_value_drift"))
    )

    def bucket(path: str) -> Column:
        if path == "slots":
            return slot_bucket
        return F.lit("normalized_command_paraphrase_drift" if path == "normalized_command" else "other_value_drift")

    def record(path: str, cat: Column, mismatch: str, drift: Column) -> Column:
        return F.struct(
            F.lit(path).alias("field_path"), cat.alias("category"), F.lit(mismatch).alias("mismatch_category"), drift.alias("drift_bucket")
        )

    found = F.array_compact(
        F.array(
            *[
                F.when(~fields_equal(g, p, path), record(path, category(path), "value_mismatch", bucket(path)))
                for path in C.FIELD_PATHS
            ]
        )
    )
    bad = F.array(record("schema", F.lit("schema_invalid_prediction"), "schema_invalid_prediction", F.lit("other_value_drift")))
    return F.when(F.col("schema_valid"), found).otherwise(bad)


def strict_residuals(rows: DataFrame) -> DataFrame:
    """Field-level records of strict mismatches; an unusable prediction gives one ``schema`` record."""
    # one row for each arm and split (a handful by definition), so the facts are not dealt out by them
    split_f1 = F.broadcast(rows.groupBy("arm", "split").agg(F.avg("slot_f1").alias("__f1"), F.avg("slot_f1_soft").alias("__soft")))
    soft_only = (F.col("__f1") < 1.0) & (F.col("__soft") >= 1.0)
    rows = rows.join(split_f1, ["arm", "split"])
    return rows.select(*KEEP, gold_family().alias("task_family"), F.explode(_strict_records(soft_only)).alias("r")).select(*KEEP, "task_family", "r.*")


def strict_drifts(judged: DataFrame) -> DataFrame:
    """Field path and drift bucket of every strict mismatch beside the columns of ``judged``: what the records of
    ``strict_residuals`` take from the two texts alone."""
    found = judged.withColumn("r", F.explode(_strict_records(F.lit(False))))
    return found.select(*judged.columns, "r.field_path", "r.drift_bucket")


def residual_clusters(records: DataFrame, k: int = 5) -> DataFrame:
    """Clusters by family, path, category and mismatch kind, ranked by rows, fields and name."""
    keys = ["arm", "task_family", "field_path", "category", "mismatch_category"]
    # rows first, then families, then clusters: distinct counts become sums (an id has one source and split)
    rows = records.groupBy(*keys, "source_id", "split", "id").agg(F.count("*").alias("n"))
    of = lambda s: count_if(F.col("split") == s)
    families = rows.groupBy(*keys, "source_id").agg(F.count("*").alias("rows"), F.sum("n").alias("fields"), of("dev").alias("dev"), of("test").alias("test"))
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    agg = families.groupBy(*keys).agg(
        total("rows", "residual_rows"), total("fields", "residual_fields"), F.count("*").alias("source_families"), total("dev", "dev_rows"), total("test", "test_rows")
    )
    shown = examples(records.select(*keys, "ordinal", "id"), keys, "ordinal", "id", k, "examples")
    ranked = agg.join(shown, keys, "left")
    name = F.substring_index("task_family", "|", 1)
    ranked = ranked.withColumn("short_name", name)
    order = [F.desc("residual_rows"), F.desc("residual_fields"), F.col("task_family"), F.col("field_path"), F.col("category")]
    return ranked_all(ranked, ["arm"], order, "cluster_rank")


def drift_counts(records: DataFrame) -> DataFrame:
    """Drift records by split, field path, source family and bucket in one pass."""
    from pactlane.operators.common import grouping_counts

    return grouping_counts(
        records, ["arm"], ["split", "field_path", "source_id", "drift_bucket", "task_family", "category"], [F.count("*").alias("residuals")]
    )


def case_groups(records: DataFrame) -> DataFrame:
    """Case-design groups: residual rows per source family and drift bucket."""
    return records.groupBy("arm", "source_id", "drift_bucket").agg(
        F.count("*").alias("residuals"),
        F.count_distinct("id").alias("residual_rows"),
        F.array_join(F.array_sort(F.collect_set("field_path")), ",").alias("field_paths"),
    )


def target_families(records: DataFrame) -> DataFrame:
    """Families ranked for the next bounded change; safety families wait until the end."""
    agg = records.groupBy("arm", "task_family").agg(
        F.count_distinct("split", "id").alias("residual_rows"), F.count("*").alias("residual_fields")
    )
    name = F.substring_index("task_family", "|", 1)
    agg = agg.withColumn("short_name", name).withColumn("is_safety", (name == "blocked").cast("int"))
    order = [F.col("is_safety"), F.desc("residual_rows"), F.desc("residual_fields"), F.col("task_family")]
    ranked = ranked_all(agg, ["arm"], order, "priority")
    reason = (
        F.when(F.col("priority") == 1, F.lit("selected"))
        .when(name == "blocked", F.lit("defer_to_dedicated_safety_boundary_phase"))
        .when(name.isin("search", "navigate", "extract"), F.lit("defer_to_later_label_canonicalization_phase"))
        .when(name == "form_fill", F.lit("defer_until_clarify_boundary_target_is_reviewed"))
        .otherwise(F.lit("defer_after_first_selected_cluster_review"))
    )
    return ranked.withColumn("decision", reason)


def form_fill_buckets(records: DataFrame) -> DataFrame:
    """Boundary, confirmation and specificity buckets of the form family."""
    path = F.col("field_path")
    bucket = (
        F.when(path == "normalized_command", F.lit("missing_confirmation_marker"))
        .when(path == "slots", F.lit("field_specificity_or_alias_drift"))
        .when(path.isin("task_type", "route", "safety.reason"), F.lit("route_intent_leakage"))
        .otherwise(F.lit("other_form_fill_boundary_residual"))
    )
    rows = records.where(F.col("task_family").startswith("form_fill|")).withColumn("bucket", bucket)
    return rows.groupBy("arm", "bucket").agg(
        F.count_distinct("split", "id").alias("residual_rows"),
        F.count("*").alias("residual_fields"),
        count_if(F.col("split") == "dev").alias("dev_fields"),
        count_if(F.col("split") == "test").alias("test_fields"),
    )


def coverage_ratio(records: DataFrame, cases: DataFrame) -> DataFrame:
    """Distinct field labels in candidate cases over distinct source families in the residual cluster."""
    left = records.groupBy("arm", "task_family").agg(
        F.count_distinct("source_id").alias("source_families"), F.count_distinct("id").alias("residual_rows")
    )
    right = cases.groupBy("task_family").agg(F.count_distinct("label").alias("field_labels"))
    labels = F.coalesce("field_labels", F.lit(0)).cast("bigint")
    return left.join(right, "task_family", "left").select(
        "arm", "task_family", "source_families", "residual_rows", labels.alias("field_labels"),
        F.when(F.col("source_families") == 0, F.lit(0.0)).otherwise(labels / F.col("source_families")).alias("coverage"),
    )


# ---- symptoms, failure families, slot shapes ------------------------------------------------


def symptoms(typed: DataFrame) -> DataFrame:
    """Counts of path-like routes, list slots, missing confirmation and absent predictions."""
    p, t = F.col("p"), F.col("t")
    return typed.groupBy("arm").agg(
        F.count("raw").alias("prediction_count"),
        count_if(F.col("raw").isNull()).alias("missing_prediction_count"),
        count_if(F.col("raw").isNotNull() & ~F.col("schema_valid")).alias("schema_invalid_prediction_count"),
        count_if((t["t_route"] == "STRING") & T.path_like(t["x_route"])).alias("path_like_route_count"),
        count_if(t["t_slots"] == "ARRAY").alias("list_slots_count"),
        count_if(p["is_object"] & ~F.array_contains(p["keys"], "confirmation_required")).alias("missing_confirmation_required_count"),
    )


def row_families(typed: DataFrame) -> DataFrame:
    """Primary failure family, command context and slot shape of every row, by ordered rules."""
    g, p, t, st = (F.col(x) for x in ("g", "p", "t", "st"))
    paths = F.array_compact(
        F.array(*[F.when(~gold_field(x).eqNullSafe(raw_field(t, p, x)), F.lit(x)) for x in C.FIELD_PATHS])
    )
    df = typed.withColumn("paths", paths)
    has = lambda *names: F.arrays_overlap(F.col("paths"), F.array(*[F.lit(x) for x in names]))
    no_confirm = F.array_contains(st["missing_required_fields"], "confirmation_required") | has("confirmation_required")
    string_rule = F.lit("strict_string_field_exact_match_mismatch")
    confirmation = (
        F.when(~F.col("schema_valid") & no_confirm, F.lit("missing_required_field_schema_failure"))
        .when(~F.col("schema_valid"), F.lit("schema_failure"))
        .when(has("task_type", "route", "safety.reason"), F.lit("semantic_task_route_safety_mismatch"))
        .when(has("normalized_command"), string_rule)
        .otherwise(F.lit("other_field_exact_match_mismatch"))
    )
    only_command = F.col("paths") == F.array(F.lit("normalized_command"))
    rerun = (
        F.when(no_confirm, F.lit("schema_missing_confirmation_required"))
        .when((t["t_task_type"] == "STRING") & ~t["x_task_type"].isin(*C.TASK_TYPES), F.lit("schema_invalid_task_type_enum"))
        .when(~F.col("schema_valid"), F.lit("schema_invalid_prediction_other"))
        .when(has("task_type", "route", "safety.allow", "safety.reason", "slots"), F.lit("schema_valid_task_route_safety_slot_mismatch"))
        .when(only_command, string_rule)
        .when(has("normalized_command"), F.lit("normalized_command_with_other_field_mismatch"))
        .otherwise(F.lit("other_field_exact_match_mismatch"))
    )
    context = F.when(
        has("normalized_command"),
        F.when(~F.col("schema_valid"), F.lit("co_occurs_with_schema_failure"))
        .when(has("task_type", "route", "safety.allow", "safety.reason"), F.lit("co_occurs_with_semantic_task_route_safety"))
        .when(only_command, F.lit("strict_string_only"))
        .otherwise(F.lit("co_occurs_with_other_field_mismatch")),
    )
    g_keys, p_keys = g["slot_keys"], p["slot_keys"]
    query_differs = ~F.element_at(g["slot_str"], "query").eqNullSafe(F.element_at(p["slot_str"], "query"))
    shape = (
        F.when(p_keys.isNull(), F.lit("slot_type_or_shape_mismatch"))
        .when(
            (g_keys == F.array(F.lit("query"))) & F.array_contains(p_keys, "city") & F.array_contains(p_keys, "date")
            & ~F.array_contains(p_keys, "query"), F.lit("city_date_slots_instead_of_query"),
        )
        .when(F.array_contains(g_keys, "query") & F.array_contains(p_keys, "query") & query_differs, F.lit("query_slot_strict_string_mismatch"))
        .when(~fields_equal(g, p, "slots"), F.lit("other_slot_exact_match_mismatch"))
        .otherwise(F.lit("slot_matches"))
    )
    return df.select(
        *KEEP, confirmation.alias("confirmation_family"), rerun.alias("rerun_family"), context.alias("command_context"),
        shape.alias("slot_shape"),
    )


def remediation_ranking(layered: DataFrame, typed: DataFrame) -> DataFrame:
    """Residual families with split counts, share and most affected task; unsafe misses ranked beside them."""
    # ---- fixed values: reported family -> residual families it sums
    sources = {
        "slot_key_mismatch": ("slot_key",),
        "slot_value_mismatch": ("slot_value",),
        "missing_slot": ("missing_slot",),
        "extra_slot": ("extra_slot",),
        "normalized_command_mismatch": ("normalized_command",),
        "route_or_task_type_mismatch": ("route", "task_type"),
        "confirmation_or_risk_mismatch": ("confirmation", "risk_level"),
        "invalid_output": ("invalid_output", "missing_field"),
    }
    pairs = [F.lit(x) for name, fams in sources.items() for fam in fams for x in (fam, name)]
    res = residuals(typed, task=F.col("g.task_type")).where(F.col("split").isin("dev", "test"))
    with_task = res.withColumn("target", F.element_at(F.create_map(*pairs), F.col("family"))).where(F.col("target").isNotNull())
    unsafe = layered.where((F.col("unsafe_fn") == 1) & F.col("split").isin("dev", "test")).select(
        "arm", "split", F.lit("unsafe_false_negative").alias("target"), F.col("g.task_type").alias("task")
    )
    events = with_task.select("arm", "split", "target", "task").unionByName(unsafe)
    per_task = events.groupBy("arm", "target", "task").agg(
        F.count("*").alias("c"), count_if(F.col("split") == "dev").alias("dev"), count_if(F.col("split") == "test").alias("test")
    )
    agg = per_task.groupBy("arm", "target").agg(
        F.sum("c").cast("bigint").alias("residuals"),
        F.sum("dev").cast("bigint").alias("dev_count"),
        F.sum("test").cast("bigint").alias("test_count"),
        F.min_by("task", F.struct((-F.col("c")).alias("c"), F.col("task"))).alias("top_task_type"),
    )
    total = agg.groupBy("arm").agg(F.sum("residuals").alias("total"))
    out = agg.join(total, "arm").withColumn("proportion", F.col("residuals") / F.col("total")).drop("total")
    first = (F.col("target") != "unsafe_false_negative").cast("int")
    return ranked_all(out, ["arm"], [first, F.desc("residuals"), F.col("target")], "priority")
