"""Seeds to training rows to preference pairs, with their checks, counts and export forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.functions import constants as C
from pactlane.functions import text as T
from pactlane.functions.contract import contract_valid, json_literal, parse_contract
from pactlane.operators.common import beside, count_if, examples, facts_beside, fits, grouping_counts, stack_columns, stored, union_all

SLOT_JSON = "array<struct<k:string,j:string>>"


def slot_json(c: Column) -> Column:
    """Slots in document order as (key, JSON text of the value)."""

    def render(k: Column) -> Column:
        kind, text = F.element_at(c["slot_types"], k), F.element_at(c["slot_str"], k)
        return (
            F.when(kind == "STRING", json_literal(text))
            .when(kind == "BOOLEAN", F.lower(text))
            .when(kind == "NULL", F.lit("null"))
            .otherwise(text)
        )

    return F.transform(c["slot_keys"], lambda k: F.struct(k.alias("k"), render(k).alias("j")))


def one_slot(key: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(key).alias("k"), json_literal(value).alias("j")))



def render_slots(slots: Column) -> Column:
    parts = F.transform(F.array_sort(slots), lambda e: F.concat(json_literal(e["k"]), F.lit(":"), e["j"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def render_contract(c: Column, slots: Column, **changes: Column) -> Column:
    """Canonical contract text (sorted keys, compact) with some fields replaced."""
    get = lambda name: changes.get(name, c[name])
    b = lambda col: col.cast("string")
    return F.concat(
        F.lit('{"confirmation_required":'), b(get("confirmation_required")),
        F.lit(',"contract_version":"v1","language":"zh-CN","normalized_command":'), json_literal(get("normalized_command")),
        F.lit(',"route":'), json_literal(get("route")),
        F.lit(',"safety":{"allow":'), b(get("safety_allow")), F.lit(',"reason":'), json_literal(get("safety_reason")),
        F.lit('},"slots":'), render_slots(slots),
        F.lit(',"task_type":'), json_literal(get("task_type")), F.lit("}"),
    )


def _public(c: Column, task: str, confirm: bool, reason: str | None = None) -> Column:
    rule = C.TASK_RULES[task]
    return (
        (c["task_type"] == task) & (c["route"] == rule[0]) & (c["safety_allow"] == rule[1])
        & (c["safety_reason"] == (reason or rule[2])) & (c["confirmation_required"] == confirm)
    )


def canonical_search(c: Column) -> tuple[Column, Column]:
    """(applies, query): whitespace-free query of a public read-only search."""
    command = c["normalized_command"]
    suffix = F.when(command.startswith(C.SEARCH_PREFIX), T.compact(command.substr(F.lit(3), F.length(command)))).otherwise(F.lit(""))
    slot = F.when(F.element_at(c["slot_types"], "query") == "STRING", T.compact(F.element_at(c["slot_str"], "query")))
    query = F.when(suffix != "", suffix).otherwise(F.coalesce(slot, F.lit("")))
    return _public(c, "search", False) & (query != ""), query


TARGET_BYTES, REJECTED_BYTES = 1000, 6000  # of a target with its canonical form, and with its rejected texts


def base_rows(seeds: DataFrame, public_safe: bool = True) -> DataFrame:
    """Seeds to original rows: canonical target, rendered once for each target text, and rebuilt provenance."""
    df = parse_contract(seeds.select("target").distinct(), "target", "c")
    c = F.col("c")
    if public_safe:
        applies, query = canonical_search(c)
        df = df.withColumn("__a", applies).withColumn("__q", query)
        changed = render_contract(
            c, one_slot("query", F.col("__q")), normalized_command=F.concat(F.lit(C.SEARCH_PREFIX), F.col("__q"))
        )
        target = F.when(F.coalesce(F.col("__a"), F.lit(False)), changed).otherwise(render_contract(c, slot_json(c)))
    else:
        target = render_contract(c, slot_json(c))
    known = stored(df.select(F.col("target").alias("__given"), target.alias("__target")), "targets")
    df = seeds.join(fits(known, TARGET_BYTES), F.col("target").eqNullSafe(F.col("__given")))
    mode = F.coalesce(F.element_at("provenance", "source_mode"), F.lit("sanitized_seed"))
    return df.select(
        "id", "split", "ordinal", "input_text", F.col("__target").alias("target"), "augmentations",
        rebuilt(F.col("provenance"), F.col("id"), mode, public_safe, F.lit("original")).alias("provenance"),
    )


def rebuilt(provenance: Column, source_id: Column, mode: Column, public_safe: bool, label: Column) -> Column:
    fresh = F.create_map(
        F.lit("source_id"), source_id, F.lit("source_mode"), mode, F.lit("public_safe"), F.lit(str(public_safe).lower()),
        F.lit("augmentation"), label,
    )
    kept = F.map_filter(provenance, lambda k, _v: ~k.isin("source_id", "source_mode", "public_safe", "augmentation"))
    return F.map_concat(kept, fresh)


def expand_rows(seeds: DataFrame, public_safe: bool = True) -> DataFrame:
    """Original rows plus one row per paraphrase, ids ``{id}-aug-{i}``; one narrow pass."""
    base = base_rows(seeds, public_safe)
    variants = F.concat(F.array("input_text"), F.coalesce("augmentations", F.array().cast("array<string>")))
    df = base.select("*", F.posexplode(variants).alias("n", "text"))
    n = F.col("n")
    mode = F.when(n == 0, F.element_at("provenance", "source_mode")).otherwise(F.lit("schema_preserving_augmentation"))
    label = F.when(n == 0, F.lit("original")).otherwise(F.concat(F.lit("paraphrase-"), n))
    return df.select(
        F.when(n == 0, F.col("id")).otherwise(F.concat_ws("-aug-", "id", n)).alias("id"),
        "split",
        "ordinal",
        n.alias("variant"),
        F.col("text").alias("input_text"),
        "target",
        rebuilt(F.col("provenance"), F.element_at("provenance", "source_id"), mode, public_safe, label).alias("provenance"),
    )


# ---- preference pairs ---------------------------------------------------------------


def rejections(c: Column, public_safe: Column) -> Column:
    """Array of (category, rejected text) for every applicable category, in generation order."""
    slots, none = slot_json(c), F.array().cast(SLOT_JSON)
    slot = lambda k: F.when(F.element_at(c["slot_types"], k) == "STRING", F.element_at(c["slot_str"], k))
    why = lambda name: {"safety_reason": F.lit(name)}
    query = T.compact(slot("query"))
    weather = r"^(.+)(今天|明天|后天)天气$"
    decomposed = F.array(
        F.struct(F.lit("city").alias("k"), json_literal(F.regexp_extract(query, weather, 1)).alias("j")),
        F.struct(F.lit("date").alias("k"), json_literal(F.regexp_extract(query, weather, 2)).alias("j")),
        F.struct(F.lit("topic").alias("k"), F.lit('""').alias("j")),
    )
    extract = public_safe & _public(c, "extract", False) & (slot("target") != "")
    price = extract & (slot("target") == C.PRICE_TARGET) & (c["normalized_command"] == C.PRICE_COMMAND)
    clarify = public_safe & _public(c, "clarify", True) & slot("ambiguity").isNotNull()
    payment = public_safe & _public(c, "blocked", True) & (slot("reason") == C.PAYMENT_REASON_SLOT)
    form = public_safe & _public(c, "form_fill", True) & (slot("field") != "")
    navigate = public_safe & _public(c, "navigate", False) & slot("url").startswith("https://")
    host = F.regexp_replace(slot("url"), "^https://", "")
    search_away = dict(
        task_type=F.lit("search"), route=F.lit("search_web"), safety_allow=F.lit(True), safety_reason=F.lit("public_readonly"),
        confirmation_required=F.lit(False),
    )
    swap = F.element_at(F.create_map(*[F.lit(x) for kv in C.TASK_TYPE_SWAP.items() for x in kv]), c["task_type"])
    first_wrong = F.transform(
        slots,
        lambda e, i: F.struct(
            e["k"].alias("k"),
            F.when(i == 0, json_literal(F.concat(F.element_at(c["slot_str"], e["k"]), F.lit("_wrong")))).otherwise(e["j"]).alias("j"),
        ),
    )
    wrong = F.when(F.size(slots) > 0, first_wrong).otherwise(one_slot("missing", F.lit("wrong")))
    text = lambda s: F.lit(s)
    always = F.lit(True)
    malformed = F.concat(
        F.lit('{"confirmation_required":'), c["confirmation_required"].cast("string"),
        F.lit(',"contract_version":"v1","language":"zh-CN","malformed_reason":"route_removed","normalized_command":'),
        json_literal(c["normalized_command"]), F.lit(',"safety":{"allow":'), c["safety_allow"].cast("string"),
        F.lit(',"reason":'), json_literal(c["safety_reason"]), F.lit('},"slots":'), render_slots(slots),
        F.lit(',"task_type":'), json_literal(c["task_type"]), F.lit("}"),
    )
    table = [
        ("wrong_task_type", always, render_contract(c, slots, task_type=swap, **why("wrong_task_type"))),
        ("wrong_route", always, render_contract(
            c, slots, route=F.when(c["route"] != "open_url", F.lit("open_url")).otherwise(F.lit("search_web")), **why("wrong_route"))),
        ("unsafe_allowance", always, render_contract(c, slots, safety_allow=~c["safety_allow"], **why("unsafe_allowance"))),
        ("missing_confirmation", c["confirmation_required"], render_contract(
            c, slots, confirmation_required=F.lit(False), **why("missing_confirmation"))),
        ("missing_slot", always, render_contract(c, F.filter(slots, lambda _s, i: i > 0), **why("missing_slot"))),
        ("wrong_slot", always, render_contract(c, wrong, **why("wrong_slot"))),
        ("decomposed_search_slots", public_safe & _public(c, "search", False) & query.rlike(weather), render_contract(
            c, decomposed, **why("decomposed_search_slots"))),
        ("extract_search_fallback", extract, render_contract(
            c, one_slot("query", slot("target")), task_type=F.lit("search"), route=F.lit("search_web"),
            normalized_command=F.concat(F.lit(C.SEARCH_PREFIX), slot("target")), **why("extract_search_fallback"))),
        ("extract_query_slot", extract, render_contract(
            c, F.concat(one_slot("page_url", F.lit("")), one_slot("query", slot("target"))), **why("extract_query_slot"))),
        ("extract_generic_price_wording", price, render_contract(
            c, one_slot("target", text("价格")), normalized_command=text("页面价格"), **why("extract_generic_price_wording"))),
        ("extract_listed_price_wording", price, render_contract(
            c, one_slot("target", text("标价")), normalized_command=text("提取页面标价"), **why("extract_listed_price_wording"))),
        ("extract_extra_particle_wording", price, render_contract(
            c, slots, normalized_command=text("提取页面上的商品价格"), **why("extract_extra_particle_wording"))),
        ("clarify_action_drift", clarify, render_contract(
            c, one_slot("query", text("公开信息")), normalized_command=text("搜索公开信息"), **search_away)),
        ("blocked_payment_action_drift", payment, render_contract(
            c, one_slot("query", text("付款")), normalized_command=text("搜索付款"), **search_away)),
        ("form_confirmation_drift", form, render_contract(
            c, one_slot("email", slot("field")), safety_allow=F.lit(True), confirmation_required=F.lit(False), **why("public_readonly"))),
        ("navigate_canonical_url_drift", navigate, render_contract(
            c, one_slot("url", host), normalized_command=F.concat(F.lit("打开 "), host), **why("navigate_canonical_url_drift"))),
        ("underspecified_request", always, render_contract(
            c, none, route=F.lit("clarify"), confirmation_required=F.lit(True), **why("underspecified_request"))),
        ("malformed_schema", always, malformed),
    ]
    return F.array_compact(
        F.array(*[F.when(cond, F.struct(F.lit(cat).alias("category"), body.alias("rejected"))) for cat, cond, body in table])
    )


def preference_pairs(rows: DataFrame) -> DataFrame:
    """Original rows x applicable categories; the rejected texts are rendered once for each target."""
    safe = F.coalesce(F.element_at("provenance", "public_safe") == "true", F.lit(False))
    originals = rows.where(F.element_at("provenance", "augmentation") == "original").withColumn("__safe", safe)
    targets = parse_contract(originals.select("target", "__safe").distinct(), "target", "c")
    known = targets.select(F.col("target").alias("__given"), F.col("__safe").alias("__kind"), rejections(F.col("c"), F.col("__safe")).alias("__r"))
    same = F.col("target").eqNullSafe(F.col("__given")) & (F.col("__safe") == F.col("__kind"))
    df = originals.join(fits(stored(known, "rejections"), REJECTED_BYTES), same)
    df = df.select("id", "split", "ordinal", "input_text", "target", "provenance", F.posexplode("__r").alias("n", "r"))
    return df.select(
        F.concat_ws("-", "id", "r.category").alias("id"),
        "split",
        "ordinal",
        F.col("n").alias("variant"),
        "input_text",
        F.col("target").alias("chosen"),
        F.col("r.rejected").alias("rejected"),
        F.col("r.category").alias("rejection_reason"),
        F.create_map(
            F.lit("source_id"), F.coalesce(F.element_at("provenance", "source_id"), F.col("id")),
            F.lit("source_mode"), F.lit("hard_negative"),
            F.lit("public_safe"), F.coalesce(F.element_at("provenance", "public_safe"), F.lit("false")),
        ).alias("provenance"),
    )


def _blank(name: str) -> Column:
    return F.col(name).isNull() | F.col(name).rlike(r"(?U)^\s*$")


def _plain_rule() -> Column:
    """The first rule broken by id, split or text, which every row has for itself."""
    return (
        F.when(_blank("id"), F.lit("missing_id"))
        .when(~F.coalesce(F.col("split").isin(*C.SPLITS), F.lit(False)), F.lit("invalid_split"))
        .when(_blank("input_text"), F.lit("missing_input_text"))
    )


def _pair_rule(pairs: DataFrame) -> Column:
    if "rejected_input_text" not in pairs.columns:
        return _plain_rule()
    same_input = F.col("rejected_input_text").isNull() | (F.col("rejected_input_text") == F.col("input_text"))
    return _plain_rule().when(~same_input, F.lit("different_input"))


def check_pairs(pairs: DataFrame) -> DataFrame:
    """Add ``violation``: the first structural or strength rule a pair breaks, NULL when sound."""
    return _judged_pairs(pairs.withColumn("__first", _pair_rule(pairs)))


def pair_verdicts(pairs: DataFrame) -> DataFrame:
    """How many pairs of each rejection_reason have which violation (``copies``). Every pair is read; those
    with equal texts and reason are judged once."""
    equal = pairs.select(_pair_rule(pairs).alias("__first"), "rejection_reason", "chosen", "rejected")
    equal = stored(equal.groupBy(*equal.columns).agg(F.count("*").alias("copies")), "equal-pairs")
    return _judged_pairs(_dealt(equal)).groupBy("rejection_reason", "violation").agg(F.sum("copies").alias("copies"))


def row_verdicts(rows: DataFrame) -> DataFrame:
    """How many training rows have which violation (``copies``); those with equal targets are judged once."""
    equal = rows.select(_plain_rule().alias("__first"), "target", F.col("provenance").isNull().alias("__bare"))
    equal = stored(equal.groupBy(*equal.columns).agg(F.count("*").alias("copies")), "equal-rows")
    return _judged_rows(_dealt(equal)).groupBy("violation").agg(F.sum("copies").alias("copies"))


def _dealt(equal: DataFrame) -> DataFrame:
    """Few bytes that are long to parse, so they are dealt out by number."""
    spark = equal.sparkSession
    return equal.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _judged_pairs(pairs: DataFrame) -> DataFrame:
    kept = [c for c in pairs.columns if c != "__first"]
    df = contract_valid(parse_contract(pairs, "chosen", "c"), "c").withColumnRenamed("schema_valid", "c_ok").drop("semantic_valid")
    df = contract_valid(parse_contract(df, "rejected", "r"), "r").withColumnRenamed("schema_valid", "r_ok").drop("semantic_valid")
    c, r, why = F.col("c"), F.col("r"), F.col("rejection_reason")
    has = lambda side, k: F.array_contains(side["slot_keys"], k)
    val = lambda side, k: F.element_at(side["slot_str"], k)
    keys = lambda side: F.array_sort(side["slot_keys"])
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    is_ = lambda side, **kw: _all_equal(side, kw)
    extract = is_(c, task_type="extract", route="extract_page", safety_allow=True, safety_reason="public_readonly")
    price = extract & (val(c, "target") == C.PRICE_TARGET) & (c["normalized_command"] == C.PRICE_COMMAND)
    ne = lambda a, b: ~a.eqNullSafe(b)
    sound = {
        "wrong_task_type": ne(c["task_type"], r["task_type"]),
        "wrong_route": ne(c["route"], r["route"]),
        "unsafe_allowance": ne(c["safety_allow"], r["safety_allow"]),
        "missing_confirmation": (c["confirmation_required"]) & (r["confirmation_required"] == F.lit(False)),
        "missing_slot": F.size(r["slot_keys"]) < F.size(c["slot_keys"]),
        "wrong_slot": ne(c["c_slots"], r["c_slots"]),
        "decomposed_search_slots": is_(c, task_type="search", route="search_web", safety_allow=True, safety_reason="public_readonly")
        & is_(r, task_type="search", route="search_web", safety_allow=True)
        & (keys(c) == lits("query")) & (keys(r) == lits("city", "date", "topic")),
        "extract_search_fallback": extract & has(c, "target") & is_(r, task_type="search", route="search_web"),
        "extract_query_slot": extract & has(c, "target") & ~has(r, "target") & (has(r, "query") | has(r, "page_url")),
        "extract_generic_price_wording": price & (ne(c["c_slots"], r["c_slots"]) | ne(c["normalized_command"], r["normalized_command"]))
        & ((val(r, "target") == "价格") | (r["normalized_command"] == "页面价格")),
        "extract_listed_price_wording": price & ((val(r, "target") == "标价") | r["normalized_command"].contains("标价")),
        "extract_extra_particle_wording": price & (val(r, "target") == C.PRICE_TARGET) & ne(r["normalized_command"], F.lit(C.PRICE_COMMAND)),
        "clarify_action_drift": is_(c, task_type="clarify", route="clarify", confirmation_required=True, safety_reason="ambiguous_request")
        & has(c, "ambiguity") & ~is_(r, task_type="clarify", route="clarify"),
        "blocked_payment_action_drift": is_(c, task_type="blocked", route="deny", safety_allow=False, safety_reason="unsafe_payment")
        & ~is_(r, task_type="blocked", route="deny", safety_allow=False),
        "form_confirmation_drift": is_(
            c, task_type="form_fill", route="fill_form", confirmation_required=True, safety_reason="requires_confirmation")
        & has(c, "field") & ~(is_(r, confirmation_required=True, safety_reason="requires_confirmation") & (keys(r) == lits("field"))),
        "navigate_canonical_url_drift": is_(c, task_type="navigate", route="open_url", safety_reason="public_readonly") & has(c, "url")
        & (ne(val(r, "url"), val(c, "url")) | ne(r["normalized_command"], c["normalized_command"])),
        "underspecified_request": r["route"] == "clarify",
        "malformed_schema": ~F.array_contains(r["keys"], "route"),
    }
    strength = F.lit(None).cast("string")
    for category in reversed(C.REJECTION_CATEGORIES):
        strength = F.when((why == category) & ~F.coalesce(sound[category], F.lit(False)), F.lit(category)).otherwise(strength)
    violation = (
        F.when(F.col("__first").isNotNull(), F.col("__first"))
        .when(~why.isin(*C.REJECTION_CATEGORIES), F.lit("unknown_rejection_reason"))
        .when(~F.col("c_ok"), F.lit("invalid_chosen"))
        .when((why == "malformed_schema") & ~(r["is_object"] & (F.size(r["keys"]) > 0)), F.lit("empty_malformed"))
        .when((why != "malformed_schema") & ~F.col("r_ok"), F.lit("invalid_rejected"))
        .when(F.col("r_ok") & _same_contract(c, r), F.lit("weak_pair"))
        .otherwise(strength)
    )
    # a filter on the verdict would be pushed below the parse and repeat it for every rule, but for the explode
    return df.select(*kept, F.explode(F.array(violation)).alias("violation"))


def _all_equal(side: Column, wanted: dict) -> Column:
    out = None
    for name, value in wanted.items():
        test = side[name].eqNullSafe(F.lit(value))
        out = test if out is None else out & test
    return out


def _same_contract(a: Column, b: Column) -> Column:
    out = a["c_slots"].eqNullSafe(b["c_slots"])
    for name in ("task_type", "route", "safety_allow", "safety_reason", "confirmation_required", "normalized_command"):
        out = out & a[name].eqNullSafe(b[name])
    return out


def check_rows(rows: DataFrame) -> DataFrame:
    """Add ``violation`` for training rows: id, split, text, contract, provenance."""
    marked = rows.withColumn("__first", _plain_rule()).withColumn("__bare", F.col("provenance").isNull())
    return _judged_rows(marked)


def _judged_rows(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("__first", "__bare")]
    df = contract_valid(parse_contract(rows, "target", "c"), "c")
    violation = (
        F.when(F.col("__first").isNotNull(), F.col("__first"))
        .when(~F.col("schema_valid"), F.lit("invalid_contract"))
        .when(F.col("__bare"), F.lit("missing_provenance"))
    )
    # a filter on the verdict would be pushed below the parse and repeat it for every rule, but for the explode
    return df.select(*kept, F.explode(F.array(violation)).alias("violation"))


def check_seeds(seeds: DataFrame) -> DataFrame:
    """Explode seed issues: structure, schema and safety consistency."""
    df = contract_valid(parse_contract(seeds, "target", "c"), "c")
    c = F.col("c")
    blank = lambda name: F.col(name).isNull() | F.col(name).rlike(r"(?U)^\s*$")
    n_aug = F.when(F.col("augmentations").isNull(), F.lit(0)).otherwise(F.size("augmentations"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("missing id")),
            F.when(blank("input_text"), F.lit("missing input_text")),
            F.when(n_aug < 2, F.concat(F.lit("need >=2 augmentations, got "), n_aug)),
            F.when(~F.coalesce(F.col("split").isin(*C.SPLITS), F.lit(False)), F.concat(F.lit("invalid split: "), F.coalesce("split", F.lit("None")))),
            F.when(~F.col("schema_valid"), F.lit("schema")),
            F.when((c["task_type"] == "blocked") & ~c["safety_allow"].eqNullSafe(F.lit(False)), F.lit("blocked task must have safety.allow=false")),
            F.when(
                c["task_type"].isin("search", "navigate", "extract") & (c["safety_allow"] == F.lit(False)),
                F.concat(c["task_type"], F.lit(" task should normally have safety.allow=true")),
            ),
        )
    )
    return df.select("id", F.explode(issues).alias("issue"))


def artifact_failures(rows: DataFrame, pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Row, pair and manifest failures as (id, category, message)."""
    row_f = check_rows(rows).where("violation IS NOT NULL").select("id", F.lit("schema").alias("category"), F.col("violation").alias("message"))
    pair_f = check_pairs(pairs).where("violation IS NOT NULL").select("id", F.lit("preference_pair").alias("category"), F.col("violation").alias("message"))
    counted = beside(rows.agg(F.count("*").alias("rows")), pairs.agg(F.count("*").alias("pairs")))
    return union_all([row_f, pair_f, _manifest_failures(counted, manifest)])


def counted_failures(rows: DataFrame, pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Row, pair and manifest failures as (category, message, failures): the counts of ``artifact_failures``
    with one pass over rows and pairs, each judged once for all that are equal."""
    by_row, by_pair = stored(row_verdicts(rows), "row-verdicts"), stored(pair_verdicts(pairs), "pair-verdicts")
    whole = lambda df, name: df.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias(name))
    manifest_f = _manifest_failures(beside(whole(by_row, "rows"), whole(by_pair, "pairs")), manifest)
    failed = lambda df, name: df.where("violation IS NOT NULL").select(F.lit(name).alias("category"), F.col("violation").alias("message"), "copies")
    every = union_all([failed(by_row, "schema"), failed(by_pair, "preference_pair"), manifest_f.select("category", "message", F.lit(1).cast("long").alias("copies"))])
    return every.groupBy("category", "message").agg(F.sum("copies").alias("failures"))


def _manifest_failures(counted: DataFrame, manifest: DataFrame) -> DataFrame:
    joined = facts_beside(counted, manifest)
    return joined.select(
        F.coalesce("manifest_id", F.lit("manifest")).alias("id"),
        F.lit("manifest").alias("category"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("absent"), F.lit("manifest is missing")),
                    F.when(F.col("sft_rows") != F.col("rows"), F.lit("sft_rows count mismatch")),
                    F.when(F.col("preference_pairs") != F.col("pairs"), F.lit("preference_pairs count mismatch")),
                )
            )
        ).alias("message"),
    )


# ---- counts ----------------------------------------------------------------------------


def split_counts(rows: DataFrame) -> DataFrame:
    agg = rows.agg(*[count_if(F.col("split") == s).alias(s) for s in C.SPLITS])
    return stack_columns(agg, [], list(C.SPLITS), "split", "row_count")


def rejection_counts(pairs: DataFrame) -> DataFrame:
    agg = pairs.agg(*[count_if(F.col("rejection_reason") == c).alias(c) for c in C.REJECTION_CATEGORIES])
    return stack_columns(agg, [], list(C.REJECTION_CATEGORIES), "rejection_reason", "pair_count")


def preference_slices(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Zero-filled pair count per slice with the first five ids."""
    lookup = F.create_map(*[F.lit(x) for kv in C.REJECTION_SLICE.items() for x in kv])
    df = pairs.select("id", F.struct("ordinal", "variant").alias("ordinal"), F.element_at(lookup, F.col("rejection_reason")).alias("slice"))
    agg = df.agg(*[count_if(F.col("slice") == s).alias(s) for s in C.PREFERENCE_SLICES])
    counts = stack_columns(agg, [], list(C.PREFERENCE_SLICES), "slice", "pair_count")
    return counts.join(examples(df, ["slice"], "ordinal", "id", k, "examples"), "slice", "left").withColumn(
        "examples", F.coalesce("examples", F.lit(""))
    )


def coverage(rows: DataFrame) -> DataFrame:
    """Per split counts over source family, contract family, task, route, reason, confirmation and slot keys."""
    df = parse_contract(rows, "target", "c")
    c = F.col("c")
    keys = F.array_join(F.array_sort(c["slot_keys"]), ",")
    df = df.select(
        "split",
        F.col("source_id"),
        T.family_key(c["task_type"], c["route"], c["safety_reason"], c["confirmation_required"], c["slot_keys"]).alias("contract_family"),
        c["task_type"].alias("task_type"),
        c["route"].alias("route"),
        c["safety_reason"].alias("safety_reason"),
        F.concat(F.lit("confirm:"), c["confirmation_required"].cast("string")).alias("confirmation"),
        F.when(keys == "", F.lit("none")).otherwise(keys).alias("slot_keys"),
    )
    dims = ["source_id", "contract_family", "task_type", "route", "safety_reason", "confirmation", "slot_keys"]
    return grouping_counts(df, ["split"], dims, [F.count("*").alias("row_count")])


def sample_profile(seeds: DataFrame) -> DataFrame:
    """Task, route, reason, confirmation and split counts with mean variants per seed."""
    df = parse_contract(seeds, "target", "c")
    df = df.select(
        F.col("c.task_type").alias("task_type"), F.col("c.route").alias("route"), F.col("c.safety_reason").alias("safety_reason"),
        F.initcap(F.col("c.confirmation_required").cast("string")).alias("confirmation"), "split",
        (F.size("augmentations") + 1).alias("variants"),
    )
    return grouping_counts(
        df, [], ["task_type", "route", "safety_reason", "confirmation", "split"],
        [F.count("*").alias("seeds"), F.round(F.avg("variants"), 3).alias("mean_variants")],
    )


# ---- rule baseline and export forms ---------------------------------------------------------


def rule_baseline(rows: DataFrame) -> DataFrame:
    """Keyword-rule prediction per row as contract text."""
    text = F.col("input_text")
    searching = text.rlike("搜|查")
    query = T.strip_ws(F.replace(F.replace(F.replace(F.replace(text, F.lit("帮我"), F.lit("")), F.lit("搜索"), F.lit("")), F.lit("搜"), F.lit("")), F.lit("查一下"), F.lit("")))
    query = F.when(query == "", text).otherwise(query)
    empty = F.array().cast(SLOT_JSON)
    blank = F.struct(F.lit(None).cast("string").alias("x"))

    def contract(task, route, allow, reason, confirm, slots, command):
        return render_contract(
            blank, slots, task_type=F.lit(task), route=F.lit(route), safety_allow=F.lit(allow), safety_reason=F.lit(reason),
            confirmation_required=F.lit(confirm), normalized_command=command,
        )

    raw = (
        F.when(searching, contract("search", "search_web", True, "public_readonly", False, one_slot("query", query), F.concat(F.lit("搜索"), query)))
        .when(text.contains("打开"), contract("navigate", "open_url", True, "public_readonly", False, one_slot("url", F.lit("about:blank")), text))
        .otherwise(contract("clarify", "clarify", False, "underspecified_request", True, empty, text))
    )
    return rows.select(F.lit("rules").alias("arm"), "id", "ordinal", raw.alias("raw"))


def prediction_inputs(rows: DataFrame) -> DataFrame:
    """Only id and text: no gold column can reach the predictor."""
    return rows.select("id", "input_text")


def chat_rows(rows: DataFrame, system_prompt: str) -> DataFrame:
    """Message list, training text, prediction prompt and target span per row."""
    target = F.col("target")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt_lines = F.concat_ws("\n", F.lit("system: " + system_prompt), F.concat(F.lit("user: "), F.col("input_text")))
    training = F.concat_ws("\n", prompt_lines, F.concat(F.lit("assistant: "), target))
    df = rows.select(
        "id", "split", "ordinal", "input_text", "target",
        F.array(message("system", F.lit(system_prompt)), message("user", F.col("input_text")), message("assistant", target)).alias("messages"),
        training.alias("training_text"),
        F.concat_ws("\n", prompt_lines, F.lit("assistant:")).alias("prediction_prompt"),
    )
    times = T.occurrences(F.col("training_text"), F.col("target"))
    status = (
        F.when((F.length("target") == 0) | (times == 0), F.lit("assistant_span_unavailable"))
        .when(times > 1, F.lit("assistant_span_ambiguous"))
        .otherwise(F.lit("available"))
    )
    start = F.when(status == "available", F.expr("locate(target, training_text)") - 1)
    return df.withColumn("span_status", status).withColumn("span_start", start).withColumn("span_end", start + F.length("target"))


def prompt_alignment(chat: DataFrame) -> DataFrame:
    """All-rows flags: shared prefix, target only in the training text, prompt ends at the boundary."""
    prefix = lambda c: F.substring_index(c, "\nassistant:", 1)
    in_train, in_prompt = F.col("training_text").contains(F.col("target")), F.col("prediction_prompt").contains(F.col("target"))
    return chat.groupBy("split").agg(
        F.count("*").alias("row_count"),
        F.bool_and(prefix(F.col("training_text")) == prefix(F.col("prediction_prompt"))).alias("share_prefix"),
        F.bool_and(in_train).alias("training_has_target"),
        F.bool_and(~in_prompt).alias("prompt_hides_target"),
        F.bool_and(F.col("prediction_prompt").endswith("assistant:")).alias("prompt_ends_at_boundary"),
        F.bool_and(F.col("span_status") == "available").alias("all_spans_found"),
    )


def learning_signal(chat: DataFrame) -> DataFrame:
    """Text and target lengths, ratios and hashes per row."""
    n, m = F.length("training_text"), F.length("target")
    return chat.select(
        "id", "split", F.sha2("training_text", 256).alias("training_sha256"), F.sha2("target", 256).alias("target_sha256"),
        n.alias("training_chars"), m.alias("target_chars"), (m / n).alias("target_ratio"), (F.col("span_status") == "available").alias("span_found"),
    )


def signal_pressure(signal: DataFrame) -> DataFrame:
    return signal.groupBy("split").agg(
        F.count("*").alias("row_count"),
        F.max("training_chars").alias("max_training_chars"),
        F.max("target_chars").alias("max_target_chars"),
        F.min("target_ratio").alias("min_target_ratio"),
        F.max("target_ratio").alias("max_target_ratio"),
        count_if(F.col("training_chars") > 2048).alias("rows_over_2048_chars"),
        F.bool_and("span_found").alias("all_spans_found"),
    )


def preference_export(pairs: DataFrame, system_prompt: str) -> DataFrame:
    """Prompt messages, chosen and rejected text for preference training."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return pairs.select(
        "id", F.array(message("system", F.lit(system_prompt)), message("user", F.col("input_text"))).alias("prompt"),
        "chosen", "rejected", "rejection_reason",
    )


def prompt_snapshot(chat: DataFrame) -> DataFrame:
    """Redacted prompt hash, length and 240-character preview."""
    clean = T.redact(F.col("prediction_prompt"))
    return chat.select(
        "id", F.sha2(clean, 256).alias("prompt_sha256"), F.length(clean).alias("prompt_chars"), F.left(clean, F.lit(240)).alias("prompt_preview"),
        F.left(T.redact(F.col("input_text")), F.lit(120)).alias("input_preview"),
    )


def select_training_rows(rows: DataFrame, source_ids: DataFrame | None, limit: int | None) -> DataFrame:
    """Rows of the wanted source ids, then the first N in input order."""
    df = rows if source_ids is None else rows.join(source_ids, "source_id", "left_semi")
    return df if limit is None else df.orderBy("ordinal", *[c for c in ("variant",) if c in df.columns], "id").limit(limit)


def selection_record(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Row counts before and after a selection, per source id."""
    before = rows.groupBy("source_id").agg(F.count("*").alias("rows_before"))
    after = selected.groupBy("source_id").agg(F.count("*").alias("rows_used"))
    return before.join(after, "source_id", "left").withColumn("rows_used", F.coalesce("rows_used", F.lit(0)).cast("bigint"))


def target_labels(tokens: DataFrame) -> DataFrame:
    """Labels that keep token ids fully inside the target span, -100 elsewhere.

    Input: ``input_ids array<long>``, ``offsets array<struct<start,end>>``, ``span_start``, ``span_end``.
    """
    s, e = F.col("span_start"), F.col("span_end")
    real = lambda o: o["start"] != o["end"]
    crosses = lambda o: real(o) & (((o["start"] < s) & (s < o["end"])) | ((o["start"] < e) & (e < o["end"])))
    inside = lambda o: real(o) & (o["start"] >= s) & (o["end"] <= e)
    gap = (
        F.when(F.size("input_ids") <= 0, F.lit("input_ids_unavailable"))
        .when(F.size("offsets") <= 0, F.lit("token_offsets_unavailable"))
        .when(F.size("input_ids") != F.size("offsets"), F.lit("label_token_offset_length_mismatch"))
        .when(F.exists("offsets", crosses), F.lit("assistant_span_token_boundary_unavailable"))
        .when(~F.exists("offsets", inside), F.lit("assistant_target_tokens_unavailable"))
    )
    labels = F.transform(
        F.arrays_zip(F.col("input_ids").alias("i"), F.col("offsets").alias("o")),
        lambda z: F.when(inside(z["o"]), z["i"]).otherwise(F.lit(-100)),
    )
    df = tokens.withColumn("gap", gap)
    df = df.withColumn("labels", F.when(F.col("gap").isNull(), labels))
    return df.withColumn("target_tokens", F.size(F.filter("labels", lambda x: x != -100)))


def exposure_budget(labelled: DataFrame, batch: int, accumulation: int, max_steps: int, epochs: float, observed: int | None = None) -> DataFrame:
    """Examples and target tokens seen from row count, steps and label tokens."""
    steps = observed if observed is not None else max_steps
    agg = labelled.agg(F.count("*").alias("train_rows"), F.sum(F.greatest("target_tokens", F.lit(0))).cast("bigint").alias("target_tokens_per_pass"))
    seen = F.lit(steps * batch * accumulation) if steps > 0 else F.bround(F.col("train_rows") * F.lit(float(epochs)))
    seen = seen.cast("bigint")
    return agg.select(
        "train_rows", "target_tokens_per_pass", F.lit(batch * accumulation).alias("effective_batch_size"), seen.alias("examples_seen"),
        F.when(F.col("train_rows") == 0, F.lit(0)).otherwise(
            F.bround(F.col("target_tokens_per_pass") * seen / F.col("train_rows"))).cast("bigint").alias("target_tokens_seen"),
    )


def stop_reason(tokens: Column, eos: Column, limit: Column, finish: Column) -> Column:
    """Evidence label from token ids, EOS id, maximum and an explicit finish state."""
    return (
        F.when(finish == "fixture_no_generation", F.lit("fixture_no_generation"))
        .when(eos.isNotNull() & F.array_contains(tokens, eos), F.lit("tokenizer_eos_observed"))
        .when((limit > 0) & (F.size(tokens) >= limit), F.lit("max_new_tokens_reached_without_tokenizer_eos"))
        .otherwise(F.lit("not_recorded_below_max_without_tokenizer_eos"))
    )
