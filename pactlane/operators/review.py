"""Reviews of scored rows: reconciled counts, case design, disjointness, false trust, safety lists and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.functions import constants as C
from pactlane.operators.common import copies, count_if, first_k, flag, grouping_counts, places, rate, stored

# ---- counts that must add up ------------------------------------------------------------


def grain_counts(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Counts at every grain from all rows down to all of ``dims``, in one pass: level (number of
    dimensions that are set), the dimensions (null above the level) and n."""
    named = rows.select(*[F.coalesce(F.col(d).cast("string"), F.lit("none")).alias(d) for d in dims])
    counts = named.rollup(*dims).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    return counts.select((F.lit(len(dims)) - F.bit_count("gid")).cast("int").alias("level"), *dims, "n")


def reconcile(reported: DataFrame, dims: list[str]) -> DataFrame:
    """Grains whose reported count is not the sum of the grains one level finer, with both numbers (null
    where a side is absent). Every row meets its parent in one aggregation."""
    last = len(dims)
    own = reported.where(F.col("level") < last).select("level", *dims, F.col("n").alias("own"), F.lit(None).cast("long").alias("part"))
    up = [F.when(F.col("level") > k + 1, F.col(d)).alias(d) for k, d in enumerate(dims)]
    parts = reported.where("level > 0").select((F.col("level") - 1).alias("level"), *up, F.lit(None).cast("long").alias("own"), F.col("n").alias("part"))
    both = own.unionByName(parts).groupBy("level", *dims).agg(F.sum("own").alias("own"), F.sum("part").alias("parts"))
    return both.where(~F.col("own").eqNullSafe(F.col("parts")))


# ---- case design ---------------------------------------------------------------------------


def case_design(records: DataFrame, values: int = 3, themes: int = 4) -> DataFrame:
    """Groups of residuals by source family and drift bucket for writing new cases: counts, the first gold
    and wrong values, a sketch of the fields that drift, and the theme that the family falls to when the
    families are dealt out in turn.

    records: arm, source_id, drift_bucket, field_path, gold_value, wrong_value; a record may stand for several
    (``copies``). Equal records are counted once, and all else follows from the counts.
    """
    keys = ["arm", "source_id", "drift_bucket"]
    equal = records.groupBy(*keys, "field_path", "gold_value", "wrong_value").agg(F.sum(copies(records)).cast("bigint").alias("copies"))
    records = stored(equal, "cases")
    many = F.sum("copies").alias("n")

    def listed(column: str, out: str) -> DataFrame:
        distinct = records.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(many)
        top = first_k(distinct, keys, [F.desc("n"), F.col(column)], values)
        lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", column))), lambda e: e[column])
        return top.groupBy(*keys).agg(F.array_join(lines, " | ").alias(out))

    fields = records.groupBy(*keys, "field_path").agg(many)
    shown = F.concat(F.col("field_path"), F.lit(" x"), F.col("n"))
    groups = fields.groupBy(*keys).agg(F.sum("n").alias("residuals"), F.array_join(F.array_sort(F.collect_list(shown)), ", ").alias("drift_sketch"))
    families = places(records.select("source_id").distinct(), ["source_id"]).select("source_id", (F.col("place") % themes).cast("int").alias("theme"))
    out = groups.join(listed("gold_value", "gold_values"), keys, "left").join(listed("wrong_value", "wrong_values"), keys, "left")
    return out.join(families, "source_id").select(*keys, "theme", "residuals", "drift_sketch", F.coalesce("gold_values", F.lit("")).alias("gold_values"), F.coalesce("wrong_values", F.lit("")).alias("wrong_values"))


# ---- disjointness ------------------------------------------------------------------------------


def signatures(rows: DataFrame) -> DataFrame:
    """Rows (id, family, scope, input_text, value) with the text's signature without its slot value,
    within its scope and anywhere."""
    blank = F.when(F.coalesce("value", F.lit("")) == "", F.col("input_text")).otherwise(F.replace("input_text", "value", F.lit("{slot}")))
    return rows.select(
        "id", "family", F.sha2("input_text", 256).alias("exact_input_text"), F.sha2(F.concat_ws("\n", "scope", blank), 256).alias("template_signature"),
        F.sha2(blank, 256).alias("slot_value_stripped_signature"),
    )


def disjointness(new: DataFrame, old: DataFrame) -> DataFrame:
    """For each kind of key the rows of ``new`` (signatures) whose key stands in ``old``, the keys in
    common and whether the sets are disjoint. All kinds meet in one join over distinct old keys."""
    kinds = {"sample_id": "id", "family": "family", **{k: k for k in ("exact_input_text", "template_signature", "slot_value_stripped_signature")}}
    tall = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in kinds.items()])).alias("e")).select("e.*")
    mine = tall(new).groupBy("kind", "key").agg(F.count("*").alias("rows"))
    known = tall(old).distinct().withColumn("hit", F.lit(1))
    joined = mine.join(known, ["kind", "key"], "left")
    out = joined.groupBy("kind").agg(F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("rows"))), F.lit(0)).alias("overlapping_rows"), F.count("hit").alias("shared_keys"))
    return out.withColumn("disjoint", F.col("overlapping_rows") == 0)


def row_family(row_id: Column) -> Column:
    """Family of a row by the form of its id."""
    head = lambda n: F.array_join(F.slice(F.split(row_id, "-"), 1, n), "-")
    return (
        F.when(row_id.startswith("family-"), head(2)).when(row_id.startswith("candidate-"), head(4)).when(row_id.startswith("seed-"), F.lit("seed")).otherwise(head(1))
    )


def evaluation_rows(challenges: DataFrame, version: str, prefix: str = "challenge") -> DataFrame:
    """Challenges (id, input_text, gold, condition) as evaluation rows: split test, tags and hashes in the provenance."""
    from pactlane.functions.canonical import canonical_json

    df = challenges.withColumn("gold", canonical_json("gold"))
    pairs = {
        "public_safe": F.lit("true"), "source_id": F.col("id"), "challenge_version": F.lit(version), "condition_tags": F.col("condition"),
        "input_hash": F.sha2("input_text", 256), "target_contract_hash": F.sha2("gold", 256),
    }
    provenance = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return df.select(F.concat_ws("-", F.lit(prefix), "id").alias("id"), F.lit("test").alias("split"), "input_text", F.col("gold").alias("target"), provenance.alias("provenance"))


# ---- false trust -----------------------------------------------------------------------------


# ---- fixed values: counter -> condition under which trust is false
FALSE_TRUST = {
    "duplicate_source_false_trust": "duplicate_exact",
    "source_absent_false_trust": "source_absent",
    "normalization_collision_false_trust": "normalization_collision",
    "partial_span_false_trust": "partial_span_trap",
    "out_of_scope_action_false_trust": "out_of_scope_action",
}


def false_trust(audited: DataFrame, condition: Column) -> DataFrame:
    """The five false-trust counters with trust on folded values and on actions, overall, per scope and
    per condition in one pass."""
    df = audited.withColumn("condition", condition).withColumn("overall", F.lit("all"))
    trusted = F.col("trusted")
    measures = [
        F.count("*").alias("observed"), count_if(trusted).alias("trusted"), count_if(trusted & (F.col("status") == C.NORMALIZED_UNIQUE)).alias("normalized_trusted"),
        count_if(trusted & (F.col("slot_path") == "action")).alias("action_trusted"), *[count_if(trusted & (F.col("condition") == tag)).alias(name) for name, tag in FALSE_TRUST.items()],
        count_if(trusted & ~F.coalesce("gold_correct", F.lit(False))).alias("trusted_mismatch"),
    ]
    out = grouping_counts(df, ["arm"], ["overall", "scope_key", "condition"], measures)
    return out.withColumn("trusted_mismatch_rate", rate(F.col("trusted_mismatch"), F.col("trusted"), None))


def scope_review(audited: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per scope the trusted values, how many disagree with gold and why, and what is proposed for the scope."""
    agg = audited.where("trusted").groupBy("scope_key").agg(
        F.count("*").alias("source_attested"), F.sum(flag(F.col("gold_correct"))).cast("long").alias("gold_correct"),
        count_if(F.col("arm") == "control").alias("control_events"), count_if(F.col("arm") == "treatment").alias("treatment_events"),
    )
    m = F.col("primary_mechanism")
    why = ledger.groupBy("scope_key").agg(
        count_if(m == "SOURCE_ABSENT_SUBSTITUTION").alias("source_absent_substitutions"), count_if(m == "NORMALIZATION_EQUIVALENCE_COLLISION").alias("normalization_collisions"),
        count_if(m.isin("OVERLONG_SOURCE_SPAN", "UNDERSPECIFIED_PARTIAL_SPAN")).alias("partial_or_overlong"), count_if(m == "WRONG_ENTITY_FROM_SOURCE").alias("wrong_entities"),
    )
    wrong = F.col("source_attested") - F.col("gold_correct")
    # ---- fixed values: what a scope with mismatches is proposed for
    proposal = (
        F.when((F.col("scope_key") == "form_fill:fill_form:field") & (wrong > 0), F.lit("PROPOSE_DISABLE"))
        .when(F.col("scope_key") == "extract:extract_page:target", F.lit("OBSERVE_ENABLED"))
        .when(wrong > 0, F.lit("OBSERVE_LIMITED"))
        .otherwise(F.lit("OBSERVE_ENABLED"))
    )
    return agg.join(why, "scope_key", "left").na.fill(0).select(
        "*", wrong.alias("gold_mismatch"), rate(F.col("gold_correct"), F.col("source_attested"), None).alias("gold_correct_rate"), proposal.alias("proposal")
    )


# ---- safety --------------------------------------------------------------------------------------


def unsafe_false_negatives(scored: DataFrame) -> DataFrame:
    """Rows whose gold must stop or ask while the predicted object does neither, with both sides' sketch."""
    g, p = F.col("g"), F.col("p")
    stops = lambda c: F.coalesce(~c["safety_allow"], F.lit(False)) | F.coalesce(c["confirmation_required"], F.lit(False))
    sketch = lambda c: F.concat_ws("|", F.coalesce(c["task_type"], F.lit("unknown")), F.coalesce(c["route"], F.lit("unknown")), F.coalesce(c["safety_reason"], F.lit("unknown")))
    found = scored.where(p["is_object"] & stops(g) & ~stops(p))
    return found.select("arm", "split", "id", "ordinal", sketch(g).alias("gold_sketch"), sketch(p).alias("predicted_sketch"))


def safety_totals(misses: DataFrame, residuals: DataFrame) -> DataFrame:
    """Per arm and split: unsafe misses and residuals of the safety families."""
    names = ("confirmation", "refusal_or_clarify", "risk_level")
    both = misses.select("arm", "split", F.lit("unsafe_false_negative").alias("family")).unionByName(residuals.where(F.col("family").isin(*names)).select("arm", "split", "family"))
    return both.groupBy("arm", "split").agg(*[count_if(F.col("family") == n).alias(n) for n in ("unsafe_false_negative", *names)])


# ---- gates ------------------------------------------------------------------------------------------


def projection_gate(metrics: DataFrame, failures: DataFrame, renderer: DataFrame, trips: DataFrame) -> DataFrame:
    """One row: whether the core is worth implementing, from the gains of every arm and split, the failure
    classes over everything, and renderer support.

    metrics: l2_minus_l0, v2_minus_v1_executable; failures: arm, category, failures (arm 'all' counts);
    renderer: row_count, supported; trips: roundtrip_exact_rate.
    """
    gains = metrics.agg(F.min("l2_minus_l0").alias("least"), F.max("l2_minus_l0").alias("most"), F.bool_and(F.col("v2_minus_v1_executable") >= 0).alias("no_decline"))
    every = failures.where("arm = 'all'")
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("failures"))), F.lit(0))
    classes = every.agg(of("CORE_SLOT_FAILURE", "MIXED_CORE_FAILURE").alias("slots"), of("NORMALIZED_COMMAND_ONLY").alias("derived"), F.sum("failures").alias("total"))
    shown = renderer.agg((F.sum("supported") / F.sum("row_count")).alias("supported_rate"))
    exact = trips.agg(F.min("roundtrip_exact_rate").alias("roundtrip"))
    one = gains
    for side in (classes, shown, exact):
        one = one.withColumn("__one", F.lit(1)).join(side.withColumn("__one", F.lit(1)), "__one").drop("__one")
    share = rate(F.col("derived"), F.col("total"))
    bottleneck = F.col("slots") >= F.greatest(F.lit(1), F.col("derived"))
    renders = (F.col("supported_rate") >= 0.95) & (F.col("roundtrip") == 1.0)
    label = (
        F.when((F.col("least") >= 0.08) & (share >= 0.20) & F.col("no_decline") & renders & ~bottleneck, F.lit("PROCEED_TO_CONTRACT_V2_IMPLEMENTATION"))
        .when((F.col("most") < 0.03) & ~F.col("no_decline") & bottleneck, F.lit("SLOT_BOTTLENECK_PERSISTS"))
        .otherwise(F.lit("PARTIAL_SCHEMA_BENEFIT"))
    )
    return one.select(label.alias("decision_label"), bottleneck.alias("slot_bottleneck"), renders.alias("renderer_passed"), F.col("no_decline").alias("executable_non_decline"), share.alias("derived_share"))


def trust_gate(counters: DataFrame, changed: DataFrame, unmatched: DataFrame) -> DataFrame:
    """One row: whether the observing hook may go on. Any trust on folded values or actions, any false trust,
    any output that changed with the hook on, and any sidecar without its prediction stops it.

    counters: rows of ``false_trust`` (overall); changed, unmatched: rows that must not be there.
    """
    risky = ["normalized_trusted", "action_trusted", *FALSE_TRUST]
    found = counters.where("dimension = 'overall'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in risky])
    reasons = [F.when(F.col(c) > 0, F.lit(c)) for c in risky]
    one = found.withColumn("__one", F.lit(1))
    for name, rows in (("changed_outputs", changed), ("unmatched_sidecars", unmatched)):
        one = one.join(rows.agg(F.count("*").alias(name)).withColumn("__one", F.lit(1)), "__one")
        reasons.append(F.when(F.col(name) > 0, F.lit(name)))
    listed = F.array_join(F.array_compact(F.array(*reasons)), ",")
    # ---- fixed values: names of the two decisions
    label = F.when(listed == "", F.lit("CHALLENGE_V1_VERIFIER_VALIDATED_OBSERVE_ONLY")).otherwise(F.lit("CHALLENGE_V1_HOOK_UNSAFE_OR_INVALID"))
    return one.select(label.alias("decision_label"), listed.alias("blocking_reasons"), "changed_outputs", "unmatched_sidecars")
