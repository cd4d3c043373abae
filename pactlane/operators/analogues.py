"""Training analogues of held-out families over a ladder of ever coarser family keys.

A family key has parts from coarse (task) to fine (slot names). Families of both sides are counted
first, then dealt out once by the coarsest part; every finer key begins with it, so the counts of
all rungs come from windows inside the same partitions, and the finest rung with training rows wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlane.operators.common import count_if

PARTS = ("task_type", "route", "reason", "confirm", "slots")
RUNGS = {5: "contract_family", 4: "without_slots", 3: "task_route_reason", 2: "task_route", 1: "task_only"}

# ---- fixed values: family -> kind of rejected answer that exercises it
HARD_NEGATIVES = {
    "blocked|deny|unsafe_payment|confirm:true|slots:reason": "blocked_payment_action_drift",
    "clarify|clarify|ambiguous_request|confirm:true|slots:ambiguity": "clarify_action_drift",
    "form_fill|fill_form|requires_confirmation|confirm:true|slots:field": "form_confirmation_drift",
    "navigate|open_url|public_readonly|confirm:false|slots:url": "navigate_canonical_url_drift",
}


def key_of(parts: tuple[str, ...] = PARTS) -> Column:
    return F.concat_ws("|", *parts)


def family_parts(contract: Column) -> list[Column]:
    """Columns task_type, route, reason, confirm and slots of a parsed contract."""
    keys = F.array_join(F.array_sort(contract["slot_keys"]), ",")
    return [
        contract["task_type"].alias("task_type"), contract["route"].alias("route"), contract["safety_reason"].alias("reason"),
        F.concat(F.lit("confirm:"), contract["confirmation_required"].cast("string")).alias("confirm"),
        F.concat(F.lit("slots:"), F.when(keys == "", F.lit("none")).otherwise(keys)).alias("slots"),
    ]


def analogues(rows: DataFrame) -> DataFrame:
    """One row per held-out source family and contract family with the rung of its nearest training family.

    rows: source_id, split, role ('train', 'held_out'; others are ignored), tuned (in the tuning
    subset), invalid (prediction breaks the schema) and the five parts of the key.
    """
    held = F.col("role") == "held_out"
    counted = rows.where(F.col("role").isin("train", "held_out")).groupBy(
        "role", F.when(held, F.col("split")).alias("split"), F.when(held, F.col("source_id")).alias("source_id"), *PARTS
    ).agg(F.count("*").alias("n"), count_if(F.col("tuned")).alias("tuned"), count_if(F.col("invalid")).alias("invalid"))
    counted = counted.repartition(PARTS[0])
    train = F.when(F.col("role") == "train", F.col("n"))
    tuned = F.when(F.col("role") == "train", F.col("tuned"))
    for rung in RUNGS:
        w = Window.partitionBy(*PARTS[:rung])
        counted = counted.withColumn(f"train_{rung}", F.coalesce(F.sum(train).over(w), F.lit(0))).withColumn(f"tuned_{rung}", F.coalesce(F.sum(tuned).over(w), F.lit(0)))
    finest = lambda kind: F.coalesce(*[F.when(F.col(f"train_{r}") > 0, F.col(f"{kind}_{r}")) for r in RUNGS], F.lit(0))
    rung = F.coalesce(*[F.when(F.col(f"train_{r}") > 0, F.lit(r)) for r in RUNGS], F.lit(0))
    out = counted.where("role = 'held_out'").select(
        "split", "source_id", key_of().alias("contract_family"), "task_type", "route", F.col("n").alias("row_count"), F.col("invalid").alias("invalid_predictions"),
        rung.alias("rung"), finest("train").alias("train_rows"), finest("tuned").alias("tuning_rows"), F.col("train_5").alias("exact_train_rows"), F.col("tuned_5").alias("exact_tuning_rows"),
    )
    names = F.element_at(F.create_map(*[F.lit(x) for r, n in {**RUNGS, 0: "none"}.items() for x in (r, n)]), F.col("rung"))
    coverage = F.when(F.col("rung") == 5, F.lit("covered")).when(F.col("rung") > 0, F.lit("covered_by_coarser_family")).otherwise(F.lit("absent"))
    return out.withColumn("analogue_level", names).withColumn("coverage", coverage)


def strategy(found: DataFrame) -> DataFrame:
    """Analogues with the strategy of each family: more coverage where training holds it and tuning does not."""
    aim = F.when((F.col("exact_train_rows") > 0) & (F.col("exact_tuning_rows") == 0), F.lit("targeted_sft_family_coverage")).otherwise(F.lit("inspect_data_or_objective_gap"))
    negative = F.element_at(F.create_map(*[F.lit(x) for kv in HARD_NEGATIVES.items() for x in kv]), F.col("contract_family"))
    return found.withColumn("strategy_bucket", aim).withColumn("hard_negative_category", negative)


def strategy_summary(planned: DataFrame) -> DataFrame:
    """Per split: families, those absent from the tuning subset, those with training analogues, categories at hand."""
    distinct = lambda cond: F.count_distinct(F.when(cond, F.col("contract_family")))
    return planned.groupBy("split").agg(
        F.count("*").alias("families"), F.sum("row_count").alias("rows"), distinct(F.col("exact_tuning_rows") == 0).alias("absent_from_tuning"),
        distinct(F.col("exact_train_rows") > 0).alias("with_train_analogue"), distinct(F.col("rung").between(1, 4)).alias("with_coarser_analogue"),
        distinct(F.col("rung") == 0).alias("without_analogue"), count_if(F.col("strategy_bucket") == "targeted_sft_family_coverage").alias("targeted"),
        F.array_join(F.array_sort(F.collect_set("hard_negative_category")), ",").alias("hard_negative_categories"),
    )
