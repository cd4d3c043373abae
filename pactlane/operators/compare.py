"""Paired comparison of two prediction arms: movements, deltas, bootstrap intervals and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlane.functions import constants as C
from pactlane.functions.contract import fields_equal
from pactlane.operators.common import beside, count_if, first_k, flag, grouping_counts, stack_columns

OUTCOMES = ("exact", "task_type", "route", "safety", "confirmation", "slot")


def paired(rows: DataFrame, keys: list[str], values: list[str], control: str = "control", treatment: str = "treatment") -> DataFrame:
    """One row per key with ``c_*`` and ``t_*`` columns: a single aggregation on the pair key."""
    pick = lambda arm, v: F.max(F.when(F.col("arm") == arm, F.col(v)))
    return rows.groupBy(*keys).agg(
        *[pick(control, v).alias(f"c_{v}") for v in values], *[pick(treatment, v).alias(f"t_{v}") for v in values]
    )


def movement(c: Column, t: Column, names=("unchanged_success", "recovered", "regressed", "persistent_failure")) -> Column:
    return (
        F.when((c == 1) & (t == 1), F.lit(names[0]))
        .when(t == 1, F.lit(names[1]))
        .when(c == 1, F.lit(names[2]))
        .otherwise(F.lit(names[3]))
    )


def raw_outcomes(scored: DataFrame) -> DataFrame:
    """Six outcome flags per row and arm, judged on the raw object even when it breaks the schema."""
    g, p = F.col("g"), F.col("p")
    same = None
    for path in C.FIELD_PATHS:
        eq = fields_equal(g, p, path)
        same = eq if same is None else same & eq
    exact_keys = F.size(F.array_except("p.keys", F.array(*[F.lit(f) for f in C.CONTRACT_FIELDS]))) == 0
    stop = lambda c: F.coalesce(~c["safety_allow"], F.lit(False))
    obj = p["is_object"]
    return scored.select(
        "arm", "id", "split", "ordinal", F.col("source_id").alias("family"), g["task_type"].alias("gold_task"),
        flag(obj & same & exact_keys & (F.size(p["safety_keys"]) == 2)).alias("exact"),
        flag(obj & (p["task_type"] == g["task_type"])).alias("task_type"),
        flag(obj & (p["route"] == g["route"])).alias("route"),
        flag(obj & (stop(p) == stop(g))).alias("safety"),
        flag(obj & (p["confirmation_required"] == g["confirmation_required"])).alias("confirmation"),
        flag(obj & p["slot_keys"].isNotNull() & (p["c_slots"] == g["c_slots"])).alias("slot"),
    )


def tradeoff(scored: DataFrame) -> DataFrame:
    """Outcome x class counts per split, zero-filled."""
    wide = paired(raw_outcomes(scored), ["id", "split", "family"], list(OUTCOMES))
    classes = ("unchanged_success", "recovered", "regressed", "persistent_failure")
    rows = wide.select(
        "split", F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), movement(F.col(f"c_{o}"), F.col(f"t_{o}")).alias("class")) for o in OUTCOMES])).alias("e")
    ).select("split", "e.*")
    agg = rows.groupBy("split", "outcome").agg(*[count_if(F.col("class") == c).alias(c) for c in classes])
    return stack_columns(agg, ["split", "outcome"], list(classes), "class", "row_count")


def tradeoff_families(scored: DataFrame) -> DataFrame:
    """Regressed and recovered rows per outcome and row family."""
    wide = paired(raw_outcomes(scored), ["id", "split", "family"], list(OUTCOMES))
    rows = wide.select(
        "split", "family",
        F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), movement(F.col(f"c_{o}"), F.col(f"t_{o}")).alias("class")) for o in OUTCOMES])).alias("e"),
    ).select("split", "family", "e.*")
    return rows.where(F.col("class").isin("recovered", "regressed")).groupBy("split", "outcome", "class", "family").agg(F.count("*").alias("row_count"))


STATUS_FLAGS = ("exact", "executable", "slot_exact", "safety_correct", "confirmation_correct", "route_correct", "task_type_correct")
STATUS_SCORES = ("slot_value_exact_f1", "slot_value_normalized_f1")


def paired_status(status: DataFrame) -> DataFrame:
    return paired(status, ["id", "ordinal", "split", "family"], [*STATUS_FLAGS, *STATUS_SCORES])


def recoveries(pairs: DataFrame, k: int = 50) -> DataFrame:
    """Recovered and regressed rows per metric with the first k ids."""
    from pactlane.operators.common import examples

    metrics = STATUS_FLAGS[:5]
    moved = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"c_{m}") != F.col(f"t_{m}"), F.struct(
                    F.lit(m).alias("metric"), F.when(F.col(f"t_{m}") == 1, F.lit("recovery")).otherwise(F.lit("regression")).alias("direction")))
                for m in metrics
            ]
        )
    )
    rows = pairs.select("split", "id", "ordinal", F.explode(moved).alias("m")).select("split", "id", "ordinal", "m.*")
    keys = ["split", "metric", "direction"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("row_count"))
    return counts.join(examples(rows, keys, "ordinal", "id", k, "examples"), keys)


def family_deltas(pairs: DataFrame, by: list[str], k: int = 12) -> DataFrame:
    """Treatment minus control per family, ordered by absolute movement, size and name."""
    cols = [*STATUS_FLAGS[:3], "slot_value_exact_f1", "route_correct", "task_type_correct"]
    agg = pairs.groupBy(*by, "family").agg(
        F.count("*").alias("row_count"),
        *[F.round(F.avg(F.col(f"t_{c}")) - F.avg(F.col(f"c_{c}")), 9).alias(f"{c}_delta") for c in cols],
    )
    move = F.round(F.abs("slot_value_exact_f1_delta") + F.abs("executable_delta"), 9)
    return first_k(agg.withColumn("movement", move), by, [F.desc("movement"), F.desc("row_count"), F.col("family")], k)


def metric_deltas(tidy_metrics: DataFrame, control: str = "control", treatment: str = "treatment") -> DataFrame:
    """Delta per split and metric; NULL when either side is NULL."""
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("value")))
    wide = tidy_metrics.groupBy("split", "metric").agg(pick(control).alias("control"), pick(treatment).alias("treatment"))
    return wide.withColumn("delta", F.col("treatment") - F.col("control"))


def reproduction(observed: DataFrame, expected: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Expected metrics that are absent or differ by more than the tolerance."""
    keys = ["arm", "split", "metric"]
    joined = expected.withColumnRenamed("value", "expected").join(observed.withColumnRenamed("value", "observed"), keys, "left")
    close = F.abs(F.col("observed") - F.col("expected")) <= tolerance
    both_null = F.col("observed").isNull() & F.col("expected").isNull()
    return joined.where(~(F.coalesce(close, F.lit(False)) | both_null))


# ---- fixed values: gate thresholds per metric (minimum delta, or maximum when negated)
GATE = (
    ("slot_value_exact_f1", ">=", 0.03),
    ("executable_contract_pass_rate", ">=", 0.02),
    ("safety_recall", ">=", 0.0),
    ("unsafe_false_negative_rate", "<=", 0.0),
    ("requires_confirmation_accuracy", ">=", -0.01),
    ("schema_validity", ">=", 0.0),
    ("json_valid_rate", ">=", 0.0),
)
PRIMARY = ("contract_exact_match_strict", "executable_contract_pass_rate", "slot_value_exact_f1", "slot_value_normalized_f1")


def gate(deltas: DataFrame) -> DataFrame:
    """One row: label and pass flag from the dev and test deltas; a missing delta counts as 0."""
    rows = deltas.where(F.col("split").isin("dev", "test")).withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    metric, d = F.col("metric"), F.col("delta")
    test = F.lit(True)
    for name, op, limit in GATE:
        test = F.when(metric == name, d >= limit if op == ">=" else d <= limit).otherwise(test)
    guards = [n for n, _o, _l in GATE[2:]]
    agg = rows.agg(
        F.bool_and(F.when(metric.isin(*guards), test).otherwise(F.lit(True))).alias("guardrails_pass"),
        F.bool_and(F.when(metric.isin(*PRIMARY), d >= 0).otherwise(F.lit(True))).alias("primary_non_regressed"),
        F.bool_and(test).alias("all_pass"),
        F.bool_or(metric.isin("slot_value_exact_f1", "executable_contract_pass_rate") & (d > 0)).alias("some_gain"),
    )
    label = (
        F.when(~F.col("guardrails_pass") | ~F.col("primary_non_regressed"), F.lit("REGRESSION_OR_GUARDRAIL_FAILURE"))
        .when(F.col("all_pass"), F.lit("PASS_STEP_MATCHED_PILOT"))
        .when(F.col("some_gain"), F.lit("POSITIVE_BUT_INCONCLUSIVE"))
        .otherwise(F.lit("NO_CANONICAL_DATA_SIGNAL"))
    )
    return agg.select(label.alias("decision_label"), (label == "PASS_STEP_MATCHED_PILOT").alias("passed"), "guardrails_pass", "primary_non_regressed")


EXACT_BITS = 5  # Poisson draws of means below 2**EXACT_BITS come from tables of their distribution


def poisson_table(mean: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until nothing is left that a uniform of 48 bits could tell."""
    term, out = math.exp(-mean), [math.exp(-mean)]
    while out[-1] < 1 - 2.0**-50 and term > 0 and len(out) < 1000:
        term *= mean / len(out)
        out.append(out[-1] + term)
        if len(out) > mean and term < 2.0**-60:
            break
    return out


def uniforms(key: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from a counter: halves of its digest."""
    digest = F.md5(key)
    part = lambda at: (F.conv(F.substring(digest, at, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    return part(1), part(13)


def poisson(bit: Column, u: Column, v: Column) -> Column:
    """Poisson number of mean 2**bit from two uniforms: by table, beyond it by a corrected normal quantile."""
    tables = F.lit([poisson_table(2.0**k) for k in range(EXACT_BITS)])
    mean = F.pow(F.lit(2.0), bit)
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    far = F.floor(mean + F.sqrt(mean) * z + (z * z - 1) / 6 + 0.5)
    near = F.size(F.filter(F.get(tables, bit), lambda p: p <= u))
    return F.when(bit < EXACT_BITS, near).otherwise(F.greatest(far, F.lit(0))).cast("long")


def bootstrap(pairs: DataFrame, metrics: list[str], resamples: int = 2000, seed: int = 7170, rule: str = "count") -> DataFrame:
    """Paired bootstrap of the mean delta with a percentile interval.

    Rows weigh Poisson(1) in a draw. Equal deltas are counted first, and n of them weigh Poisson(n)
    together, which is drawn as the sum over the powers of two in n: the work does not grow with the
    rows. Every number comes from a counter (seed, split, metric, draw, rank of the delta, power), so
    a draw is the same wherever and whenever it is made. A draw without weight counts as the plain
    mean. ``rule`` picks one of the two published index rules.
    """
    deltas = pairs.select(
        "split", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(f"t_{m}") - F.col(f"c_{m}"), 12).cast("double").alias("delta")) for m in metrics])).alias("d")
    ).select("split", "d.*")
    by = ["split", "metric"]
    hist = deltas.groupBy(*by, "delta").agg(F.count("*").alias("n")).where("delta IS NOT NULL")
    ranked = hist.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("delta")))
    plain = hist.groupBy(*by).agg((F.sum(F.col("delta") * F.col("n")) / F.sum("n")).alias("plain"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda j: F.getbit(F.col("n"), j) == 1)
    drawn = ranked.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("bit", F.explode(bits))
    u, v = uniforms(F.concat_ws("|", F.lit(seed), "split", "metric", "draw", "k", "bit"))
    weighed = drawn.select(*by, "draw", "delta", "bit", u.alias("u"), v.alias("v")).withColumn("w", poisson(F.col("bit"), F.col("u"), F.col("v")))
    sums = weighed.groupBy(*by, "draw").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("delta")).alias("s"))
    means = sums.join(plain, by).withColumn("mean", F.round(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.col("plain")), 9))
    ordered = F.array_sort(F.collect_list("mean"))
    b = resamples
    if rule == "count":
        lo, hi = int(0.025 * b), int(0.975 * b) - 1
    else:
        lo, hi = int((b - 1) * 0.025), int((b - 1) * 0.975)
    agg = means.groupBy(*by).agg(F.round(F.avg("mean"), 9).alias("mean_delta"), ordered.alias("o"))
    return agg.select(*by, "mean_delta", F.col("o")[lo].alias("ci_low"), F.col("o")[hi].alias("ci_high"))


# ---- safety and confirmation --------------------------------------------------------------


def safety_regression(scored: DataFrame) -> DataFrame:
    """Stable / regressed / recovered / persistent counts by split, task, route and family."""
    g = F.col("g")
    rows = scored.select(
        "arm", "id", "split", F.col("source_id").alias("family"), g["task_type"].alias("task_type"), g["route"].alias("route"),
        flag(~g["safety_allow"]).alias("stop"), (F.col("safety_tp") + F.col("safety_tn")).alias("safe"),
    )
    wide = paired(rows, ["id", "split", "family", "task_type", "route", "stop"], ["safe"])
    moved = movement(F.col("c_safe"), F.col("t_safe"), ("stable_correct", "recovered", "regressed", "persistent_miss"))
    wide = wide.withColumn("classification", F.when(F.col("stop") == 0, F.lit("unchanged_non_stop")).otherwise(moved))
    return grouping_counts(wide, ["classification"], ["split", "family", "task_type", "route"], [F.count("*").alias("row_count")])


def confirmation_regressions(scored: DataFrame) -> DataFrame:
    """Rows whose confirmation was right in the baseline and wrong in the retry, by preserved family."""
    g, p = F.col("g"), F.col("p")
    family = F.concat_ws("|", g["task_type"], g["route"], F.concat(F.lit("confirm:"), g["confirmation_required"].cast("string")))
    rows = scored.select(
        "arm", "id", "split", family.alias("family"), flag(p["is_object"]).alias("obj"),
        flag(p["is_object"] & (p["confirmation_required"] == g["confirmation_required"])).alias("right"),
    )
    wide = paired(rows, ["id", "split", "family"], ["obj", "right"])
    hit = (F.col("c_obj") == 1) & (F.col("t_obj") == 1) & (F.col("c_right") == 1) & (F.col("t_right") == 0)
    return wide.where(hit).groupBy("split", "family").agg(F.count("*").alias("row_count"))


# ---- boundary checks ------------------------------------------------------------------------


def boundary(gold: DataFrame, preds: DataFrame, arms: list[str]) -> DataFrame:
    """Id agreement of gold and every arm: counts, duplicates, missing and extra ids, from one join."""
    per_arm = preds.groupBy("id").agg(*[count_if(F.col("arm") == a).alias(f"n_{a}") for a in arms])
    sides = gold.groupBy("id", "split").agg(F.count("*").alias("n_gold"))
    full = sides.join(per_arm, "id", "full_outer").na.fill(0, ["n_gold", *[f"n_{a}" for a in arms]])
    agg = full.groupBy("split").agg(
        F.sum("n_gold").cast("bigint").alias("gold_rows"),
        *[F.sum(f"n_{a}").cast("bigint").alias(f"{a}_rows") for a in arms],
        count_if(F.col("n_gold") > 1).alias("duplicate_gold_ids"),
        *[count_if(F.col(f"n_{a}") > 1).alias(f"{a}_duplicate_ids") for a in arms],
        *[count_if((F.col("n_gold") > 0) & (F.col(f"n_{a}") == 0)).alias(f"{a}_missing_ids") for a in arms],
        *[count_if((F.col("n_gold") == 0) & (F.col(f"n_{a}") > 0)).alias(f"{a}_extra_ids") for a in arms],
    )
    reasons = [
        F.when(F.col("duplicate_gold_ids") > 0, F.lit("duplicate_sample_ids")),
        *[F.when(F.col(f"{a}_duplicate_ids") > 0, F.lit(f"duplicate_{a}_ids")) for a in arms],
        *[F.when(F.col(f"{a}_rows") != F.col("gold_rows"), F.lit(f"{a}_row_count_mismatch")) for a in arms],
        *[F.when(F.col(f"{a}_missing_ids") + F.col(f"{a}_extra_ids") > 0, F.lit(f"{a}_gold_id_mismatch")) for a in arms],
    ]
    return agg.withColumn("blocking_reasons", F.array_join(F.array_sort(F.array_compact(F.array(*reasons))), ","))


def missing_predictions(gold: DataFrame, preds: DataFrame) -> DataFrame:
    return gold.select("id").join(preds, "id", "left_anti")


def id_disagreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids present on one side only."""
    both = left.select("id", F.lit(1).alias("l")).distinct().join(right.select("id", F.lit(1).alias("r")).distinct(), "id", "full_outer")
    return both.where("l IS NULL OR r IS NULL").select("id", F.when(F.col("l").isNull(), F.lit("right")).otherwise(F.lit("left")).alias("only_in"))


def cohort_check(rows: DataFrame, expected_ids: DataFrame, cells: DataFrame, cell_columns: list[str]) -> DataFrame:
    """Missing, extra and duplicate ids plus cells whose count differs from the expected table."""
    mine = rows.groupBy("id").agg(F.count("*").alias("n"))
    ids = expected_ids.select("id", F.lit(1).alias("want")).join(mine, "id", "full_outer")
    issue = (
        F.when(F.col("n").isNull(), F.lit("missing_id")).when(F.col("want").isNull(), F.lit("extra_id")).when(F.col("n") > 1, F.lit("duplicate_id"))
    )
    id_issues = ids.select(F.col("id").alias("subject"), issue.alias("issue")).where("issue IS NOT NULL")
    counts = rows.groupBy(*cell_columns).agg(F.count("*").alias("n"))
    diff = cells.join(counts, cell_columns, "full_outer").where(~F.col("n").eqNullSafe(F.col("expected")))
    cell_issues = diff.select(F.concat_ws("|", *cell_columns).alias("subject"), F.lit("cell_count_mismatch").alias("issue"))
    return id_issues.unionByName(cell_issues)


def invariance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that differ between two outputs of the same run, counted both ways."""
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_first")), b.exceptAll(a).agg(F.count("*").alias("only_second"))
    return beside(left, right)
