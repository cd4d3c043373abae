"""Candidate seeds: grids, materialisation, promotion, merge and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlane.functions import constants as C
from pactlane.operators.leakscan import first_unsafe


def seed_grid(families: DataFrame, per_family: int, prefix: str = "family") -> DataFrame:
    """family x index seeds with a round-robin split; families are (family, position)."""
    df = families.select("family", "position", F.explode(F.sequence(F.lit(1), F.lit(per_family))).alias("index"))
    seq = F.col("position") * per_family + F.col("index") - 1
    splits = F.array(*[F.lit(s) for s in C.SPLITS])
    return df.select(
        F.concat_ws("-", F.lit(prefix), "family", F.format_string("%02d", F.col("index"))).alias("id"), "family", "index",
        F.element_at(splits, (F.pmod(F.col("index") - 1, F.lit(3)) + 1).cast("int")).alias("split"), seq.alias("ordinal"),
    )


def materialize(spec: DataFrame, templates: DataFrame) -> DataFrame:
    """Spec rows filled into their family template, kept apart by a candidate status.

    spec: (id, split, ordinal, family, value); templates: (family, text, contract) with ``{value}`` marks.
    """
    fill = lambda c: F.replace(F.col(c), F.lit("{value}"), F.col("value"))
    df = spec.join(templates, "family").select(
        "id", "split", "ordinal", fill("text").alias("input_text"), fill("contract").alias("target"), F.array().cast("array<string>").alias("augmentations"),
        F.create_map(F.lit("candidate_family"), F.col("family"), F.lit("source_mode"), F.lit("candidate"), F.lit("status"), F.lit("pending_review")).alias("provenance"),
    )
    return df.withColumn("unsafe_rule", first_unsafe(F.concat_ws("\n", "input_text", "target")))


def promote(candidates: DataFrame, origin: str) -> DataFrame:
    """Rewrite the provenance status and keep where the seed came from."""
    kept = F.map_filter("provenance", lambda k, _v: ~k.isin("status", "source_mode", "promoted_from"))
    fresh = F.create_map(F.lit("status"), F.lit("promoted"), F.lit("source_mode"), F.lit("sanitized_seed"), F.lit("promoted_from"), F.lit(origin))
    return candidates.withColumn("provenance", F.map_concat(kept, fresh))


def clashes(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate ids that already exist."""
    return candidates.select("id").join(base.select("id"), "id", "left_semi")


def merge(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Base plus candidates; refuses clashing ids."""
    if not clashes(base, candidates).isEmpty():
        raise ValueError("candidate ids already exist in the base set")
    return base.unionByName(candidates, allowMissingColumns=True)


def preview(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Before / after row counts per split without writing anything."""
    tag = lambda df, n: df.select("split", F.lit(n).alias("side"))
    both = tag(base, "base").unionByName(tag(candidates, "new"))
    agg = both.groupBy("split").agg(F.count_if(F.col("side") == "base").alias("before"), F.count("*").alias("after"))
    return agg.withColumn("added", F.col("after") - F.col("before"))


def cohort_summary(seeds: DataFrame) -> DataFrame:
    """Seeds, splits and families per cohort (source mode and status)."""
    at = lambda k: F.coalesce(F.element_at("provenance", k), F.lit("none"))
    return seeds.groupBy(at("source_mode").alias("source_mode"), at("status").alias("status"), "split").agg(
        F.count("*").alias("seeds"), F.count_distinct(F.coalesce(*[F.element_at("provenance", k) for k in C.FAMILY_KEYS], F.lit("none"))).alias("families")
    )


def challenge_grid(scopes: DataFrame, repeats: int) -> DataFrame:
    """Adversarial rows: scopes x repeats x conditions with text and expected verification class.

    scopes: (task_type, route, slot_path, prefix). Conditions and repeats are exploded, not joined.
    """
    # ---- fixed values: condition and the class its gold value must get
    expected = {
        "exact_unique": C.EXACT_UNIQUE, "duplicate_exact": C.AMBIGUOUS, "source_absent": C.NOT_FOUND, "partial_span_trap": C.AMBIGUOUS,
        "normalization_candidate": C.NORMALIZED_UNIQUE, "normalization_collision": C.AMBIGUOUS,
    }
    cond = F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), F.lit(v).alias("expected")) for k, v in expected.items()]))
    df = scopes.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("n")).select("*", cond.alias("c")).select("*", "c.*").drop("c")
    num = F.format_string("%03d", F.col("n"))
    c = F.col("condition")
    value = F.when(c.startswith("normalization"), F.concat(F.lit("AB"), num)).otherwise(F.concat("prefix", num))
    df = df.withColumn("value", value).withColumn("num", num)
    v = F.col("value")
    text = (
        F.when(c == "duplicate_exact", F.concat(F.lit("first "), v, F.lit(" then "), v))
        .when(c == "source_absent", F.lit("nothing to copy here"))
        .when(c == "partial_span_trap", F.concat(F.lit("long "), v, F.lit("x, short "), v))
        .when(c == "normalization_candidate", F.concat(F.lit("spelled A B "), F.col("num")))
        .when(c == "normalization_collision", F.concat(F.lit("spelled A B "), F.col("num"), F.lit(" and A-B-"), F.col("num")))
        .otherwise(F.concat(F.lit("copy "), v, F.lit(" only")))
    )
    df = df.withColumn("input_text", text)
    blank = F.replace(F.col("input_text"), v, F.lit("{slot}"))
    return df.withColumn("template_signature", F.sha2(F.concat_ws("|", "task_type", "route", "slot_path", blank), 256)).withColumn(
        "stripped_signature", F.sha2(blank, 256)
    )
