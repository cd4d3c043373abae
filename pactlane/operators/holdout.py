"""Held-out sets: content hashes, row and manifest checks, contamination and ancestry joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlane.functions import canonical as J
from pactlane.functions import constants as C
from pactlane.functions import text as T
from pactlane.functions.contract import contract_valid, json_literal, parse_contract
from pactlane.operators.common import beside, facts_beside, places, union_all

BLANK = r"(?U)^[\s\x1c-\x1f]*$"
FAN_BITS = 10  # digests joined into one of the next level: 1024
LEVELS = 7  # 2**70 values


def _text(v: str, path: str) -> Column:
    """String field of the VARIANT column ``v``; NULL unless a non-blank JSON string."""
    got = F.try_variant_get(v, path, "variant")
    body = F.when(F.schema_of_variant(got) == "STRING", got.cast("string"))
    return F.when(~body.rlike(BLANK), body)


def read_rows(raw_rows: DataFrame) -> DataFrame:
    """Parse held-out or reference rows given as JSON text in ``raw`` with an ``ordinal``."""
    df = raw_rows.select("ordinal", "raw", F.try_parse_json("raw").alias("__v"))
    v = "__v"
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    nested = F.coalesce(*[_text(v, f"$.provenance.{k}") for k in C.FAMILY_KEYS])
    return df.select(
        "ordinal", "raw",
        _text(v, "$.row_id").alias("row_id"),
        _text(v, "$.id").alias("id"),
        _text(v, "$.semantic_family_id").alias("family_field"),
        F.coalesce(_text(v, "$.semantic_family_id"), nested).alias("family_id"),
        _text(v, "$.input_text").alias("input_text"),
        _text(v, "$.content_hash").alias("declared_hash"),
        F.get_json_object("raw", "$.gold_contract").alias("gold_contract"),
        F.array_contains(F.json_object_keys("raw"), "gold_contract").alias("has_gold"),
        F.when(kind("$.derived_from").startswith("ARRAY"), F.get_json_object("raw", "$.derived_from")).alias("derived_from"),
        F.when(kind("$.analysis_seen") == "BOOLEAN", F.try_variant_get(v, "$.analysis_seen", "boolean")).alias("analysis_seen"),
        kind("$.source").startswith("OBJECT").alias("has_source"),
        _text(v, "$.source.category").alias("source_category"),
        F.json_object_keys(F.get_json_object("raw", "$.source.provenance")).alias("source_provenance"),
        F.array(*[_text(v, f"$.provenance.{k}") for k in C.LINEAGE_KEYS]).alias("lineage"),
        F.array(*[F.get_json_object("raw", f"$.provenance.{k}") for k in C.LINEAGE_LIST_KEYS]).alias("lineage_lists"),
    )


def content_hash(raw: Column) -> Column:
    """SHA-256 of the canonical row without its hash and with order-free ancestry."""
    return F.sha2(J.row_hash_payload(raw), 256)


def numbered(df: DataFrame) -> DataFrame:
    """Add ``place``: 0, 1, 2 ... in ``ordinal`` order, from counts of sampled ranges of ordinals."""
    return places(df, ["ordinal"])


def ordered_hash(df: DataFrame, value: str, style: str = "json") -> DataFrame:
    """Digest over values in ``ordinal`` order, of JSON literals or of newline-ended lines.

    A tree of digests: every value is hashed, and 1024 neighbours at a time are joined by commas and
    hashed again until one root is left. It differs from a digest over one long list on purpose, since
    that can only be made in one task; no task here holds more than 1024 digests.
    """
    leaf = json_literal(F.col(value)) if style == "json" else F.concat(F.col(value), F.lit("\n"))
    leaves = df.where(F.col(value).isNotNull()).select("ordinal", F.sha2(leaf, 256).alias("h"))
    level = numbered(leaves).select("place", "h", F.lit(1).cast("bigint").alias("n"))
    for _ in range(LEVELS):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda e: e["h"]), ",")
        level = level.groupBy(F.shiftright("place", FAN_BITS).alias("up")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
        level = level.select(F.col("up").alias("place"), "h", "n")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("ordered_hash"))


def freeze(raw_rows: DataFrame) -> DataFrame:
    """Rows with their content hash."""
    return raw_rows.select("*", content_hash(F.col("raw")).alias("content_hash"))


def freeze_manifest(raw_rows: DataFrame) -> DataFrame:
    """Row count, family count and lockbox hash of a frozen set."""
    hashed = freeze(raw_rows)
    fam = read_rows(raw_rows).agg(F.count_distinct("family_id").alias("family_count"))
    return beside(ordered_hash(hashed, "content_hash"), fam)


def row_failures(parsed: DataFrame) -> DataFrame:
    """(category, row_id, message) per violated row rule."""
    rid = F.coalesce("row_id", F.concat(F.lit("<row-"), F.col("ordinal"), F.lit(">")))
    entry = lambda cond, category, message: F.when(
        cond, F.struct(F.lit(category).alias("category"), F.lit(message).alias("message"))
    )
    no = lambda name: F.col(name).isNull()
    source = F.col("has_source") == F.lit(True)
    forbidden = F.lower(T.strip_ws(F.col("source_category"))).isin(*C.FORBIDDEN_SOURCES)
    df = contract_valid(parse_contract(parsed, "gold_contract", "c"), "c")
    df = df.withColumn("expected_hash", F.when(~F.col("has_gold") | F.col("schema_valid"), content_hash(F.col("raw"))))
    rules = F.array(
        entry(no("row_id"), "missing_required_field", "row_id is required"),
        entry(no("family_field"), "missing_required_field", "semantic_family_id is required"),
        entry(no("input_text"), "missing_required_field", "input_text is required"),
        entry(~F.col("has_gold"), "missing_required_field", "gold_contract is required"),
        entry(no("derived_from"), "missing_required_field", "derived_from must be a list"),
        entry(no("analysis_seen"), "missing_required_field", "analysis_seen must be a boolean"),
        entry(F.col("analysis_seen") == F.lit(True), "analysis_seen_violation", "final lockbox rows must set analysis_seen=false"),
        entry(~F.coalesce(source, F.lit(False)), "missing_provenance", "source must contain category and provenance"),
        entry(source & no("source_category"), "missing_provenance", "source.category is required"),
        entry(source & forbidden, "forbidden_source_category", "lockbox row source.category must not be train, analysis, or remediation"),
        entry(source & (F.coalesce(F.size("source_provenance"), F.lit(0)) <= 0), "missing_provenance", "source.provenance must be a non-empty object"),
        entry(F.col("has_gold") & ~F.col("schema_valid"), "ValidationError", "gold_contract is not a valid contract"),
        entry(no("declared_hash"), "missing_required_field", "content_hash is required"),
        entry(
            F.col("declared_hash") != F.col("expected_hash"), "content_hash_mismatch",
            "declared content_hash does not match deterministic row hash",
        ),
    )
    return df.select(rid.alias("row_id"), "ordinal", F.explode(F.array_compact(rules)).alias("f")).select("row_id", "ordinal", "f.*")


def duplicates(parsed: DataFrame, column: str, category: str) -> DataFrame:
    """Second and later occurrences of a value, pointing at the first."""
    first = parsed.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("n")).where("n > 1")
    hit = parsed.join(first.drop("n"), column).where(F.col("ordinal") > F.col("first_ordinal"))
    rid = F.coalesce("row_id", F.concat(F.lit("<row-"), F.col("ordinal"), F.lit(">")))
    return hit.select(rid.alias("row_id"), "ordinal", F.lit(category).alias("category"), F.concat(F.lit("first at "), "first_ordinal").alias("message"))


def reference_pool(parsed: DataFrame, source: str) -> DataFrame:
    """Reference rows with derived keys: ids, lineage ids, normalised text, family."""
    ids = F.array_compact(F.array("id", "row_id"))
    lists = F.flatten(F.transform(F.array_compact("lineage_lists"), lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))))
    return parsed.select(
        F.lit(source).alias("reference_source"),
        F.coalesce("row_id", "id", F.lit("<unknown>")).alias("reference_row_id"),
        ids.alias("reference_ids"),
        F.array_distinct(F.concat(ids, F.array_compact("lineage"), lists)).alias("lineage_ids"),
        F.coalesce("input_text", F.lit("")).alias("input_text"),
        T.holdout_text(F.coalesce("input_text", F.lit(""))).alias("normalized_text"),
        F.coalesce("family_id", F.lit("")).alias("family_id"),
    )


def overlaps(held: DataFrame, pool: DataFrame, by_family: bool = False) -> DataFrame:
    """One failure per (held-out row, reference row) equal on id, text, normalised text or family.

    Every key becomes (kind, value) rows, so all kinds share one equi join. The result names every
    pair, so a text held n times here and m times there gives n * m failures.
    """

    def keys(df: DataFrame, ids: Column, keep: list[str]) -> DataFrame:
        pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        arr = F.concat(
            F.transform(ids, lambda x: F.struct(F.lit("row_id_overlap").alias("kind"), x.alias("value"))),
            F.array(
                pair("exact_input_text_overlap", F.col("input_text")),
                pair("normalized_input_text_overlap", F.col("normalized_text")),
                *([pair("semantic_family_overlap", F.col("family_id"))] if by_family else []),
            ),
        )
        hashed = df.select(*keep, F.explode(arr).alias("k")).where("k.value IS NOT NULL AND k.value <> ''")
        return hashed.select(*keep, "k.kind", F.sha2("k.value", 256).alias("value"))

    left = keys(held, F.array("row_id"), ["row_id"])
    right = keys(pool, F.col("reference_ids"), ["reference_row_id", "reference_source"])
    return left.join(right, ["kind", "value"]).select("row_id", F.col("kind").alias("category"), "reference_row_id", "reference_source")


def held_keys(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        F.coalesce("row_id", F.concat(F.lit("<row-"), F.col("ordinal"), F.lit(">"))).alias("row_id"),
        "input_text", T.holdout_text(F.col("input_text")).alias("normalized_text"), F.coalesce("family_id", F.lit("")).alias("family_id"),
    )


def forbidden_ancestry(parsed: DataFrame, pool: DataFrame) -> DataFrame:
    """Ancestors that are reference or lineage ids, or name a forbidden source."""
    rid = F.coalesce("row_id", F.concat(F.lit("<row-"), F.col("ordinal"), F.lit(">")))
    ancestors = parsed.where("derived_from IS NOT NULL").select(
        rid.alias("row_id"), F.explode(F.array_distinct(J.ancestor_ids(F.col("derived_from")))).alias("ancestor")
    )
    low = F.lower(T.strip_ws(F.col("ancestor")))
    word = low.isin(*C.FORBIDDEN_SOURCES) | low.rlike(r"(?U)\b(train|training|analysis|remediation)\b")
    ids = pool.select(F.explode(F.array_distinct(F.concat("reference_ids", F.array("reference_row_id"), "lineage_ids"))).alias("ancestor")).distinct()
    by_id = ancestors.join(ids, "ancestor", "left_semi").select("row_id", "ancestor")
    return ancestors.where(word).select("row_id", "ancestor").unionByName(by_id).distinct()


def manifest_failures(raw_rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest row (JSON text ``raw``) against the one-row aggregate of the set."""
    facts = freeze_manifest(raw_rows)
    manifest = manifest.select("raw", F.sha2("raw", 256).alias("m_id"))
    listed = manifest.select("m_id", F.posexplode(F.from_json(F.get_json_object("raw", "$.content_hashes"), "array<string>")).alias("place", "h"))
    own = numbered(freeze(raw_rows).select("ordinal", "content_hash")).select("place", "content_hash")
    # a list that names every row's hash in order: as many entries, and each equal to the row's at its place
    agree = listed.distinct().join(own, "place", "left").groupBy("m_id").agg(
        F.count("*").alias("listed"), F.coalesce(F.bool_and(F.coalesce(F.col("h") == F.col("content_hash"), F.lit(False))), F.lit(True)).alias("equal")
    )
    m = facts_beside(facts, manifest.select("raw", "m_id", F.try_parse_json("raw").alias("__m"))).join(agree, "m_id", "left")
    get = lambda path, kind: F.try_variant_get("__m", path, kind)
    text = lambda path: _text("__m", path)
    declared = F.from_json(F.get_json_object("raw", "$.content_hashes"), "array<string>")
    matched = (F.coalesce("listed", F.lit(0)) == F.col("row_count")) & F.coalesce("equal", F.lit(True))
    entry = lambda cond, category, message: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(category).alias("category"), F.lit(message).alias("message")))
    frozen = (F.schema_of_variant(get("$.frozen", "variant")) == "BOOLEAN") & get("$.frozen", "boolean")
    hash_rules = [
        entry(text(f"$.{f}") != F.col("ordered_hash"), "manifest_hash_mismatch", f"manifest {f} must match the ordered row hashes")
        for f in C.MANIFEST_HASH_FIELDS
    ]
    rules = F.array(
        entry(~F.coalesce(frozen, F.lit(False)), "manifest_not_frozen", "final lockbox manifest must set frozen=true"),
        entry(~get("$.row_count", "bigint").eqNullSafe(F.col("row_count")), "manifest_count_mismatch", "manifest row_count must match lockbox row count"),
        entry(~get("$.family_count", "bigint").eqNullSafe(F.col("family_count")), "manifest_family_count_mismatch", "manifest family_count must match unique families"),
        entry(F.coalesce(text("$.schema_version"), text("$.schema_id")).isNull(), "manifest_schema_missing", "manifest must declare schema_version or schema_id"),
        entry(F.coalesce(text("$.created_at"), text("$.frozen_at")).isNull(), "manifest_timestamp_missing", "manifest must declare created_at or frozen_at"),
        entry(F.coalesce(F.size(F.json_object_keys(F.get_json_object("raw", "$.provenance_summary"))), F.lit(0)) <= 0, "manifest_provenance_summary_missing", "provenance_summary must be a non-empty object"),
        entry(F.coalesce(*[text(f"$.{f}") for f in C.MANIFEST_HASH_FIELDS]).isNull(), "manifest_hash_mismatch", "manifest must declare a set hash"),
        entry(declared.isNotNull() & ~matched, "manifest_hash_mismatch", "content_hashes must match row hashes in order"),
        *hash_rules,
    )
    mid = F.coalesce(text("$.manifest_id"), F.lit("manifest"))
    missing = F.array(entry(F.col("absent"), "manifest_missing", "a manifest is required"))
    rules = F.when(F.col("absent"), missing).otherwise(rules)
    return m.select(mid.alias("row_id"), F.explode(F.array_compact(rules)).alias("f")).select("row_id", "f.*")


def validate(raw_rows: DataFrame, manifest: DataFrame, train: DataFrame, analysis: DataFrame, by_family: bool = False) -> DataFrame:
    """All held-out failures as (row_id, category, message)."""
    parsed = read_rows(raw_rows)
    pool = reference_pool(read_rows(train), "train").unionByName(reference_pool(read_rows(analysis), "analysis"))
    over = overlaps(held_keys(parsed), pool, by_family).select(
        "row_id", "category", F.concat(F.col("reference_source"), F.lit(":"), "reference_row_id").alias("message")
    )
    anc = forbidden_ancestry(parsed, pool).select("row_id", F.lit("forbidden_ancestry").alias("category"), F.col("ancestor").alias("message"))
    pick = lambda df: df.select("row_id", "category", "message")
    return union_all(
        [
            pick(row_failures(parsed)), pick(duplicates(parsed, "row_id", "duplicate_row_id")),
            pick(duplicates(parsed, "declared_hash", "duplicate_content_hash")), over, anc, manifest_failures(raw_rows, manifest),
        ]
    )


def evaluation_rows(raw_rows: DataFrame) -> DataFrame:
    """Held-out rows in evaluation shape: every row in the test split."""
    p = read_rows(raw_rows)
    return p.select(
        F.col("row_id").alias("id"), F.lit("test").alias("split"), "ordinal", "input_text", F.col("gold_contract").alias("gold"),
        F.col("family_id").alias("source_id"),
    )
