"""Paired inputs of two arms and the first difference between two bundles of them.

A bundle is compared by digest trees. A leaf sums up the rows of one ordinal, and every level above
sums up 1024 neighbours of the one below, for ids, inputs, gold and outputs apart. Sums of hashes do
not depend on the order of rows and combine before the shuffle, so a repeated ordinal is no hot
group. Two trees are compared from the root: only nodes that differ are read on the way down, and
the leaves of one node at last name the row.

Defined results: a row that is absent or repeated on one side differs in every kind; null values are
values like others; bundles of no rows agree. Ordinals are non-negative integers; they may have gaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.functions.canonical import canonical_json
from pactlane.operators.common import count_if, fits, stored
from pactlane.operators.evaluate import PAIR

KINDS = ("id", "input", "gold", "output")
FAN_BITS = 10


def assemble(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per arm and gold row: input, gold and output with their hashes and the parse status.

    gold: (id, ordinal, split, input_text, gold); predicted: (arm, id, raw, schema_valid), one row per
    arm and gold id, ``raw`` null without a prediction.
    """
    kept = gold.withColumn("gold", canonical_json("gold"))
    kept = kept.select(
        "id", "ordinal", "split", "input_text", F.sha2("input_text", 256).alias("input_hash"), "gold", F.sha2("gold", 256).alias("gold_hash")
    )
    out = predicted.select("arm", "id", "raw", F.sha2("raw", 256).alias("output_hash"), _status().alias("parse_status"))
    return kept.join(out, "id")


def assemble_once(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``assemble`` from rows that share their texts: ``rows`` of ``evaluate.paired`` and what follows from
    each pair of texts (gold, raw, schema_valid), so that gold is rendered and hashed once a pair."""
    once = judged.select(*PAIR, canonical_json("gold").alias("gold"), "raw", "schema_valid")
    once = once.select(*PAIR, "gold", F.sha2("gold", 256).alias("gold_hash"), "raw", F.sha2("raw", 256).alias("output_hash"), _status().alias("parse_status"))
    once = stored(once, "hashed-pairs")
    kept = rows.select("id", "ordinal", "split", "input_text", F.sha2("input_text", 256).alias("input_hash"), "arm", *PAIR)
    return kept.join(fits(once, PAIR_BYTES), PAIR).select(
        "id", "ordinal", "split", "input_text", "input_hash", "gold", "gold_hash", "arm", "raw", "output_hash", "parse_status"
    )


PAIR_BYTES = 400  # of a pair with the hashes that a query reads


def _status() -> Column:
    return F.when(F.col("raw").isNull(), F.lit("absent")).when(F.col("schema_valid"), F.lit("valid")).otherwise(F.lit("invalid"))


def bundle_hash(*parts: Column) -> tuple[Column, Column]:
    """Two independent 63-bit hashes of a row's part, as numbers whose sums stay exact."""
    return tuple(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 1).cast("decimal(20,0)") for seed in (1, 2))


@dataclass
class Tree:
    """Levels of sums, leaves first: (arm, split, node, n, and two sums per kind)."""

    levels: list[DataFrame]
    rows: DataFrame


def tree(rows: DataFrame, name: str) -> Tree:
    """Digest tree of an assembled bundle; every level is a stored table ordered by node."""
    sums = {}
    for kind, value in zip(KINDS, ("id", "input_hash", "gold_hash", "output_hash"), strict=True):
        for k, h in enumerate(bundle_hash("ordinal", F.col(value))):
            sums[f"{kind}_{k}"] = F.sum(h).cast("decimal(38,0)").alias(f"{kind}_{k}")
    level = rows.groupBy("arm", "split", F.col("ordinal").alias("node")).agg(F.count("*").alias("n"), *sums.values())
    levels = [stored(level.repartitionByRange("arm", "split", "node").sortWithinPartitions("arm", "split", "node"), f"{name}-leaves")]
    while True:
        top = levels[-1]
        if len(levels) > 1 and (top.agg(F.max("node")).first()[0] or 0) == 0:
            return Tree(levels, rows)
        up = top.groupBy("arm", "split", F.shiftright("node", FAN_BITS).alias("node"))
        up = up.agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in sums])
        levels.append(stored(up.sortWithinPartitions("arm", "split", "node"), f"{name}-level"))


def _differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes on either side with a flag for each kind that differs."""
    keys = ["arm", "split", "node"]
    digest = {k: F.struct("n", f"{k}_0", f"{k}_1") for k in KINDS}
    side = lambda df, s: df.select(*keys, *[d.alias(f"{s}_{k}") for k, d in digest.items()])
    both = side(left, "l").join(side(right, "r"), keys, "full_outer")
    return both.select(*keys, *[(~F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))).alias(k) for k in KINDS])


def _first(differing: DataFrame) -> dict[tuple, int]:
    """Least differing node of each arm, split and kind: a few values for each split."""
    found = differing.groupBy("arm", "split").agg(*[F.min(F.when(F.col(k), F.col("node"))).alias(k) for k in KINDS]).collect()
    return {(r["arm"], r["split"], k): r[k] for r in found for k in KINDS if r[k] is not None}


def _below(level: DataFrame, nodes: dict[tuple, int]) -> DataFrame:
    """Children of the given nodes only: ranges of ``node`` that the reader can skip by."""
    wanted = F.lit(False)
    for arm, split, node in sorted({(a, s, n) for (a, s, _), n in nodes.items()}):
        inside = (F.col("node") >= node << FAN_BITS) & (F.col("node") < (node + 1) << FAN_BITS)
        wanted = wanted | ((F.col("arm") == arm) & (F.col("split") == split) & inside)
    return level.where(wanted)


def first_differences(left: Tree, right: Tree) -> DataFrame:
    """(arm, split, kind, ordinal, left_ids, right_ids) of the first row that differs, by kind."""
    spark = left.rows.sparkSession
    height = max(len(left.levels), len(right.levels))
    pad = lambda t: t.levels + [t.levels[-1]] * (height - len(t.levels))
    nodes: dict[tuple, int] = {}
    for k, (a, b) in enumerate(zip(reversed(pad(left)), reversed(pad(right)), strict=True)):
        if k:
            if not nodes:
                break
            a, b = _below(a, nodes), _below(b, nodes)
        found = _first(_differences(a, b))
        # a child counts for the kinds whose parent led to it
        nodes = {key: n for key, n in found.items() if not k or n >> FAN_BITS == nodes.get(key)}
    schema = "arm string, split string, kind string, ordinal long"
    hits = spark.createDataFrame([(*key, n) for key, n in sorted(nodes.items())], schema)
    ids = lambda t, out: _below_rows(t.rows, nodes).groupBy("arm", "split", "ordinal").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias(out))
    keys = ["arm", "split", "ordinal"]
    return hits.join(ids(left, "left_ids"), keys, "left").join(ids(right, "right_ids"), keys, "left").select("arm", "split", "kind", "ordinal", "left_ids", "right_ids")


def _below_rows(rows: DataFrame, nodes: dict[tuple, int]) -> DataFrame:
    return rows.where(F.col("ordinal").isin(sorted(set(nodes.values()))))


def boundary(gold: DataFrame, bundle: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per arm and split whether a bundle belongs to its gold rows, with the reasons that block it.

    Ids, inputs and gold are compared as multisets through two sums of hashes, so no list is held or
    joined. ``expected`` (split, row_count) is a manifest.
    """
    def sums(df: DataFrame, by: list[str], out: str) -> DataFrame:
        parts = {"ids": [F.col("id")], "inputs": [F.col("id"), F.col("input_hash")], "golds": [F.col("id"), F.col("gold_hash")], "order": [F.col("ordinal"), F.col("id"), F.col("gold_hash")]}
        aggs = [F.struct(*[F.sum(h) for h in bundle_hash(F.lit(name), *cols)]).alias(f"{out}_{name}") for name, cols in parts.items()]
        return df.groupBy(*by).agg(F.count("*").alias(f"{out}_rows"), *aggs)

    repeated = bundle.groupBy("arm", "split", "id").agg(F.count("*").alias("n")).groupBy("arm", "split").agg(count_if(F.col("n") > 1).alias("repeated_ids"))
    invalid = bundle.groupBy("arm", "split").agg(*[count_if(F.col("parse_status") == s).alias(f"{s}_outputs") for s in ("valid", "invalid", "absent")])
    hashed = gold.select("id", "split", "ordinal", F.sha2("input_text", 256).alias("input_hash"), F.sha2(canonical_json("gold"), 256).alias("gold_hash"))
    out = sums(bundle, ["arm", "split"], "own").join(repeated, ["arm", "split"]).join(invalid, ["arm", "split"]).join(sums(hashed, ["split"], "gold"), "split", "left")
    if expected is not None:
        out = out.join(expected.select("split", F.col("row_count").alias("expected_rows")), "split", "left")
    else:
        out = out.withColumn("expected_rows", F.col("gold_rows"))
    same = lambda name: F.col(f"own_{name}").eqNullSafe(F.col(f"gold_{name}"))
    reasons = [
        F.when(~F.col("own_rows").eqNullSafe(F.col("expected_rows")), F.lit("row_count_mismatch")),
        F.when(F.col("repeated_ids") > 0, F.lit("repeated_ids")),
        F.when(~same("ids"), F.lit("id_mismatch")),
        F.when(~same("inputs"), F.lit("input_mismatch")),
        F.when(~same("golds"), F.lit("gold_mismatch")),
        F.when(~same("order"), F.lit("ordered_hash_mismatch")),
    ]
    listed = F.array_join(F.array_compact(F.array(*reasons)), ",")
    return out.select(
        "arm", "split", F.col("own_rows").alias("row_count"), "repeated_ids", "valid_outputs", "invalid_outputs", "absent_outputs",
        same("ids").alias("ids_match"), same("inputs").alias("inputs_match"), same("golds").alias("gold_match"), listed.alias("blocking_reasons"),
    )
