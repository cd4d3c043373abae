"""Observe-only sidecar over a stream of predictions.

Each micro-batch goes through the batch operators, so the stream and the batch give the same
rows. Nothing is dropped: an unusable input becomes a status. Every batch is written under its
own id, so a replay after a failure overwrites instead of appending twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlane.functions.contract import contract_valid, is_one_json_value, parse_contract
from pactlane.operators.common import count_if, fits, stored
from pactlane.operators.provenance import diagnostics, sidecars, slot_table

PREDICTION_SCHEMA = "arm string, id string, ordinal long, split string, input_text string, raw string"


def hook_status(enabled: bool = True, policy_ok: bool = True) -> tuple[Column, Column]:
    """(status, error code) of one prediction, by ordered rules."""
    blank = F.col("raw").isNull() | F.col("raw").rlike(r"(?U)^\s*$")
    rules = [
        (F.lit(not enabled), "SKIPPED_DISABLED", None),
        (F.coalesce(F.col("input_text"), F.lit("")) == "", "SHADOW_INVALID_INPUT", "source_text_missing"),
        (F.lit(not policy_ok), "SHADOW_POLICY_INVALID", "policy_load_or_validation_failed"),
        (blank, "SHADOW_INVALID_INPUT", "prediction_empty"),
        (~is_one_json_value(F.col("raw")), "SHADOW_INVALID_INPUT", "prediction_malformed_json"),
        (~F.col("p.is_object"), "SHADOW_INVALID_INPUT", "prediction_unsupported_type"),
        (~F.col("schema_valid"), "SHADOW_INVALID_CONTRACT", "prediction_schema_invalid"),
    ]
    status, code = F.lit("COMPLETED"), F.lit(None).cast("string")
    for cond, name, error in reversed(rules):
        status, code = F.when(cond, F.lit(name)).otherwise(status), F.when(cond, F.lit(error)).otherwise(code)
    return status, code


def outcomes(preds: DataFrame, policy: DataFrame, enabled: bool = True, policy_ok: bool = True) -> DataFrame:
    """One outcome row per prediction with its sidecar counts and diagnostics."""
    # what follows from source and prediction is found once per distinct pair of them; ids may repeat within a batch
    texts = [F.col("input_text"), F.col("raw")]
    marks = [c.isNull() for c in texts]
    keys = {"key_a": F.xxhash64(*marks, *texts), "key_b": F.xxhash64(F.lit("pair"), *marks, *texts)}
    parts = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # every step is written, so that none is run again by each frame that reads it
    pairs = stored(preds.select("input_text", "raw").distinct().withColumns(keys), "hook-pairs").repartition(parts, *keys)
    parsed = contract_valid(parse_contract(pairs, "raw", "p"), "p")
    status, code = hook_status(enabled, policy_ok)
    parsed = stored(parsed.withColumn("hook_status", status).withColumn("error_code", code), "hook-parsed")
    usable = parsed.where("hook_status = 'COMPLETED'").withColumns(
        {"id": F.struct(*keys), "arm": F.lit(""), "split": F.lit(""), "ordinal": F.lit(0).cast("long")}
    )
    cars = sidecars(diagnostics(slot_table(usable), policy)).select("id.*", "trusted_count", "candidate_count", "slot_diagnostics")
    found = parsed.select(*keys, F.sha2("input_text", 256).alias("input_hash"), "hook_status", "error_code").join(cars, [*keys], "left")
    found = fits(stored(found, "hook-found"), OUTCOME_BYTES)
    rows = preds.select("arm", "id", "ordinal", "split", *[c.alias(k) for k, c in keys.items()]).join(found, [*keys])
    return rows.drop(*keys).na.fill(0, ["trusted_count", "candidate_count"])


OUTCOME_BYTES = 600  # of an outcome with its diagnostics


def outcome_summary(rows: DataFrame) -> DataFrame:
    """Counts by status and error code."""
    return rows.groupBy("arm", "hook_status", F.coalesce("error_code", F.lit("none")).alias("error_code")).agg(
        F.count("*").alias("invocations"), F.sum("trusted_count").cast("bigint").alias("trusted"),
        F.sum("candidate_count").cast("bigint").alias("candidates"), count_if(F.col("hook_status").startswith("SHADOW_")).alias("isolated"),
    )


def start_sidecar_stream(preds: DataFrame, policy: DataFrame, out: str, checkpoint: str, enabled: bool = True, once: bool = True):
    """Start the query: Parquet per micro-batch under ``out``; a null sink when ``out`` is empty.

    A batch that is run again has the same id and the same input and replaces its own folder, so a
    reader of ``out`` sees every row once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = outcomes(batch, policy, enabled)
        if out:
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        else:
            rows.write.format("noop").mode("overwrite").save()

    writer = preds.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def forget_last_commit(spark: SparkSession, checkpoint: str) -> int:
    """Take back the commit of the last batch, as if the driver had died before it was written; the next
    start runs that batch again. Returns its id (-1 without a commit)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().isdigit()]
    last = max(found, key=lambda p: int(p.getName()), default=None)
    if last is None:
        return -1
    store.delete(last, False)
    return int(last.getName())
