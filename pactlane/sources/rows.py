"""Row files, predictions and result tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlane.functions import canonical as J
from pactlane.functions import constants as C
from pactlane.functions.contract import contract_valid, is_one_json_value, parse_contract


def read_jsonl(spark: SparkSession, path: str, fail: bool = True) -> DataFrame:
    """Non-blank lines of row files as (file, ordinal, raw); bad rows fail or are left to ``bad_rows``.

    ``ordinal`` is a text that sorts by file name, place of the block in the file and line in the block.
    """
    place = F.format_string("%020d-%011d", F.col("_metadata.file_block_start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.concat_ws("-", "_metadata.file_path", place).alias("ordinal"), F.col("value").alias("raw"))
    df = df.where(~F.col("raw").rlike(r"(?U)^[\s\x1c-\x1f]*$"))
    good = is_one_json_value(F.col("raw")) & F.json_object_keys("raw").isNotNull()
    if not fail:
        return df.where(good)
    message = F.concat(F.col("file"), F.lit(": not a JSON object row: "), F.left("raw", F.lit(80)))
    return df.withColumn("raw", F.when(good, F.col("raw")).otherwise(F.raise_error(message)))


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """Quarantine: lines that are not one JSON object."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    blank = F.col("raw").rlike(r"(?U)^[\s\x1c-\x1f]*$")
    return df.where(~blank & ~(is_one_json_value(F.col("raw")) & F.json_object_keys("raw").isNotNull()))


def write_jsonl(df: DataFrame, path: str, column: str | None = None) -> None:
    """One JSON object per line with sorted keys, non-ASCII kept."""
    body = F.col(column) if column else F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(J.spaced_json(body).alias("value")).write.text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A single JSON object as one row of text."""
    df = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"))
    return df.withColumn("raw", F.when(F.json_object_keys("raw").isNotNull(), F.col("raw")).otherwise(F.raise_error(F.lit("a JSON object is required"))))


def load_rows(raw: DataFrame, split: str | None = None) -> DataFrame:
    """Typed training rows with a contract verdict, optionally one split."""
    text = lambda k: F.get_json_object("raw", f"$.{k}").alias(k)
    df = raw.select(
        "ordinal", text("id"), text("split"), text("input_text"), F.get_json_object("raw", "$.target_contract").alias("gold"),
        F.from_json(F.get_json_object("raw", "$.provenance"), "map<string,string>").alias("provenance"),
    )
    df = df.where(F.col("split") == split) if split else df
    df = df.withColumn("source_id", F.coalesce(F.element_at("provenance", "source_id"), "id"))
    return contract_valid(parse_contract(df, "gold", "__c"), "__c").drop("__c", "semantic_valid")


def load_predictions(raw: DataFrame, arm: str = "run") -> DataFrame:
    """(arm, id, ordinal, raw): ``prediction`` else ``contract`` else the rest of the record; last id wins."""
    settled = raw.withColumn("raw", J.settle_duplicate_keys(F.col("raw")))
    keys = F.json_object_keys("raw")
    has = lambda k: F.array_contains(keys, k)
    rest = F.to_json(F.map_filter(F.from_json("raw", "map<string,variant>"), lambda k, _v: k != "id"))
    body = F.when(has("prediction"), F.get_json_object("raw", "$.prediction")).when(has("contract"), F.get_json_object("raw", "$.contract")).otherwise(rest)
    df = settled.select(F.coalesce(F.get_json_object("raw", "$.id"), F.lit("")).alias("id"), "ordinal", body.alias("body"))
    return df.groupBy("id").agg(F.max_by("body", "ordinal").alias("raw"), F.max("ordinal").alias("ordinal")).select(F.lit(arm).alias("arm"), "id", "ordinal", "raw")


def write_predictions(preds: DataFrame, path: str) -> None:
    line = F.concat(F.lit('{"id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"prediction":'), "raw", F.lit("}"))
    preds.select(line.alias("value")).write.text(path)


def write_corpus(rows: DataFrame, pairs: DataFrame, path: str) -> None:
    """Split-partitioned rows and pairs, so a split-scoped read touches only its folder."""
    rows.write.partitionBy("split").parquet(f"{path}/rows")
    pairs.write.partitionBy("split").parquet(f"{path}/pairs")


def write_metrics(tidy: DataFrame, path: str, run: str) -> None:
    """Append (run, arm, split, metric, value) results."""
    tidy.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def write_tree(files: DataFrame, root: str) -> None:
    """Write (path, content as bytes) as files below ``root``; tasks write their own files, and a
    repeated task writes the same ones again."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths = batch.column(0).to_pylist()
            for path, content in zip(paths, batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    files.select("path", F.col("content").cast("binary")).mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Every decodable file under a folder as (path, text), tool folders skipped."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    skipped = F.exists(F.split("path", "/"), lambda p: p.isin(*C.SKIPPED_DIRECTORY_PARTS))
    text = F.col("content").cast("string")
    return df.where(~skipped).where(F.is_valid_utf8(text)).select("path", text.alias("text"))


def contracts_of(raw: DataFrame) -> DataFrame:
    """Every valid contract a record holds under its four possible names."""
    names = ("target_contract", "chosen_contract", "rejected_contract", "gold_contract")
    held = F.array_compact(F.array(*[F.get_json_object("raw", f"$.{n}") for n in names]))
    df = raw.select("ordinal", F.get_json_object("raw", "$.input_text").alias("input_text"), F.explode(held).alias("contract"))
    return contract_valid(parse_contract(df, "contract", "c"), "c").where("schema_valid").drop("schema_valid", "semantic_valid")
