"""Shuffled shards by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters records uniformly into buckets of about ``bucket_bytes`` by a seeded hash of the
place of a record in its file, so equal ids, equal texts and whole repeated rows spread like any
others. One exchange sends each bucket to the task of its own number. Pass two puts a bucket in a
fixed order, permutes it by Fisher-Yates (``shuffle`` of Spark draws its indices that way, from the
seed and the bucket's number) and writes it. Buckets one behind the other are one shuffled sequence
of all records, which is cut into shards of equal counts: ``bucket start + place`` gives shard and
slot, so a bucket writes to one shard, or to a few where a cut falls in it.

The law is ``rows``: counts of shards differ by one at most. A lost task repeats the same bucket in
the same order, since neither the scatter nor the order depends on when rows arrive.

Files: Parquet below ``shard=<k>``, with ``slot`` and ``record`` (a struct of all columns of the
input, so that no name of theirs can clash).

Defined results: a null text has the size 16 and counts as empty; an empty table gives shards
without rows; with fewer rows than shards the last shards are empty; null and repeated ids are
records like others. A frame that is not read from files is written to the shared folder first,
since only files give its rows a place. A bucket holds whole records, so one record may exceed
``bucket_bytes``; a record is never cut.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pactlane.llm.blocks import small, stored

BUCKET_BYTES = 32 << 20
ROW_BYTES = 16  # of a record besides its text
SEED = 42
GROUPED = 4096  # buckets whose starts are summed in one task
LAW = "rows"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def size_of(text: Column) -> Column:
    """Bytes of a record: UTF-8 bytes of its text and ``ROW_BYTES``."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + ROW_BYTES


def placed(docs: DataFrame) -> DataFrame:
    """``record`` (all columns) with the file and the row in it where the record stands."""
    record = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    for frame in (docs, None):
        try:
            frame = frame or stored(docs, "records")
            place = frame.metadataColumn("_metadata")
            return frame.select(record.alias("record"), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))
        except AnalysisException:
            if frame is not docs:
                raise
    raise AssertionError("not reached")


def _starts(counts: DataFrame) -> DataFrame:
    """bucket, start: records of all buckets before, summed in groups of buckets."""
    counts = counts.withColumn("group", (F.col("bucket") / GROUPED).cast("int"))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = groups.select("group", before(Window.orderBy("group")).alias("base"))
    within = counts.select("bucket", "group", before(Window.partitionBy("group").orderBy("bucket")).alias("start"))
    return within.join(small(base), "group").select("bucket", (F.col("start") + F.col("base")).alias("start"))


def cut(rank: Column, rows: int, shards: int) -> tuple[Column, Column]:
    """(shard, slot) of a rank: the first ``rows % shards`` shards hold one record more."""
    least, more = divmod(rows, shards)
    edge = (least + 1) * more
    after = rank - edge
    whole = max(least, 1)  # without a full round no rank lies behind the edge
    shard = F.when(rank < edge, rank / (least + 1)).otherwise(after / whole + more)
    slot = F.when(rank < edge, rank % (least + 1)).otherwise(after % whole)
    return F.floor(shard).cast("int"), slot.cast("long")


def write(docs: DataFrame, folder: str, shards: int = 40, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Shuffle all rows of ``docs`` into ``shards`` shards of equal counts below ``folder``."""
    records = placed(docs)
    total, rows = records.agg(F.sum(size_of(F.col("record")[text])), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "file", "row"), F.lit(buckets)).cast("int")
    records = records.withColumn("bucket", bucket)
    starts = stored(_starts(records.groupBy("bucket").agg(F.count("*").alias("n"))), "starts")

    held = records.repartitionById(buckets, F.col("bucket")).groupBy("bucket")
    held = held.agg(F.collect_list(F.struct("file", "row", "record")).alias("held"))
    # places in a fixed order, then Fisher-Yates on the places
    order = F.sort_array(F.transform("held", lambda r, i: F.struct(r["file"].alias("file"), r["row"].alias("row"), i.alias("i"))))
    drawn = F.transform(F.shuffle(order, F.lit(seed)), lambda o: F.get(F.col("held"), o["i"])["record"])
    shuffled = held.select("bucket", F.posexplode(drawn).alias("place", "record")).join(small(starts), "bucket")
    shard, slot = cut(F.col("start") + F.col("place"), rows, shards)
    out = shuffled.select("record", slot.alias("slot"), shard.alias("shard")).sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(folder)


def read(spark: SparkSession, folder: str, record: StructType) -> DataFrame:
    """record, slot and shard of every record in ``folder``; ``record`` is the schema of the table written."""
    schema = StructType([StructField("record", record), StructField("slot", LongType()), StructField("shard", IntegerType())])
    return spark.read.schema(schema).parquet(folder)


def assignments(out: DataFrame, text: str = "text") -> DataFrame:
    """Digest columns of the records in shards: size, text_crc32, law, shard, slot, grown_shard."""
    body = F.col("record")[text]
    return out.select(
        F.col("record")["doc_id"].alias("doc_id"), size_of(body).alias("size"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
