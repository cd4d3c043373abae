"""Small building blocks shared by the operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlane.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder of ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored frame, broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def flag(cond: Column) -> Column:
    """0/1 integer, NULL counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def copies(df: DataFrame) -> Column:
    """How many rows a row stands for: its ``copies``, else 1."""
    return F.col("copies") if "copies" in df.columns else F.lit(1)


def rate(num: Column, den: Column, empty=0.0) -> Column:
    """num / den as double with an explicit value for a zero denominator."""
    return F.when(den == 0, F.lit(empty).cast("double")).otherwise(num / den)


def count_if(cond: Column) -> Column:
    return F.sum(flag(cond)).cast("bigint")


def first_k(df: DataFrame, groups: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. The rank filter becomes a group limit before the shuffle, so a hot
    group sends at most k rows per task."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def examples(df: DataFrame, groups: list[str], order: str, value: str, k: int, out: str) -> DataFrame:
    """One row per group with the first k values joined by a comma, in input order."""
    picked = first_k(df.select(*groups, order, value), groups, [F.col(order), F.col(value)], k)
    pairs = F.array_sort(F.collect_list(F.struct("rank", value)))
    return picked.groupBy(*groups).agg(F.array_join(F.transform(pairs, lambda x: x[value]), ",").alias(out))


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two one-row aggregates side by side."""
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def facts_beside(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """A one-row aggregate beside each of ``rows``; without rows once, with ``absent`` true."""
    marked = rows.withColumn("__one", F.lit(1)).withColumn("absent", F.lit(False))
    out = facts.withColumn("__one", F.lit(1)).join(marked, "__one", "left").drop("__one")
    return out.withColumn("absent", F.col("absent").isNull())


def ranked_all(df: DataFrame, groups: list[str], order: list, rank: str) -> DataFrame:
    """Every row with its rank in its group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def places(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` (0, 1, 2 ... by ``order``, whose values are distinct): rows are dealt out by ranges,
    the ranges are counted, and rows are ranked inside their range only."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__range", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.join(offsets, "__range").withColumn("place", F.col("__before") + rank).drop("__range", "__before")


def stack_columns(df: DataFrame, keep: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Turn value columns into (name, value) rows in one narrow step."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns]))
    return df.select(*keep, pairs.alias("__p")).select(*keep, f"__p.{name}", f"__p.{value}")


def grouping_counts(df: DataFrame, base: list[str], dims: list[str], measures: list[Column]) -> DataFrame:
    """Counts per base columns and per single dimension in one pass (GROUPING SETS)."""
    tagged = df.select(
        *df.columns,
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias(
            "__d"
        ),
    )
    return tagged.groupBy(*base, F.col("__d.dimension").alias("dimension"), F.col("__d.value").alias("value")).agg(
        *measures
    )
