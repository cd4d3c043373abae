"""Exact stratified split without sorting a stratum in one task.

Rows are ordered inside a stratum by a seeded hash. Hash prefixes form many small buckets;
bucket counts give every bucket its rank range, so only the few buckets that a boundary cuts
need a local row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlane.operators.common import stored


def stratified_split(
    df: DataFrame, stratum: str, key: str, seed: int = 42, train: float = 0.7, dev: float = 0.15, digits: int = 4
) -> DataFrame:
    """Exact shares per stratum in an order of hashes: buckets of ``digits`` hexadecimal digits are counted,
    whole buckets are placed by their counts, and only the two that a boundary cuts are ranked. The
    result does not depend on ``digits``; more of them make cut buckets smaller on larger inputs."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    tagged = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, digits))
    counts = stored(tagged.groupBy(stratum, "__b").agg(F.count("*").alias("__n")), "split-buckets")
    every = Window.partitionBy(stratum)
    hi = F.sum("__n").over(every.orderBy("__b"))
    ranges = counts.select(stratum, "__b", "__n", hi.alias("__hi"), F.sum("__n").over(every).alias("__total"))
    n_train = F.greatest(F.lit(1), F.floor(F.col("__total") * F.lit(train)))
    n_dev = F.greatest(F.lit(1), F.floor(F.col("__total") * F.lit(dev)))
    lo = F.col("__hi") - F.col("__n")

    def holding(rank: Column) -> Column:
        """The bucket that holds a rank and the rank's place in it."""
        inside = (lo < rank) & (rank <= F.col("__hi"))
        return F.max(F.when(inside, F.struct(F.col("__b").alias("b"), (rank - lo).alias("place"))))

    bounds = ranges.groupBy(stratum).agg(holding(n_train).alias("__t"), holding(n_train + n_dev).alias("__d"))
    joined = tagged.join(bounds, stratum)
    b, last = F.col("__b"), F.lit("~")  # behind every bucket, where a boundary lies behind the last row
    t, d = F.col("__t.b"), F.coalesce("__d.b", last)
    needs = (b == t) | (b == d)
    whole = F.when(b < t, F.lit("train")).when(b < d, F.lit("dev")).otherwise(F.lit("test"))
    settled = joined.where(~needs).withColumn("split", whole)
    rank = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", key))
    placed = (
        F.when((b == t) & (rank <= F.col("__t.place")), F.lit("train"))
        .when((b < d) | (rank <= F.col("__d.place")), F.lit("dev"))
        .otherwise(F.lit("test"))
    )
    cut = joined.where(needs).withColumn("split", placed)
    return settled.unionByName(cut).select(*df.columns, "split")
