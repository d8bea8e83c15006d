"""Sample sort, ranks across partitions, splitters, bucket histograms, inversion checks, argmax."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmesh.plans.iterate import cut


def sample_sort(df: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """Range shuffle by sampled splitters, then a sort within partitions: partition numbers ascend with the order."""
    return (df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)).sortWithinPartitions(*by)


def global_rank(df: DataFrame, *by: str, into: str = "pos", parts: int | None = None) -> DataFrame:
    """Each row's place in the whole order. Partitions' sizes, which are few, give the places before each."""
    sorted_ = sample_sort(df, *by, parts=parts)
    placed = cut(sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return placed.join(F.broadcast(before), "__part").withColumn(into, F.col("__b") + F.col("__at")).drop("__part", "__at", "__b")


def splitters(df: DataFrame, by: str, parts: int) -> DataFrame:
    """(i, splitter): the values at places floor(i * n / parts), i from 1."""
    ranked = global_rank(df.select(by), by)  # its sorted rows are written already
    n = df.count()
    want = [(i, i * n // parts) for i in range(1, parts)]
    spots = df.sparkSession.createDataFrame(want, "i long, pos long")
    return ranked.join(F.broadcast(spots), "pos").select("i", F.col(by).alias("splitter"))


def bucket_histogram(df: DataFrame, by: str, split: DataFrame) -> DataFrame:
    """(bucket, n): rows above the splitter below and not above the one of the bucket. Splitters are few; a value's bucket
    comes from one array of them, not from a join of intervals."""
    cuts = split.agg(F.array_sort(F.collect_list("splitter")).alias("cuts"))
    bucket = F.size(F.filter("cuts", lambda c: c < F.col(by))).cast("long")
    return df.select(by).crossJoin(F.broadcast(cuts)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def inversions(df: DataFrame, pos: str, by: str) -> DataFrame:
    """Number of places whose value is below the one before. Neighbours meet by an equi-join on the place."""
    before = df.select((F.col(pos) + 1).alias(pos), F.col(by).alias("__before"))
    return df.select(pos, by).join(before, pos).agg(F.count(F.when(F.col("__before") > F.col(by), 1)).alias("inversions"))


def argmax(df: DataFrame, by: str, val: str, arg: str) -> DataFrame:
    """(by, arg, val) of each group's greatest value, the smallest arg on ties."""
    top = df.groupBy(by).agg(F.max(F.struct(F.col(val).alias("v"), (-F.col(arg)).alias("a"))).alias("t"))
    return top.select(by, (-F.col("t.a")).alias(arg), F.col("t.v").alias(val))
