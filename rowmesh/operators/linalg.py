"""Sparse matrices as (row, col, val): products, normalisation, blocks, balanced row ranges, replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """(row, y): y = A x for x (i, x); rows without an entry of x present get 0."""
    prod = a.join(x.select(F.col("i").alias("col"), "x"), "col", "left")
    return prod.groupBy("row").agg(F.coalesce(F.sum(F.col("val") * F.col("x")), F.lit(0.0)).alias("y"))


def row_normalize(a: DataFrame) -> DataFrame:
    """Rows of unit length. Norms are aggregated and joined back: a long row isn't gathered into a task."""
    norms = a.groupBy("row").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    return a.join(norms, "row").select("row", "col", F.when(F.col("norm") > 0, F.col("val") / F.col("norm")).otherwise(0.0).alias("val"))


def blocked(a: DataFrame, rows: int, cols: int) -> DataFrame:
    """Entries with block_r and block_c, for blocks of so many rows and columns."""
    return a.withColumn("block_r", F.floor(F.col("row") / rows).cast("long")).withColumn("block_c", F.floor(F.col("col") / cols).cast("long"))


def balanced_rows(a: DataFrame, parts: int) -> DataFrame:
    """(row, nnz, part): consecutive rows in parts of about equal entries."""
    counts = a.groupBy("row").agg(F.count("*").alias("nnz"))
    total = counts.agg(F.sum("nnz").alias("total"))
    upto = F.sum("nnz").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(upto, F.lit(0))).crossJoin(F.broadcast(total)).select("row", "nnz", F.floor(F.col("before") * parts / F.col("total")).cast("long").alias("part"))


def replicate(a: DataFrame, down: int, across: int, rows: int, cols: int) -> DataFrame:
    """down x across copies of a rows x cols matrix side by side."""
    spark = a.sparkSession
    grid = spark.range(down).withColumnRenamed("id", "__r").crossJoin(spark.range(across).withColumnRenamed("id", "__c"))
    return a.crossJoin(F.broadcast(grid)).select((F.col("row") + F.col("__r") * rows).alias("row"), (F.col("col") + F.col("__c") * cols).alias("col"), "val")


def integral(spark, f, lo: float, hi: float, steps: int) -> DataFrame:  # noqa: ANN001
    """Midpoint rule of a column function."""
    h = (hi - lo) / steps
    return spark.range(steps).agg(F.sum(f(F.lit(lo) + (F.col("id") + 0.5) * h) * h).alias("integral"))
