"""What the operators share on the Spark side: tables, cutting lineage, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one,
    which goes when the driver ends; on a cluster that is an error. What operators write there outlives them, since the
    DataFrames that they return may read it; it goes with the folder."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_to:
        return set_to
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
    made = tempfile.mkdtemp(prefix="rowmesh-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """As cut(), for wide rows: a compressed Parquet table in the shared folder. It stays there until the folder goes."""
    path = os.path.join(shared_dir(df.sparkSession), f"{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of a caller's table can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


_NO_KEY = -(1 << 63)


def hide_nulls(df: DataFrame, key: str) -> DataFrame:
    """Null long keys as the least long: pandas would turn a batch that holds a null, and its large keys, into doubles."""
    if df.schema[key].dataType.simpleString() != "bigint":
        return df
    return df.withColumn(key, F.coalesce(F.col(key), F.lit(_NO_KEY)))


def show_nulls(df: DataFrame, key: str) -> DataFrame:
    """The inverse of hide_nulls; a key that is the least long itself comes back as null."""
    if df.schema[key].dataType.simpleString() != "bigint":
        return df
    return df.withColumn(key, F.when(F.col(key) != _NO_KEY, F.col(key)))


def fold_pairs(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v) by alternating large-star and small-star contraction.

    Returns (v, root) for every vertex that has an edge to another one; root is the least vertex of its component.
    Each round is two aggregations with map-side combine and two joins; lineage is cut once a round. An edge from a
    vertex to itself is ignored, repeated edges count once. No edges: an empty result.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
