"""Loops over DataFrames: lineage is cut through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local session gets a temporary
    one, which goes when the driver ends; a cluster has no machine-local folder to fall back on, so there it is an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_to:
        return set_to
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir isn't set: loops need a folder that all executors share")
    made = tempfile.mkdtemp(prefix="rowmesh-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, without lineage. A checkpoint would keep the plan's estimated size, a product
    over joins: in a loop over self-joins its digits double each round, until they fill the driver. A table's size is its
    files', which are plain, so that what is small enough to be broadcast is so in memory too."""
    path = scratch(df.sparkSession, "cut")
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeat(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, every: int = 3) -> DataFrame:
    """``rounds`` steps, lineage cut after each ``every`` of them."""
    for i in range(rounds):
        state = step(state, i)
        if (i + 1) % every == 0:
            state = cut(state)
    return state


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame], bool], most: int = 1000) -> tuple[DataFrame, int]:
    """Steps until ``done(old, new)``; each state is written, so a lost executor costs one step. A state that hasn't settled
    after ``most`` steps is an error."""
    state = cut(state)
    for i in range(most):
        new = cut(step(state, i))
        if done(state, new):
            return new, i + 1
        state = new
    raise RuntimeError(f"no fixpoint within {most} steps")
