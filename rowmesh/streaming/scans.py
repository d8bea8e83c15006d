"""Running reductions of a stream: the same operators, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmesh.operators.reductions import OPS


def windowed_reduce(stream: DataFrame, op: str, time: str, length: str, late: str, by: list[str], val: str = "val") -> DataFrame:
    """One row a window and index; rows later than ``late`` behind the latest time are dropped, and state with them."""
    if op not in OPS or op.endswith("loc"):
        raise ValueError(f"no reduction {op!r} of streams")
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(OPS[op](F.col(val)).alias(val))
