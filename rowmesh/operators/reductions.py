"""The twelve reduction operators as aggregates, all-reduce, split-phase reduce, sparse merge and prefix scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each takes the value column and, for the pairs, the location column. MINLOC and MAXLOC prefer the smallest location.
OPS: dict[str, Callable[..., Column]] = {
    "max": lambda v, loc=None: F.max(v),
    "min": lambda v, loc=None: F.min(v),
    "sum": lambda v, loc=None: F.sum(v),
    "prod": lambda v, loc=None: F.product(v),
    "land": lambda v, loc=None: F.bool_and(v != 0).cast("int"),
    "lor": lambda v, loc=None: F.bool_or(v != 0).cast("int"),
    "lxor": lambda v, loc=None: (F.sum((v != 0).cast("int")) % 2).cast("int"),
    "band": lambda v, loc=None: F.bit_and(v),
    "bor": lambda v, loc=None: F.bit_or(v),
    "bxor": lambda v, loc=None: F.bit_xor(v),
    "maxloc": lambda v, loc=None: F.max_by(F.struct(v.alias("val"), loc.alias("loc")), F.struct(v, -loc)),
    "minloc": lambda v, loc=None: F.min_by(F.struct(v.alias("val"), loc.alias("loc")), F.struct(v, loc)),
}
IDENTITY = {"sum": 0, "prod": 1, "land": 1, "lor": 0, "lxor": 0, "band": -1, "bor": 0, "bxor": 0}


def _op(name: str, val: Column, loc: Column | None = None) -> Column:
    if name not in OPS:
        raise ValueError(f"no reduction {name!r}: {', '.join(OPS)}")
    if name.endswith("loc") and loc is None:
        raise ValueError(f"{name} needs a location")
    return OPS[name](val, loc)


def reduce(df: DataFrame, op: str, by: list[str], val: str = "val", loc: str | None = None) -> DataFrame:
    """One row per index: the op over all ranks. Partial on each task, final after one shuffle of partial results."""
    out = _op(op, F.col(val), F.col(loc) if loc else None)
    agg = df.groupBy(*by).agg(out.alias(val))
    return agg.select(*by, f"{val}.val", f"{val}.loc") if op.endswith("loc") else agg


def reduce_parts(df: DataFrame, part: str, op: str, by: list[str], val: str = "val") -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Split phase: what each part contributes, and a function that folds the contributions."""
    first = reduce(df, op, [part, *by], val)
    return first, lambda: reduce(first, op, by, val)


def allreduce(df: DataFrame, op: str, by: list[str], val: str = "val", into: str = "total") -> DataFrame:
    """Every row with its index's result. The aggregate is joined back, so a hot index isn't collected into one task."""
    total = reduce(df, op, by, val).withColumnRenamed(val, into)
    return df.join(total, by)


def merge(lists: list[DataFrame], op: str = "sum", key: str = "id", val: str = "val") -> DataFrame:
    """Sparse reduce: the union of id-value lists, equal ids folded."""
    if not lists:
        raise ValueError("nothing to merge")
    whole = lists[0].select(key, val)
    for other in lists[1:]:
        whole = whole.unionByName(other.select(key, val))
    return reduce(whole, op, [key], val)


def scan(df: DataFrame, op: str = "sum", by: list[str] = ["idx"], order: list[str] = ["rank"], val: str = "val", into: str = "scan", inclusive: bool = True) -> DataFrame:  # noqa: B006
    """Prefix reduction over ranks, per index; exclusive scans give the identity to the first rank (null for min, max)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    if op in ("land", "lor", "lxor"):
        ones = F.sum((F.col(val) != 0).cast("int")).over(w)
        n = F.count(F.lit(1)).over(w)
        out = {"land": (F.coalesce(ones, F.lit(0)) == n).cast("int"), "lor": (F.coalesce(ones, F.lit(0)) > 0).cast("int"), "lxor": F.coalesce(ones, F.lit(0)) % 2}[op]
        return df.withColumn(into, out)
    out = _op(op, F.col(val)).over(w)
    return df.withColumn(into, F.coalesce(out, F.lit(IDENTITY[op])) if op in IDENTITY and not inclusive else out)


def long_scan(df: DataFrame, order: str, val: str = "val", into: str = "scan", ranges: int = 256) -> DataFrame:
    """Inclusive sums along one long sequence, without sorting it in one task: ranges of the order are summed, the few
    range sums are scanned, and every range is scanned on its own. Rows of one order value share a range; they count
    together, each with the sum of all of them."""
    cuts = sorted(set(df.stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) or [0.0]
    part = F.coalesce(F.array_position(F.transform(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(order) < c), F.lit(True)), F.lit(0))
    part = F.when(part == 0, len(cuts) + 1).otherwise(part)
    ranged = df.withColumn("__part", part)
    sums = ranged.groupBy("__part").agg(F.sum(val).alias("__sum"))
    before = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum(val).over(Window.partitionBy("__part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__in", inside).join(before, "__part").withColumn(into, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")
