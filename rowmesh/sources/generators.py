"""Graphs by formula, from spark.range: grids, tori, hypercubes, de Bruijn graphs, element meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.plans.graph import symmetrize


def grid(spark: SparkSession, *dims: int, torus: bool = False) -> DataFrame:
    """Arcs of a grid or torus of any number of dimensions; the first dimension runs fastest."""
    if not dims or min(dims) < 1:
        raise ValueError("dimensions must be positive")
    total = 1
    for d in dims:
        total *= d
    v = spark.range(total)
    out, width = None, 1
    for d in dims:
        x = F.floor(F.col("id") / width) % d
        ahead = F.when(x + 1 < d, F.col("id") + width)
        if torus:
            ahead = F.coalesce(ahead, F.col("id") - (d - 1) * width)
        one = v.select(F.col("id").alias("src"), ahead.cast("long").alias("dst")).where("dst is not null")
        out = one if out is None else out.unionByName(one)
        width *= d
    return symmetrize(out)


def hypercube(spark: SparkSession, d: int) -> DataFrame:
    bits = F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("b")
    return spark.range(1 << d).select(F.col("id").alias("src"), bits).select("src", F.col("src").bitwiseXOR(F.expr("shiftleft(1L, b)")).alias("dst"))


def de_bruijn(spark: SparkSession, d: int) -> DataFrame:
    """Undirected: shifts to the left with either new bit."""
    n = 1 << d
    one = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(F.lit(0), F.lit(1))).alias("b"))
    return symmetrize(one.select("src", ((F.col("src") * 2 + F.col("b")) % n).alias("dst")))


def elements(spark: SparkSession, x: int, y: int) -> DataFrame:
    """(elem, node): the square elements of a grid of x by y elements, with their four corners."""
    e = spark.range(x * y).select(F.col("id").alias("elem"), (F.col("id") % x).alias("i"), F.floor(F.col("id") / x).alias("j"))
    corner = F.col("j") * (x + 1) + F.col("i")
    return e.select("elem", F.explode(F.array(corner, corner + 1, corner + x + 1, corner + x + 2)).alias("node"))


def bricks(spark: SparkSession, x: int, y: int, z: int) -> DataFrame:
    """(elem, node): the box elements of a grid of x by y by z elements, with their eight corners."""
    e = spark.range(x * y * z).select(F.col("id").alias("elem"), (F.col("id") % x).alias("i"), (F.floor(F.col("id") / x) % y).alias("j"), F.floor(F.col("id") / (x * y)).alias("k"))
    corner = (F.col("k") * (y + 1) + F.col("j")) * (x + 1) + F.col("i")
    layer = (x + 1) * (y + 1)
    return e.select("elem", F.explode(F.array(*[corner + a + b * (x + 1) + c * layer for c in (0, 1) for b in (0, 1) for a in (0, 1)])).alias("node"))


def random_ints(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select("id", (F.xxhash64("id", F.lit(seed)).cast("long") % (1 << 31)).alias("x"))
