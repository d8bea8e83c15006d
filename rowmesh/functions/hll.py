"""HyperLogLog registers as rows, and the neighbourhood function of a graph."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmesh.plans.graph import ARCS, by_source
from rowmesh.plans.iterate import cut

#: 2654435761-style multiplicative mixing that stays below 2**63, so that any SQL engine computes the same.
_P = 2147483647


def hash31(x: Column) -> Column:
    """31 bits of a multiply-and-fold hash of a nonnegative id."""
    h = F.pmod(x * F.lit(48271) + F.lit(11), F.lit(_P))
    h = F.pmod(h * F.lit(69621) + F.lit(7), F.lit(_P))
    return F.pmod(h.bitwiseXOR(F.shiftright(h, 13)) * F.lit(16807) + F.lit(3), F.lit(_P))


def register(h: Column, bits: int) -> Column:
    return F.pmod(h, F.lit(1 << bits))


def rho(h: Column, bits: int) -> Column:
    """Place, from 1, of the lowest set bit above the register's bits; 32 if there is none."""
    rest = F.shiftright(h, bits)
    return F.when(rest == 0, F.lit(32)).otherwise(F.bit_count(rest.bitwiseAND(-rest) - 1) + 1).cast("int")


def sketch(df: DataFrame, by: list[str], value: str, bits: int = 4) -> DataFrame:
    """(by, reg, val): a sketch per group; empty registers have no row."""
    h = hash31(F.col(value))
    return df.select(*by, register(h, bits).alias("reg"), rho(h, bits).alias("val")).groupBy(*by, "reg").agg(F.max("val").alias("val"))


def union(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*by, "reg").agg(F.max("val").alias("val"))


def estimate(sk: DataFrame, by: list[str], bits: int = 4) -> DataFrame:
    """(by, size): m * m * 0.72134 / sum of 2**-register, absent registers being 0."""
    m = 1 << bits
    return sk.groupBy(*by).agg((F.lit(m * m * 0.72134) / (F.sum(F.pow(F.lit(2.0), -F.col("val"))) + (m - F.count("*")))).alias("size"))


def _packed(registers: list[Column]) -> list[Column]:
    """Registers, a byte each, eight to a long."""
    out = []
    for at in range(0, len(registers), 8):
        word = F.lit(0).cast("long")
        for i, r in enumerate(registers[at : at + 8]):
            word = word.bitwiseOR(F.shiftleft(r.cast("long"), 8 * i))
        out.append(word.alias(f"p{at // 8}"))
    return out


def _register_of(i: int) -> Column:
    return F.shiftright(f"p{i // 8}", 8 * (i % 8)).bitwiseAND(F.lit(255).cast("long")).cast("int")


def hyper_anf(arcs: DataFrame, vertices: DataFrame, rounds: int | None, bits: int = 4) -> DataFrame:
    """(t, n): the neighbourhood function, estimated pairs within distance t, until nothing changes or rounds end; rounds
    None: no limit. A vertex's registers are bytes of a few longs, so a round moves one short row an arc, and only from
    vertices whose registers changed in the round before: their neighbours have the others' already."""
    m = 1 << bits
    names = [f"r{i}" for i in range(m)]
    words = [f"p{i}" for i in range((m + 7) // 8)]
    h = hash31(F.col("id"))
    reg, val = register(h, bits), rho(h, bits)
    total = lambda of: F.aggregate(F.array(*map(of, names)), F.lit(0.0), lambda s, x: s + x)
    size = F.lit(m * m * 0.72134) / total(lambda n: F.pow(F.lit(2.0), -F.col(n)))
    load = total(lambda n: F.col(n).cast("double"))

    def keep(df: DataFrame) -> DataFrame:
        """(id, words, size, load, grew) of (id, registers, was); load is the registers' sum, which only grows."""
        return cut(df.select("id", *_packed([F.col(n) for n in names]), size.alias("size"), load.alias("load"), (load > F.col("was")).alias("grew")))

    def pairs(df: DataFrame) -> float:
        return df.agg(F.coalesce(F.sum("size"), F.lit(0.0))).first()[0]

    state = keep(vertices.select("id", *[F.when(reg == i, val).otherwise(F.lit(0)).alias(n) for i, n in enumerate(names)], F.lit(-1.0).alias("was")))
    sizes = [pairs(state)]
    with by_source(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) as back:
        parts = max(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * back.count() / ARCS))
        for _ in itertools.count() if rounds is None else range(rounds):
            front = state.where("grew").select(F.col("id").alias("src"), *words).hint("shuffle_hash")
            near = back.join(front, "src").select(F.col("dst").alias("id"), *words, F.lit(0.0).alias("was"))
            met = state.select("id", *words, F.col("load").alias("was")).unionByName(near).repartition(parts, "id")  # packed as they move
            new = keep(met.select("id", "was", *[_register_of(i).alias(n) for i, n in enumerate(names)]).groupBy("id").agg(*[F.max(n).alias(n) for n in names], F.max("was").alias("was")))
            if new.where("grew").isEmpty():
                break
            state = new
            sizes.append(pairs(state))
    return arcs.sparkSession.createDataFrame([(t, float(n)) for t, n in enumerate(sizes)], "t int, n double")


def effective_diameter(anf: DataFrame, alpha: float = 0.9) -> DataFrame:
    """The interpolated distance within which a share alpha of all reachable pairs lies."""
    w = Window.orderBy("t")
    top = anf.agg(F.max("n").alias("top"))
    rows = anf.withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0.0))).crossJoin(top).where(F.col("n") >= alpha * F.col("top"))
    first = rows.groupBy().agg(F.min(F.struct("t", "n", "before", "top")).alias("r"))
    part = (alpha * F.col("r.top") - F.col("r.before")) / (F.col("r.n") - F.col("r.before"))
    return first.select(F.when(F.col("r.t") == 0, F.lit(0.0)).otherwise(F.col("r.t") - 1 + part).alias("effective_diameter"))
