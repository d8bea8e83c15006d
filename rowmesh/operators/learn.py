"""Spherical k-means, bisecting k-means and matrix factorisation over sparse triples."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmesh.operators.linalg import row_normalize
from rowmesh.plans.iterate import cut


def assign(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """(row, k, sim): the centre of the greatest dot product, the first of equals. The join is by column, so neither side
    has to fit an executor."""
    dots = rows.join(centers.select("k", "col", F.col("val").alias("c")), "col").groupBy("row", "k").agg(F.sum(F.col("val") * F.col("c")).alias("sim"))
    top = dots.groupBy("row").agg(F.max(F.struct("sim", (-F.col("k")).alias("k"))).alias("t"))
    return top.select("row", (-F.col("t.k")).alias("k"), F.col("t.sim").alias("sim"))


def centers_of(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, col, val): the unit vectors along the clusters' sums."""
    sums = rows.join(labels.select("row", "k"), "row").groupBy("k", "col").agg(F.sum("val").alias("val"))
    return row_normalize(sums.withColumnRenamed("k", "row")).withColumnRenamed("row", "k")


def cluster_stats(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, size, norm): members and the norm of their sum."""
    sums = rows.join(labels.select("row", "k"), "row").groupBy("k", "col").agg(F.sum("val").alias("val"))
    norms = sums.groupBy("k").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    return labels.groupBy("k").agg(F.count("*").alias("size")).join(norms, "k")


def spherical_kmeans(rows: DataFrame, seeds: DataFrame, rounds: int = 20, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(labels, centers): from seed rows (k, row), until no row moves."""
    unit = cut(row_normalize(rows) if normalize else rows)
    centers = cut(unit.join(seeds, "row").select("k", "col", "val"))
    labels = None
    for _ in range(rounds):
        new = cut(assign(unit, centers))
        if labels is not None and new.join(labels, ["row", "k"], "left_anti").isEmpty():
            break
        labels = new
        centers = cut(centers_of(unit, labels))
    return labels, centers


def bisect(rows: DataFrame, seeds: tuple[int, int], rounds: int = 10) -> DataFrame:
    """(row, k): two sides by the sign of the product with the centres' difference; side 0 if it is positive."""
    unit = cut(row_normalize(rows))
    centers = unit.where(F.col("row").isin(*seeds)).select(F.when(F.col("row") == seeds[0], 0).otherwise(1).alias("k"), "col", "val")
    labels = None
    for _ in range(rounds):
        diff = centers.groupBy("col").agg(F.sum(F.when(F.col("k") == 0, F.col("val")).otherwise(-F.col("val"))).alias("d"))
        side = unit.join(diff, "col", "left").groupBy("row").agg(F.when(F.coalesce(F.sum(F.col("val") * F.col("d")), F.lit(0.0)) > 0, 0).otherwise(1).alias("k"))
        new = cut(side)
        if labels is not None and new.join(labels, ["row", "k"], "left_anti").isEmpty():
            break
        labels = new
        centers = cut(centers_of(unit, labels))
    return labels


def bisecting_kmeans(rows: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """(row, k): splits the largest cluster (the first of equals) until there are k; seeds are its least and greatest row."""
    labels = cut(rows.select("row").distinct().withColumn("k", F.lit(0)))
    for new in range(1, k):
        big = labels.groupBy("k").agg(F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi")).orderBy(F.desc("n"), "k").first()
        if big is None or big["n"] < 2:
            break
        members = labels.where(F.col("k") == big["k"]).select("row")
        sides = bisect(rows.join(members, "row", "left_semi"), (big["lo"], big["hi"]), rounds)
        moved = sides.where("k = 1").select("row", F.lit(new).alias("to"))
        labels = cut(labels.join(moved, "row", "left").select("row", F.coalesce("to", "k").alias("k")))
    return labels


def bias_model(ratings: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """(mu, row biases, column biases): means of what is left."""
    mu = ratings.agg(F.avg("val")).first()[0] or 0.0
    rb = ratings.groupBy("row").agg((F.avg("val") - mu).alias("rb"))
    cb = ratings.join(rb, "row").groupBy("col").agg(F.avg(F.col("val") - mu - F.col("rb")).alias("cb"))
    return mu, rb, cb


def error(predicted: DataFrame, val: str = "val", pred: str = "pred") -> DataFrame:
    """(mae, rmse)."""
    r = F.col(val) - F.col(pred)
    return predicted.agg(F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"))


#: Ratings of a block, about.
BLOCK = 250_000


def _visit(a: np.ndarray, b: np.ndarray, y: np.ndarray, mu: float, rate: float, reg: float, ub: np.ndarray, vb: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Updates biases and factors by the ratings y of rows a and columns b as if one by one. What shares neither row nor
    column commutes, so all ratings that come next in both their row and their column are visited at once."""
    n, left = len(y), np.zeros(len(y), np.int8)
    after = []
    for x in (a, b):
        order = np.argsort(x, kind="stable").astype(np.int32)
        same = x[order[1:]] == x[order[:-1]]
        later = np.full(n, -1, np.int32)
        later[order[:-1][same]] = order[1:][same]
        left[order[1:][same]] += 1
        after.append(later)
        del order, same
    wave = np.flatnonzero(left == 0)
    while len(wave):
        i, j = a[wave], b[wave]
        p, q = u[i], v[j]
        e = y[wave] - mu - ub[i] - vb[j] - np.einsum("ij,ij->i", p, q)
        ub[i] += rate * (e - reg * ub[i])
        vb[j] += rate * (e - reg * vb[j])
        e = e[:, None]
        u[i], v[j] = p + rate * (e * q - reg * p), q + rate * (e * p - reg * q)
        freed = []
        for later in after:
            x = later[wave]
            x = x[x >= 0]
            left[x] -= 1
            freed.append(x)
        x = np.concatenate(freed)
        wave = np.unique(x[left[x] == 0])


def _stratum_step(mu: float, rank: int, rate: float, reg: float, seed: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over a block, which is a partition: its rows' and columns' biases and factors after it. Its rows hold
    (kind, row, col, val, b, f): 0, a row's state; 1, a column's; 2, a rating. A rating takes under 70 bytes (test)."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, found = ([], []), []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for side, name in enumerate(("row", "col")):
                part = batch.filter(pa.array(kind == side))
                if len(part):
                    state[side].append((part.column(name).to_numpy(), part.column("b").to_numpy(), part.column("f").flatten().to_numpy().reshape(-1, rank)))
            part = batch.filter(pa.array(kind == 2))
            if len(part):
                found.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "val")))
        ids, bias, factors = [], [], []
        for side in state:
            i, b, f = (np.concatenate(x) for x in zip(*side)) if side else (np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)))
            order = np.argsort(i)
            ids.append(i[order])
            bias.append(b[order])
            factors.append(f[order])
        n, at = sum(len(x[0]) for x in found), 0
        a, b, y = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n)
        while found:
            row, col, val = found.pop()
            here = slice(at, at := at + len(val))
            a[here], b[here], y[here] = np.searchsorted(ids[0], row), np.searchsorted(ids[1], col), val
        order = np.lexsort((y, b, a)).astype(np.int32)
        order = order[np.random.default_rng(seed).permutation(n)]
        a, b, y = a[order], b[order], y[order]
        del order
        _visit(a, b, y, mu, rate, reg, *bias, *factors)
        for side in (0, 1):
            for at in range(0, len(ids[side]), 10_000):
                here = slice(at, at + 10_000)
                f = factors[side][here]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * rank), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), side, np.int32)), pa.array(ids[side][here]), pa.array(bias[side][here]), lists], ["side", "id", "b", "f"])

    return block


def sgd(ratings: DataFrame, rank: int = 8, blocks: int | None = None, epochs: int = 2, rate: float = 0.005, reg: float = 0.02, seed: int = 1) -> tuple[float, DataFrame, DataFrame]:
    """(mu, rows, cols): biased factors by stratified stochastic gradient descent. The blocks of one stratum share no row
    and no column, so they are updated side by side; a block's entries are visited in a fixed pseudo-random order. By
    default there are as many blocks a side as keep a block at BLOCK ratings or so, and no fewer than four."""
    blocks = blocks or max(4, math.ceil(math.sqrt(ratings.count() / BLOCK)))
    mu = float(ratings.agg(F.avg("val")).first()[0] or 0.0)

    def start(name: str) -> DataFrame:
        init = F.array(*[(F.pmod(F.xxhash64(name, F.lit(j), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.02 for j in range(rank)])
        return cut(ratings.select(name).where(F.col(name).isNotNull()).distinct().select(F.col(name).cast("long").alias("id"), F.lit(0.0).alias("b"), init.alias("f"), side(name).alias("s")))

    def side(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks))

    def rows_of(kind: int, block: Column, row: Column, col: Column, val: Column, b: Column, f: Column) -> list[Column]:
        return [F.lit(kind).alias("kind"), F.pmod(block, F.lit(blocks)).cast("int").alias("block"), row.cast("long").alias("row"), col.cast("long").alias("col"), val.cast("double").alias("val"), b.cast("double").alias("b"), f.cast("array<double>").alias("f")]

    none = F.lit(None)
    data = cut(ratings.where("row is not null and col is not null").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"), side("row").alias("br"), side("col").alias("bc")))
    rows, cols = start("row"), start("col")
    for epoch in range(epochs):
        for shift in range(blocks):
            stratum = data.where(F.pmod(F.col("bc") - F.col("br"), F.lit(blocks)) == shift)
            parts = [
                rows.select(*rows_of(0, F.col("s"), F.col("id"), none, none, F.col("b"), F.col("f"))),
                cols.select(*rows_of(1, F.col("s") - shift, none, F.col("id"), none, F.col("b"), F.col("f"))),
                stratum.select(*rows_of(2, F.col("br"), F.col("row"), F.col("col"), F.col("val"), none, none)),
            ]
            wide = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartitionById(blocks, F.col("block"))
            new = cut(wide.mapInArrow(_stratum_step(mu, rank, rate, reg, (seed, epoch, shift)), "side int, id long, b double, f array<double>"))
            rows, cols = (new.where(F.col("side") == s).select("id", "b", "f", side("id").alias("s")) for s in (0, 1))
    rows, cols = rows.select("id", "b", "f"), cols.select("id", "b", "f")
    return mu, rows, cols


def predict(ratings: DataFrame, mu: float, rows: DataFrame, cols: DataFrame) -> DataFrame:
    dot = F.aggregate(F.zip_with("rf", "cf", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    wide = ratings.join(rows.select(F.col("id").alias("row"), F.col("b").alias("rb"), F.col("f").alias("rf")), "row").join(cols.select(F.col("id").alias("col"), F.col("b").alias("cb"), F.col("f").alias("cf")), "col")
    return wide.select("row", "col", "val", (F.lit(mu) + F.col("rb") + F.col("cb") + dot).alias("pred"))
