"""Fill-reducing orderings: vertex separators between parts, minimum degree within each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmesh.plans.graph import overlap_partition
from rowmesh.plans.iterate import cut


def minimum_degree(near: dict[int, set[int]]) -> list[int]:
    """Eliminates the vertex of the least degree, then of the least id, and joins its neighbours to a clique."""
    near = {i: set(n) - {i} for i, n in near.items()}
    out = []
    while near:
        i = min(near, key=lambda v: (len(near[v]), v))
        hood = near.pop(i)
        for j in hood:
            near[j] |= hood
            near[j] -= {i, j}
        out.append(i)
    return out


def order(vertices: DataFrame, arcs: DataFrame, k: int = 8) -> DataFrame:
    """(id, part, perm): parts one after the other, each by minimum degree, and the separator (part -1) last, by id. A part
    is ordered in one task: choose k so that parts fit one."""
    parts = cut(overlap_partition(vertices, arcs, k))
    ends = arcs.join(parts.select(F.col("id").alias("src"), "part"), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("to")), "dst").where("part = to and part >= 0")
    near = ends.groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("near"))
    rows = parts.join(near, "id", "left").select("id", "part", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))

    def run(group: tuple, g: pd.DataFrame) -> pd.DataFrame:
        if group[0] < 0:
            done = sorted(g["id"].tolist())
        else:
            done = minimum_degree({int(i): set(map(int, n)) for i, n in zip(g["id"], g["near"])})
        return pd.DataFrame({"id": done, "part": group[0], "at": np.arange(len(done))})

    placed = cut(rows.groupBy("part").applyInPandas(run, "id long, part int, at long"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col("part") < 0, "part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("b"))
    return placed.join(F.broadcast(before), "part").select("id", "part", (F.col("b") + F.col("at")).alias("perm"))


def is_permutation(ordering: DataFrame) -> bool:
    """Whether perm holds each of 0 .. n - 1 once."""
    n, kinds, low, high = ordering.agg(F.count("*"), F.countDistinct("perm"), F.min("perm"), F.max("perm")).first()
    return n == 0 or (kinds == n and low == 0 and high == n - 1)


def symbolic_stats(arcs: DataFrame, ordering: DataFrame) -> dict[str, int]:
    """Of the Cholesky factor under an ordering: entries with the diagonal, operations, height and leaves of the elimination
    tree. Symbolic elimination is sequential: for graphs that fit the driver."""
    perm = {r["id"]: r["perm"] for r in ordering.select("id", "perm").collect()}
    n = len(perm)
    below: list[set[int]] = [set() for _ in range(n)]
    for r in arcs.select("src", "dst").collect():
        a, b = perm[r["src"]], perm[r["dst"]]
        if a != b:
            below[min(a, b)].add(max(a, b))
    nnz = opc = 0
    parent, depth = [-1] * n, [1] * n
    for i in range(n):
        count = len(below[i]) + 1
        nnz += count
        opc += count * count
        if below[i]:
            parent[i] = min(below[i])
            below[parent[i]] |= below[i] - {parent[i]}
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
    return {"nnz": nnz, "opc": opc, "height": max(depth, default=0), "leaves": n - len({p for p in parent if p >= 0})}


def distance_table(arcs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(src_part, dst_part, dist): hops between all vertices of a small graph, an architecture given by its links. Levels
    grow from all vertices at once; the table is quadratic in the graph, as an architecture's is."""
    links = cut(arcs.select("src", "dst").where("src <> dst").distinct())
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    seen = cut(ids.select(F.col("id").alias("src_part"), F.col("id").alias("dst_part"), F.lit(0).cast("long").alias("dist")))
    front = seen
    for level in range(1, most):
        step = front.join(links, F.col("dst_part") == F.col("src")).select("src_part", F.col("dst").alias("dst_part")).distinct()
        front = cut(step.join(seen, ["src_part", "dst_part"], "left_anti").withColumn("dist", F.lit(level).cast("long")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
