from __future__ import annotations

from pyspark.sql import functions as F

from rowmesh.plans import graph as G
from rowmesh.plans import ordering as O
from rowmesh.sources import formats, generators


def test_ordering_is_a_permutation_with_less_fill_than_rows_first(spark):
    g = generators.grid(spark, 9, 9)
    v = G.vertices_of(g)
    o = O.order(v, g, 4)
    assert O.is_permutation(o) and o.count() == 81
    rows_first = v.select("id", F.lit(0).alias("part"), F.col("id").alias("perm"))
    assert O.symbolic_stats(g, o)["nnz"] < O.symbolic_stats(g, rows_first)["nnz"]


def test_symbolic_stats_of_a_path(spark):
    path = G.symmetrize(spark.range(4).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    straight = G.vertices_of(path).select("id", F.col("id").alias("perm"))
    assert O.symbolic_stats(path, straight) == {"nnz": 9, "opc": 17, "height": 5, "leaves": 1}


def test_distances_of_a_ring(spark):
    ring = G.symmetrize(spark.range(6).select(F.col("id").alias("src"), ((F.col("id") + 1) % 6).alias("dst")))
    got = {(r["src_part"], r["dst_part"]): r["dist"] for r in O.distance_table(ring).collect()}
    assert got == {(a, b): min(abs(a - b), 6 - abs(a - b)) for a in range(6) for b in range(6)}


def test_harwell_boeing(spark, tmp_path):
    head = ["title".ljust(72) + "key".ljust(8), f"{2:14d}{1:14d}{1:14d}{0:14d}{0:14d}", "PSA".ljust(14) + f"{3:14d}{3:14d}{4:14d}{0:14d}", "(4I5)".ljust(16) + "(4I5)".ljust(16)]
    (tmp_path / "m.psa").write_text("\n".join([*head, "    1    3    4    5", "    1    2    3    3"]) + "\n")
    assert {tuple(r) for r in formats.read_harwell_boeing(spark, str(tmp_path / "m.psa")).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
