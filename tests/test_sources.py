"""Round trips of the file formats."""

from __future__ import annotations

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmesh.plans import graph as G
from rowmesh.sources import formats as X
from rowmesh.sources import generators


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def loaded(spark):
    arcs = generators.grid(spark, 4, 3).withColumn("load", F.least("src", "dst") + 1)
    return G.vertices_of(arcs).withColumn("load", F.col("id") % 3 + 1), arcs


def test_binary_csr_in_balanced_parts(spark, tmp_path):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, 40)
    starts = np.concatenate([[0], np.cumsum(counts)])
    cols, vals = rng.integers(0, 50, starts[-1]), rng.random(starts[-1]).astype(np.float32)
    X.write_csr(str(tmp_path / "m"), starts, cols, vals, 50)
    got = sorted(tuple(r) for r in X.read_csr(spark, str(tmp_path / "m"), 5).collect())
    want = sorted((int(r), int(c), float(v)) for r, c, v in zip(np.repeat(np.arange(40), counts), cols, vals))
    assert got == want
    X.write_csr(str(tmp_path / "p"), starts, cols, None, 50)
    assert X.read_csr(spark, str(tmp_path / "p")).agg(F.sum("val")).first()[0] == starts[-1]




def merged(path):
    out = f"{path}.txt"
    with open(out, "w") as f:
        for part in sorted(glob.glob(f"{path}/part-*")):
            f.write(open(part).read())
    return out


def test_grf_and_chaco(spark, tmp_path, loaded):
    v, a = loaded
    X.write_grf(v, a, str(tmp_path / "g"))
    v2, a2 = X.read_grf(spark, merged(tmp_path / "g"))
    assert as_set(v2.select("id", "load")) == as_set(v.select("id", "load")) and as_set(a2) == as_set(a.select("src", "dst", "load"))
    up = v.select((F.col("id") + 1).alias("id"), "load"), G.rebase(a, 1)
    X.write_chaco(*up, str(tmp_path / "c"))
    v3, a3 = X.read_chaco(spark, merged(tmp_path / "c"))
    assert as_set(v3) == as_set(up[0]) and as_set(a3) == as_set(up[1].select("src", "dst", "load"))


def test_matrix_market_dimacs_adjacency(spark, tmp_path, loaded):
    a = G.rebase(loaded[1].select("src", "dst"), 1)
    X.write_matrix_market(a, 12, str(tmp_path / "mm"))
    assert as_set(X.read_matrix_market(spark, merged(tmp_path / "mm"))) == as_set(a)
    X.write_dimacs(a, str(tmp_path / "d"))
    assert as_set(X.read_dimacs(spark, merged(tmp_path / "d"))) == as_set(a)
    X.write_adjacency(a, str(tmp_path / "adj"))
    assert as_set(X.adjacency_arcs(X.read_adjacency(spark, str(tmp_path / "adj")))) == as_set(a)


def test_bad_lines_and_vectors(spark, tmp_path):
    (tmp_path / "a.adj").write_text("1 | 2 3 | \n2 | x | 1\n")
    got = X.read_adjacency(spark, str(tmp_path / "a.adj")).orderBy("id").collect()
    assert got[0]["bad"] == "2 | x | 1" and got[1]["out"] == [2, 3] and got[1]["in"] == []
    (tmp_path / "v").write_text("1.5\n2\n-3\n")
    assert as_set(X.read_vector(spark, str(tmp_path / "v"))) == {(0, 1.5), (1, 2.0), (2, -3.0)}
    (tmp_path / "m").write_text("0 1 2.5\n1 0 1\n")
    assert as_set(X.read_coo(spark, str(tmp_path / "m"))) == {(0, 1, 2.5), (1, 0, 1.0)}
    (tmp_path / "e").write_text("1 2\n2 3\n")
    assert X.edge_list(spark, str(tmp_path / "e")).count() == 4
    (tmp_path / "p").write_text("2\n1\t0\n")
    assert as_set(X.read_mapping(spark, str(tmp_path / "p"), spark.range(1, 3))) == {(1, 0), (2, -1)}


def test_generators(spark):
    assert generators.hypercube(spark, 4).count() == 64
    assert G.unmatched_arcs(generators.de_bruijn(spark, 4)).count() == 0
    assert G.mesh_dual(generators.elements(spark, 2, 2)).count() == 40
