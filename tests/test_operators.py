"""Closed-form cases, invariants and bad arguments."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rowmesh.functions import hll
from rowmesh.operators import collectives as C
from rowmesh.operators import learn as L
from rowmesh.operators import reductions as R
from rowmesh.operators import sorting as S
from rowmesh.plans import graph as G
from rowmesh.sources import generators


def buffers(spark, ranks, n):
    return spark.range(ranks * n).select((F.col("id") / n).cast("int").cast("long").alias("rank"), (F.col("id") % n).alias("idx")).withColumn("val", F.col("idx") + F.col("rank"))


def test_gather_then_scatter_gives_back_the_buffers(spark):
    b = buffers(spark, 4, 50)
    g = C.gather(b).select("pos", "val")
    assert all(r["val"] == r["pos"] % 50 + r["pos"] // 50 for r in g.collect())
    assert sorted(C.scatter(g, 50).select("rank", "idx", "val").collect()) == sorted(b.collect())


def test_scan_closed_form(spark):
    b = spark.range(6).select(F.col("id").alias("rank"), F.lit(0).alias("idx"), (F.col("id") * F.col("id") + F.col("id")).alias("val"))
    for r in R.scan(b).collect():
        assert r["scan"] == sum(j * j + j for j in range(r["rank"] + 1))
    for r in R.scan(b, inclusive=False).collect():
        assert r["scan"] == sum(j * j + j for j in range(r["rank"]))
    assert [r["scan"] for r in R.scan(b, "lxor").orderBy("rank").collect()] == [0, 1, 0, 1, 0, 1]


def test_bad_operator_names(spark):
    with pytest.raises(ValueError):
        R.reduce(buffers(spark, 2, 2), "median", ["idx"])
    with pytest.raises(ValueError):
        R.reduce(buffers(spark, 2, 2), "maxloc", ["idx"])
    with pytest.raises(ValueError):
        C.scatter(buffers(spark, 2, 2), 0)


def test_empty_inputs(spark):
    e = buffers(spark, 2, 2).where("false")
    assert R.reduce(e, "sum", ["idx"]).count() == 0
    assert C.gather(e).count() == 0
    assert S.global_rank(e, "val").count() == 0


def test_ties_of_locations(spark):
    d = spark.createDataFrame([(0, 3, 7), (1, 3, 7), (2, 1, 5), (3, 1, 5)], "loc long, val long, idx long")
    got = {r["idx"]: (r["val"], r["loc"]) for r in R.reduce(d, "maxloc", ["idx"], loc="loc").collect()}
    assert got == {7: (3, 0), 5: (1, 2)}


def test_sort_has_no_inversions(spark):
    x = generators.random_ints(spark, 2000, 5)
    placed = S.global_rank(x.select("x"), "x", parts=4)
    assert S.inversions(placed, "pos", "x").first()[0] == 0
    assert sorted(r["pos"] for r in placed.collect()) == list(range(2000))


@pytest.mark.parametrize(("dims", "torus", "arcs"), [((4, 4), False, 48), ((16, 16), False, 960), ((3, 4, 5), True, 360)])
def test_grids(spark, dims, torus, arcs):
    assert generators.grid(spark, *dims, torus=torus).count() == arcs


def test_known_diameters(spark):
    chain = G.symmetrize(spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert G.pseudo_diameter(chain, 7) == 20
    assert G.pseudo_diameter(generators.grid(spark, 4, 4), 0) == 6


def test_graph_check(spark):
    g = generators.hypercube(spark, 3)
    assert set(G.graph_check(G.vertices_of(g), g).values()) == {0}
    bad = g.unionByName(spark.createDataFrame([(0, 0), (0, 99)], "src long, dst long"))
    found = G.graph_check(G.vertices_of(g), bad)
    assert found["loops"] == 1 and found["asymmetric"] == 1 and found["strangers"] == 1


def test_ranks_sum_to_one(spark):
    a = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")
    total = G.pagerank(a, G.vertices_of(a), 7).agg(F.sum("pr")).first()[0]
    assert abs(total - 1) < 1e-9


def test_colours_are_proper(spark):
    g = generators.grid(spark, 6, 5)
    for color in (G.color_jones_plassmann, G.color_luby):
        c = color(g, G.vertices_of(g))
        assert c.where("color = 0").count() == 0 and G.color_conflicts(g, c).count() == 0


def test_partition_is_balanced_and_complete(spark):
    g = generators.grid(spark, 12, 12)
    v = G.vertices_of(g)
    fixed = spark.createDataFrame([(0, 2)], "id long, part int")
    p = G.partition(v, g, 3, fixed=fixed)
    loads = [r["load"] for r in G.part_loads(v, p).collect()]
    assert sum(loads) == 144 and max(loads) <= 48 * 1.05 and len(loads) == 3
    assert p.where("id = 0").first()["part"] == 2
    assert G.map_metrics(g, p).first()["comm_cut"] < 0.35
    over = G.overlap_partition(v, g, 3)
    assert G._ends(g, over).where("ps >= 0 and pd >= 0 and ps <> pd").count() == 0
    moved = G.repartition(v, g, 3, v.select("id", (F.col("id") % 3).cast("int").alias("part")))
    assert G.map_metrics(g, moved).first()["comm_cut"] < 1.0


def test_sketch_precision_and_monotone(spark):
    big = hll.estimate(hll.sketch(spark.range(200_000).select(F.lit(1).alias("g"), "id"), ["g"], "id", 9), ["g"], 9).first()["size"]
    assert abs(big / 200_000 - 1) < 0.15
    g = generators.grid(spark, 5, 5)
    anf = [r["n"] for r in hll.hyper_anf(g, G.vertices_of(g), 6, 8).orderBy("t").collect()]
    assert anf == sorted(anf)


def test_sgd_improves_on_the_mean(spark):
    r = spark.range(400).select((F.col("id") % 20).alias("row"), F.floor(F.col("id") / 20).alias("col")).withColumn("val", (F.col("row") % 5 + F.col("col") % 3).cast("double"))
    mu, rows, cols = L.sgd(r, rank=2, blocks=2, epochs=3, rate=0.05)
    assert L.error(L.predict(r, mu, rows, cols)).first()["rmse"] < 0.8 * L.error(r.withColumn("pred", F.lit(mu))).first()["rmse"]


def test_integral(spark):
    from rowmesh.operators.linalg import integral

    assert abs(integral(spark, F.cos, 0, math.pi / 2, 500).first()[0] - 1) < 1e-5


def test_streaming_reduction_keeps_batch_results(spark, tmp_path):
    from rowmesh.streaming.scans import windowed_reduce

    src = str(tmp_path / "in")
    spark.range(100).select(F.timestamp_seconds("id").alias("ts"), (F.col("id") % 3).alias("idx"), F.col("id").alias("val")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = windowed_reduce(stream, "sum", "ts", "50 seconds", "1 second", ["idx"]).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(90)
    assert spark.table("sums").agg(F.sum("val")).first()[0] == sum(range(100))


def test_effective_diameter_against_bfs(spark):
    from rowmesh import catalogue
    from tests.conftest import SF

    near = {}
    for r in catalogue.arcs(spark, SF).collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    within = [0] * len(near)
    for v in near:
        seen, last, t = {v}, {v}, 0
        while last:
            within[t] += len(last)
            last = {w for u in last for w in near[u]} - seen
            seen |= last
            t += 1
    upto = [sum(within[: t + 1]) for t in range(len(within))]
    goal = 0.9 * upto[-1]
    t = next(t for t, n in enumerate(upto) if n >= goal)
    exact = t - 1 + (goal - upto[t - 1]) / (upto[t] - upto[t - 1])
    found = catalogue.QUERIES["effective_diameter"](spark, SF).first()[0]
    assert exact > 3 and abs(found - exact) < 0.6, (found, exact)


def test_mesh_dual_has_every_node(spark):
    from rowmesh import catalogue
    from tests.conftest import SF

    elems = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        elems.setdefault(r[0], set()).add(r[1])
    want = {(a, b) for nodes in elems.values() for a in nodes for b in nodes if a != b}
    got = [(r["src"], r["dst"]) for r in catalogue.QUERIES["mesh_dual"](spark, SF).select("src", "dst").collect()]
    print("mesh_dual rows", len(got), "of", len(want))
    assert len(got) == len(set(got)) and set(got) == want


def test_parts_are_placed_near_what_they_talk_to(spark):
    from itertools import permutations

    g = generators.grid(spark, 8, 4).withColumn("load", F.least("src", "dst") % 3 + 1)
    v = G.vertices_of(g)
    ring = [[min(abs(a - b), 4 - abs(a - b)) for b in range(4)] for a in range(4)]
    parts = {r["id"]: r["part"] for r in G.map_to(v, g, ring).collect()}
    loads = [(r["src"], r["dst"], r["load"]) for r in g.collect()]
    cost = lambda p: sum(w * ring[p[parts[a]]][p[parts[b]]] for a, b, w in loads)
    assert len(parts) == 32 and max(list(parts.values()).count(k) for k in range(4)) <= 9
    assert cost(range(4)) == min(cost(p) for p in permutations(range(4)))


def test_remap_renames_for_least_migration(spark):
    from itertools import permutations

    v = spark.range(60).withColumn("load", F.col("id") % 5 + 1)
    old = v.select("id", (F.col("id") % 4).cast("int").alias("part"))
    new = v.select("id", F.when(F.col("id") % 7 == 0, F.col("id") % 3).otherwise((F.col("id") + 1) % 4).cast("int").alias("part"))
    got = {r["id"]: r["part"] for r in G.remap(v, old, new, 4).collect()}
    was, named = {r["id"]: r["part"] for r in old.collect()}, {r["id"]: r["part"] for r in new.collect()}
    moved = lambda part: sum(i % 5 + 1 for i in range(60) if part[i] != was[i])
    assert moved(got) == min(moved({i: p[named[i]] for i in range(60)}) for p in permutations(range(4)))


def test_diameters_of_parts(spark):
    g = generators.grid(spark, 6, 3)
    parts = spark.range(18).select("id", F.when(F.col("id") % 6 < 4, 0).otherwise(1).alias("part"))
    assert {(r["part"], r["diameter"]) for r in G.part_diameters(g, parts).collect()} == {(0, 5), (1, 3)}


def test_a_star_is_partitioned_without_the_driver(spark, monkeypatch):
    monkeypatch.setattr(G, "PLACED", 50)
    star = G.symmetrize(spark.range(1, 2400).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    p = G.partition(G.vertices_of(star), star, 4, rounds=1)
    assert p.count() == 2400 and p.select("part").distinct().count() == 4


def test_what_a_loop_keeps_of_a_plan_does_not_grow(spark):
    from rowmesh.plans.iterate import cut

    state = cut(spark.range(8))
    for _ in range(6):
        state = cut(state.join(state.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert state.count() == 8 and int(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def test_a_block_of_ratings_is_visited_in_order_and_in_few_bytes():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def run(n, rows, cols):
        r = np.random.default_rng(5)
        a, b, y = r.integers(0, rows, n) * 3, r.integers(0, cols, n) * 2, r.random(n)
        u, v = r.random((rows, 4)), r.random((cols, 4))
        kind = np.repeat([0, 1, 2], [rows, cols, n])
        row, col = np.concatenate([np.arange(rows) * 3, np.zeros(cols, int), a]), np.concatenate([np.zeros(rows, int), np.arange(cols) * 2, b])
        val, f = np.concatenate([np.zeros(rows + cols), y]), [*u, *v, *[None] * n]
        batch = pa.RecordBatch.from_arrays([pa.array(kind), pa.array(row), pa.array(col), pa.array(val), pa.array(np.zeros(len(kind))), pa.array(f, pa.list_(pa.float64()))], ["kind", "row", "col", "val", "b", "f"])
        return a, b, y, u, v, [batch.slice(i, 10_000) for i in range(0, len(kind), 10_000)]

    a, b, y, u, v, batches = run(600, 30, 20)
    ub, vb = np.zeros(30), np.zeros(20)
    order = np.lexsort((y, b, a))
    for i in order[np.random.default_rng((1, 0, 0)).permutation(600)]:  # one by one
        p, q = a[i] // 3, b[i] // 2
        e = y[i] - 0.5 - ub[p] - vb[q] - u[p] @ v[q]
        ub[p] += 0.1 * (e - 0.02 * ub[p])
        vb[q] += 0.1 * (e - 0.02 * vb[q])
        u[p], v[q] = u[p] + 0.1 * (e * v[q] - 0.02 * u[p]), v[q] + 0.1 * (e * u[p] - 0.02 * v[q])
    got = pa.Table.from_batches(L._stratum_step(0.5, 4, 0.1, 0.02, (1, 0, 0))(iter(batches)))
    assert np.allclose(got["b"].to_numpy(), [*ub, *vb], rtol=0, atol=1e-12) and np.allclose(np.stack(got["f"].to_pylist()), [*u, *v], rtol=0, atol=1e-12)

    *_, batches = run(400_000, 20_000, 20_000)
    tracemalloc.start()
    list(L._stratum_step(0.5, 4, 0.1, 0.02, (1, 0, 0))(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * 400_000


def test_every_graph_is_coarsened_until_few_vertices_are_left(spark, monkeypatch):
    met = []
    place = G._place
    monkeypatch.setattr(G, "PLACED", 90)
    monkeypatch.setattr(G, "_place", lambda v, *rest: met.append(v.count()) or place(v, *rest))
    star = G.symmetrize(spark.range(1, 500).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    fixed = spark.range(1, 300).select("id", (F.col("id") % 4).cast("int").alias("part"))
    p = G.partition(G.vertices_of(star), star, 4, fixed=fixed, rounds=1)
    loads = {r["part"]: r["load"] for r in G.part_loads(G.vertices_of(star), p).collect()}
    assert met and max(met) <= 90  # not a scattering by hash, and not the whole graph
    assert sum(loads.values()) == 500 and max(loads.values()) <= 500 / 4 * 1.05 + 1
    assert p.join(fixed, ["id", "part"]).count() == 299


def test_a_round_of_pagerank_moves_no_arcs(spark):
    links = spark.range(3000).select((F.col("id") % 70).alias("src"), (F.col("id") % 41).alias("dst"))
    with G.by_source(links) as held:
        plan = held.join(spark.range(70).withColumnRenamed("id", "src").hint("shuffle_hash"), "src")
        assert plan.count() == 3000
        shown = plan._jdf.queryExecution().executedPlan().toString()
    assert shown.count("ENSURE_REQUIREMENTS") == 1  # the other side's


def test_the_last_residual_takes_one_run(spark, monkeypatch):
    from rowmesh import catalogue

    runs = []
    ranks = G._ranks
    monkeypatch.setattr(G, "_ranks", lambda *a, **o: runs.append(a[2]) or ranks(*a, **o))
    got = catalogue.QUERIES["pagerank_residual"](spark, "/root/testdata/sf0.001").first()[0]
    a = catalogue.bipartite(spark, "/root/testdata/sf0.001")
    assert runs == [5] and abs(got - G.residual(G.pagerank(a, G.vertices_of(a), 4), G.pagerank(a, G.vertices_of(a), 5))) < 1e-9


def test_a_mesh_of_many_pairs_takes_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(G, "MET", 100)
    mesh = spark.range(600).select((F.col("id") % 60).alias("elem"), (F.col("id") * 7 % 50).alias("node"))
    nodes = {}
    for r in mesh.collect():
        nodes.setdefault(r["elem"], set()).add(r["node"])
    want = sorted({(x, y) for n in nodes.values() for x in n for y in n if x != y})
    dual = G.mesh_dual(mesh)
    pairs = sum(len(n) * (len(n) - 1) // 2 for n in nodes.values())
    assert sorted(map(tuple, dual.collect())) == want
    assert pairs >= 600 and "hashpartitioning(u#" in dual._jdf.queryExecution().executedPlan().toString() and dual.rdd.getNumPartitions() >= pairs // 100


def test_a_sweep_of_arcs_shuffles_them_once(spark, monkeypatch):
    held = []
    keep = G.by_source
    monkeypatch.setattr(G, "by_source", lambda a: held.append(1) or keep(a))
    ring = G.symmetrize(spark.range(14).select(F.col("id").alias("src"), ((F.col("id") + 1) % 15).alias("dst")))  # a path of 15
    assert G.pseudo_diameter(ring, 6) == 14 and held == [1]
    assert G.eccentricity(ring, 6) == (8, 14) and G.eccentricity(ring, 7) == (7, 0) and G.eccentricity(ring, 6, 2) == (2, 4)


def test_registers_move_packed(spark, monkeypatch):
    kept = []
    cut = hll.cut
    monkeypatch.setattr(hll, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    path = G.symmetrize(spark.range(5).select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    anf = [r["n"] for r in hll.hyper_anf(path, G.vertices_of(path), None, 6).orderBy("t").collect()]
    assert len(anf) == 6 and anf == sorted(anf)  # the path's diameter is 5
    assert all(len(df.columns) <= 12 for df in kept)  # 64 registers
    assert {df.where("grew").count() for df in kept[-1:]} == {0}
    packed = spark.range(1).select(*[F.lit(i % 33).alias(f"r{i}") for i in range(64)]).select(*hll._packed([F.col(f"r{i}") for i in range(64)]))
    assert list(packed.select(*[hll._register_of(i) for i in range(64)]).first()) == [i % 33 for i in range(64)]
