"""Graph operators over arcs (src, dst, load) with both directions present, and vertices (id, load).

Everything is joins on vertex ids and aggregations by vertex; loops write their state once a round.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmesh.operators.sorting import global_rank
from rowmesh.plans.iterate import cut, fixpoint


def symmetrize(edges: DataFrame) -> DataFrame:
    """Distinct arcs in both directions without loops."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def vertices_of(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("src").alias("id")).union(arcs.select("dst")).distinct()


def _weighted(arcs: DataFrame) -> DataFrame:
    return arcs if "load" in arcs.columns else arcs.withColumn("load", F.lit(1))


# --- ranking ---------------------------------------------------------------------------------------------------------


def pagerank(arcs: DataFrame, vertices: DataFrame, rounds: int, damping: float = 0.8, sinks: bool = True, weighted: bool = False, source: int | None = None, eps: float = 0.0) -> DataFrame:
    """(id, pr) after ``rounds`` rounds: each vertex pushes its rank along its arcs, in equal shares or by load. Sinks' rank
    is pooled over all vertices, or over the restart set. With a source, restarts go there alone (personalised). With
    eps, rounds end once the residual, the root of the summed squared changes, is no more."""
    return _ranks(arcs, vertices, rounds, damping, sinks, weighted, source, eps)[1]


def pagerank_change(arcs: DataFrame, vertices: DataFrame, rounds: int, **options) -> float:  # noqa: ANN003
    """The residual of the last of ``rounds`` rounds."""
    return residual(*_ranks(arcs, vertices, rounds, **options))


def _ranks(arcs: DataFrame, vertices: DataFrame, rounds: int, damping: float = 0.8, sinks: bool = True, weighted: bool = False, source: int | None = None, eps: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The ranks (id, pr) before and after the last round. Arcs are shuffled once, by source; a round moves vertices alone."""
    vertices = cut(vertices.select("id"))
    n = vertices.count()
    if not n:
        return (vertices.select("id", F.lit(0.0).alias("pr")),) * 2
    with by_source(arcs.select("src", "dst", *(["load"] if weighted else []))) as links:
        out = links.groupBy(F.col("src").alias("id")).agg((F.sum("load") if weighted else F.count("*")).alias("total"))
        restart = F.lit(1.0 / n) if source is None else (F.col("id") == source).cast("double")
        base = cut(vertices.join(out, "id", "left").select("id", "total", restart.alias("restart")))
        share = (F.col("load") if weighted else F.lit(1)) / F.col("total")
        old = state = base.withColumn("pr", F.col("restart"))
        for _ in range(rounds):
            old = state
            pool = state.where("total is null").agg(F.sum("pr")).first()[0] or 0.0 if sinks else 0.0
            pushed = state.where("total is not null").select(F.col("id").alias("src"), "pr", "total").hint("shuffle_hash")
            gained = links.join(pushed, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") * share).alias("gain"))
            kept = F.coalesce("gain", F.lit(0.0)) + F.lit(pool) * F.col("restart")
            state = cut(base.join(gained, "id", "left").select("id", "total", "restart", ((1 - damping) * F.col("restart") + damping * kept).alias("pr")))
            if eps and residual(old, state) <= eps:
                break
    return old.select("id", "pr"), state.select("id", "pr")


#: Arcs of a partition, about, where arcs stay shuffled over many rounds.
ARCS = 2_000_000


@contextmanager
def by_source(arcs: DataFrame) -> Iterator[DataFrame]:
    """The arcs, shuffled by src once and held on the executors' disks, so that joins on src move only their other side.
    What is read after the block must have been cut."""
    spark = arcs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(arcs.count() / ARCS))
    held = arcs.repartition(parts, "src").persist(StorageLevel.DISK_ONLY)
    try:
        held.count()  # its partitioning is known once it is there
        yield held
    finally:
        held.unpersist()


def residual(old: DataFrame, new: DataFrame) -> float:
    change = old.select("id", F.col("pr").alias("was")).join(new.select("id", "pr"), "id").agg(F.sqrt(F.sum((F.col("pr") - F.col("was")) ** 2)))
    return change.first()[0] or 0.0


# --- statistics, checks, subgraphs -----------------------------------------------------------------------------------


def _spread(df: DataFrame, value: Column, what: str) -> DataFrame:
    """Minimum, maximum, sum, mean and mean absolute deviation of a column, in two aggregations."""
    v = df.select(value.cast("double").alias("v"))
    mean = v.agg(F.avg("v").alias("m"))
    row = v.crossJoin(F.broadcast(mean)).agg(F.min("v"), F.max("v"), F.sum("v"), F.avg("v"), F.avg(F.abs(F.col("v") - F.col("m"))))
    return row.toDF("low", "high", "total", "mean", "dlt").select(F.lit(what).alias("what"), "low", "high", "total", "mean", "dlt")


def graph_stats(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """Spread of vertex loads, degrees and arc loads."""
    degrees = vertices.join(arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg")), "id", "left")
    load = F.col("load") if "load" in vertices.columns else F.lit(1)
    return _spread(vertices, load, "vertex").unionByName(_spread(degrees, F.coalesce("deg", F.lit(0)), "degree")).unionByName(_spread(_weighted(arcs), F.col("load"), "edge"))


def loops(arcs: DataFrame) -> DataFrame:
    return arcs.where("src = dst")


def duplicate_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


def unmatched_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs without an equal arc the other way."""
    keys = ["src", "dst", *(["load"] if "load" in arcs.columns else [])]
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keys[2:])
    return arcs.join(back, keys, "left_anti")


def graph_check(vertices: DataFrame, arcs: DataFrame) -> dict[str, int]:
    """Number of violations by kind; a sound graph has none."""
    ends = arcs.select("src").union(arcs.select("dst")).distinct()
    a = _weighted(arcs)
    return {"loops": loops(arcs).count(), "duplicates": duplicate_arcs(arcs).count(), "asymmetric": unmatched_arcs(arcs).count(), "strangers": ends.join(vertices, ends["src"] == vertices["id"], "left_anti").count(), "negative": a.where("load < 0").count()}


def rebase(arcs: DataFrame, shift: int) -> DataFrame:
    return arcs.withColumns({"src": F.col("src") + shift, "dst": F.col("dst") + shift})


def induce(vertices: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the given vertices: (id, new) numbered densely from 0 by id, and its arcs under the new numbers.
    Numbers come from range-partitioned ranks, not from one window."""
    named = cut(global_rank(vertices.select("id").distinct(), "id", into="new"))
    one = arcs.join(named.select(F.col("id").alias("src"), F.col("new").alias("s")), "src")
    both = one.join(named.select(F.col("id").alias("dst"), F.col("new").alias("d")), "dst")
    return named, both.select(F.col("s").alias("src"), F.col("d").alias("dst"), *[c for c in arcs.columns if c not in ("src", "dst")])


def halo(arcs: DataFrame, attr: DataFrame, value: str, agg=F.sum) -> DataFrame:  # noqa: ANN001
    """(id, value): an aggregate of the neighbours' attribute."""
    return arcs.join(attr.select(F.col("id").alias("dst"), value), "dst").groupBy(F.col("src").alias("id")).agg(agg(value).alias(value))


#: Rows of a partition, about, where rows are met in memory.
MET = 1_000_000


def _shares(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Shuffled by columns, into as many partitions as keep one at MET rows or so."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / MET)), *by)


def mesh_dual(mesh: DataFrame) -> DataFrame:
    """Arcs between distinct nodes that share an element; mesh: (elem, node). The number of partitions follows the number of
    rows and of pairs, so a task's memory doesn't grow with them; a pair moves once, not once a direction."""
    m = mesh.select("elem", "node").where("elem is not null and node is not null")
    m = cut(_shares(m, m.count(), "elem").distinct())
    pairs = m.groupBy("elem").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    m = _shares(m, m.count(), "elem")
    both = m.withColumnRenamed("node", "u").join(m.withColumnRenamed("node", "v"), "elem").where("u < v").select("u", "v")
    met = _shares(both, int(pairs), "u", "v").distinct()
    ends = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return met.select(ends.alias("e")).select("e.src", "e.dst")


# --- growth ----------------------------------------------------------------------------------------------------------


def grow(arcs: DataFrame, seeds: DataFrame, distance: int) -> DataFrame:
    """(id, color, level): multi-source breadth-first growth from seeds (id, color) up to a distance; of colors that arrive
    in one round the smallest wins."""
    seen = cut(seeds.groupBy("id").agg(F.min("color").alias("color")).withColumn("level", F.lit(0)))
    front = seen
    for level in range(1, distance + 1):
        reached = front.join(arcs, front["id"] == arcs["src"]).groupBy(arcs["dst"].alias("id")).agg(F.min("color").alias("color"))
        front = cut(reached.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def band(arcs: DataFrame, frontier: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Vertices within a distance of the frontier, with their level, and the arcs among them under their old ids."""
    near = cut(grow(arcs, frontier.select("id", F.lit(0).alias("color")), distance).select("id", "level"))
    return near, _among(arcs, near)


def eccentricity(arcs: DataFrame, start: int, most: int = 1 << 20) -> tuple[int, int]:
    """(distance, id): how far the farthest reachable vertex is, and the least such vertex."""
    with by_source(arcs.select("src", "dst")) as held:
        return _farthest(held, start, most)


def _farthest(held: DataFrame, start: int, most: int = 1 << 20) -> tuple[int, int]:
    """As eccentricity(), over arcs held by source. All vertices met are one table, which each round writes anew; a round moves
    the last front and what it reaches."""
    seen = cut(held.sparkSession.createDataFrame([(start, 0)], "id long, level int"))
    for level in range(1, most + 1):
        front = seen.where(F.col("level") == level - 1).select(F.col("id").alias("src")).hint("shuffle_hash")
        reached = held.join(front, "src").select(F.col("dst").alias("id")).distinct().withColumn("level", F.lit(level))
        new = cut(seen.unionByName(reached).groupBy("id").agg(F.min("level").alias("level")))
        if new.where(F.col("level") == level).isEmpty():
            break
        seen = new
    far = seen.agg(F.max(F.struct("level", (-F.col("id")).alias("i"))).alias("m")).first()["m"]
    return far["level"], -far["i"]


def pseudo_diameter(arcs: DataFrame, start: int) -> int:
    """Double sweeps from the farthest vertex until the distance no longer grows: a lower bound of the diameter. The arcs are
    shuffled once for all sweeps."""
    with by_source(arcs.select("src", "dst")) as held:
        best, at = _farthest(held, start)
        while True:
            d, at = _farthest(held, at)
            if d <= best:
                return best
            best = d


def part_diameters(arcs: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, diameter): for each part the greatest distance found, over arcs within the part, by sweeps from its least
    vertex and then from the farthest one until no part's distance grows: a lower bound, over what a start reaches."""
    inside = cut(_ends(arcs, parts).where("ps = pd").select("src", "dst").distinct())
    seeds = parts.groupBy("part").agg(F.min("id").alias("id")).select("id", F.col("part").alias("color"))
    best = None
    while True:
        far = grow(inside, seeds, 1 << 20).groupBy("color").agg(F.max(F.struct("level", (-F.col("id")).alias("i"))).alias("m"))
        found = cut(far.select(F.col("color").alias("part"), F.col("m.level").alias("diameter"), (-F.col("m.i")).alias("at")))
        if best is not None:
            found = cut(found.join(best.select("part", F.col("diameter").alias("was")), "part").withColumn("grew", F.col("diameter") > F.col("was")).withColumn("diameter", F.greatest("diameter", "was")))
            if found.where("grew").isEmpty():
                return found.select("part", "diameter")
        best = found
        seeds = found.select(F.col("at").alias("id"), F.col("part").alias("color"))


def components(arcs: DataFrame) -> DataFrame:
    """(id, root): the least id of each vertex's component, by minima over neighbours and one jump a round."""
    start = vertices_of(arcs).select("id", F.col("id").alias("root"))

    def step(state: DataFrame, _: int) -> DataFrame:
        least = arcs.join(state.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("r"))
        low = state.join(least, "id", "left").select("id", F.least("root", "r").alias("root"))
        jump = low.select(F.col("id").alias("root"), F.col("root").alias("r2"))
        return low.join(jump, "root").select("id", F.col("r2").alias("root"))

    def done(a: DataFrame, b: DataFrame) -> bool:
        return a.join(b, ["id", "root"], "left_anti").isEmpty()

    return fixpoint(start, step, done)[0]


# --- colouring -------------------------------------------------------------------------------------------------------


def weight_of(id_: Column) -> Column:
    """A fixed pseudo-random weight of a vertex."""
    return F.pmod(id_ * F.lit(2654435761), F.lit(2147483648))


def color_jones_plassmann(arcs: DataFrame, vertices: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, color): in each round the vertices whose (weight, id) tops all uncoloured neighbours take the smallest colour
    from 1 that no neighbour has; 0 for those left when rounds run out. Without a limit it ends once all have one."""
    return _color(arcs, vertices, rounds, smallest=True)


def color_luby(arcs: DataFrame, vertices: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, color): the colour is the round, from 1, in which a vertex tops all uncoloured neighbours."""
    return _color(arcs, vertices, rounds, smallest=False)


def _color(arcs: DataFrame, vertices: DataFrame, rounds: int | None, smallest: bool) -> DataFrame:
    state = cut(vertices.select("id", F.lit(0).cast("long").alias("color")))
    pairs = arcs.select("src", "dst").where("src <> dst").distinct()
    i = 0
    while rounds is None or i < rounds:
        i += 1
        open_ = state.where("color = 0").select("id")
        rival = pairs.join(open_.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.max(F.struct(weight_of(F.col("dst")).alias("w"), F.col("dst").alias("i"))).alias("top"))
        won = open_.join(rival, "id", "left").where(F.col("top").isNull() | (F.struct(weight_of(F.col("id")).alias("w"), F.col("id").alias("i")) > F.col("top"))).select("id")
        if smallest:
            near = pairs.join(won.select(F.col("id").alias("src")), "src", "left_semi").join(state.where("color > 0").select(F.col("id").alias("dst"), "color"), "dst")
            used = near.groupBy(F.col("src").alias("id")).agg(F.collect_set("color").alias("used"))
            free = F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), F.size("used") + F.lit(1).cast("long")), F.col("used")))
            won = won.join(used, "id", "left").select("id", F.when(F.col("used").isNull(), F.lit(1).cast("long")).otherwise(free).alias("new"))
        else:
            won = won.select("id", F.lit(i).cast("long").alias("new"))
        state = cut(state.join(won, "id", "left").select("id", F.coalesce("new", "color").alias("color")))
        if rounds is None and state.where("color = 0").isEmpty():
            break
    return state


def color_conflicts(arcs: DataFrame, colors: DataFrame) -> DataFrame:
    """Arcs between vertices of one colour."""
    c = colors.where("color > 0")
    return arcs.join(c.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src").join(c.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd").select("src", "dst")


# --- matching, coarsening, partition ---------------------------------------------------------------------------------


def match_heavy(arcs: DataFrame, vertices: DataFrame, rounds: int = 4) -> DataFrame:
    """(id, mate): rounds of mutual choice. Each free vertex names its free neighbour of the heaviest arc (then the greatest
    hash of the pair, then the smallest id); pairs that name each other match. The rest match themselves."""
    a = _weighted(arcs).where("src <> dst").groupBy("src", "dst").agg(F.sum("load").alias("load"))
    tie = weight_of(F.least("src", "dst") * 31 + F.greatest("src", "dst"))
    mates = None
    free = cut(vertices.select("id"))
    for _ in range(rounds):
        live = _among(a, free)
        pick = live.groupBy("src").agg(F.max(F.struct("load", tie.alias("t"), (-F.col("dst")).alias("d"))).alias("m")).select("src", (-F.col("m.d")).alias("dst"))
        back = pick.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        new = cut(pick.join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("mate")))
        if new.isEmpty():
            break
        mates = new if mates is None else mates.unionByName(new)
        free = cut(free.join(new, "id", "left_anti"))
    alone = free.select("id", F.col("id").alias("mate"))
    return alone if mates is None else mates.unionByName(alone)


def coarsen(vertices: DataFrame, arcs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts vertices by (id, group): loads add up, arcs within a group go, parallel arcs merge."""
    v = vertices.join(groups, "id").groupBy(F.col("group").alias("id")).agg(F.sum(F.col("load") if "load" in vertices.columns else F.lit(1)).alias("load"))
    s = groups.select(F.col("id").alias("src"), F.col("group").alias("cs"))
    d = groups.select(F.col("id").alias("dst"), F.col("group").alias("cd"))
    e = _weighted(arcs).join(s, "src").join(d, "dst").where("cs <> cd").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("load").alias("load"))
    return v, e


def coarsen_matched(vertices: DataFrame, arcs: DataFrame, rounds: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level of multilevel coarsening: (vertices, arcs, groups), a pair's group being its smaller id."""
    groups = cut(match_heavy(arcs, vertices, rounds).select("id", F.least("id", "mate").alias("group")))
    v, e = coarsen(vertices, arcs, groups)
    return v, e, groups


def map_metrics(arcs: DataFrame, parts: DataFrame, distance: Column | None = None) -> DataFrame:
    """Cut and communication figures of a mapping (id, part), over arcs whose ends are both mapped. ``distance`` is over
    columns ps and pd; by default 0 within a part, else 1."""
    ends = _ends(arcs, parts)
    dist = distance if distance is not None else (F.col("ps") != F.col("pd")).cast("int")
    d = ends.withColumn("d", dist)
    total = F.sum("load")
    return d.agg(
        F.count("*").alias("arcs"),
        (F.sum("d") / F.count("*")).alias("comm_dilat"),
        (F.sum(F.col("d") * F.col("load")) / total).alias("comm_expan"),
        (F.sum(F.when(F.col("d") > 0, F.col("load")).otherwise(0)) / total).alias("comm_cut"),
    )


def _ends(arcs: DataFrame, parts: DataFrame) -> DataFrame:
    s, d = (parts.select(F.col("id").alias(a), F.col("part").alias(b)) for a, b in (("src", "ps"), ("dst", "pd")))
    return _weighted(arcs).join(s, "src").join(d, "dst")


def part_loads(vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, size, load)."""
    load = F.col("load") if "load" in vertices.columns else F.lit(1)
    return vertices.join(parts, "id").groupBy("part").agg(F.count("*").alias("size"), F.sum(load).alias("load"))


def comm_loads(arcs: DataFrame, parts: DataFrame, distance: Column) -> DataFrame:
    """(distance, share): the share of arc load at each distance between parts."""
    d = _ends(arcs, parts).withColumn("distance", distance)
    whole = d.agg(F.sum("load").alias("whole"))
    return d.groupBy("distance").agg(F.sum("load").alias("load")).crossJoin(F.broadcast(whole)).select("distance", (F.col("load") / F.col("whole")).alias("share"))


def remap_metrics(vertices: DataFrame, old: DataFrame, new: DataFrame, distance: Column | None = None) -> DataFrame:
    """Migration from one mapping to another: vertices that move, mean distance (over columns ps, pd) and load moved."""
    load = F.col("load") if "load" in vertices.columns else F.lit(1)
    both = vertices.join(old.select("id", F.col("part").alias("ps")), "id").join(new.select("id", F.col("part").alias("pd")), "id").where("ps <> pd")
    dist = distance if distance is not None else F.lit(1)
    return both.agg(F.count("*").alias("migrated"), F.coalesce(F.avg(dist.cast("double")), F.lit(0.0)).alias("mean_distance"), F.coalesce(F.sum(load), F.lit(0)).cast("long").alias("load"))


def partition(vertices: DataFrame, arcs: DataFrame, k: int, imbalance: float = 0.05, fixed: DataFrame | None = None, rounds: int = 6) -> DataFrame:
    """(id, part): a balanced edge-cut partition in k parts.

    Multilevel: matching and contraction until no more than PLACED vertices, or 20 a part, are left, whatever the graph;
    these are placed one by one, heaviest first, where most load connects among parts with room; then projected back level
    by level, each time with rounds of greedy boundary moves that never lift a part over its bound. Only the coarsest level
    reaches the driver. Fixed vertices (id, part) keep their part; those of one part are contracted first.
    """
    if k < 1:
        raise ValueError("k must be positive")
    v = cut(vertices.select("id", (F.col("load") if "load" in vertices.columns else F.lit(1)).cast("long").alias("load")))
    a = cut(_among(_weighted(arcs).select("src", "dst", F.col("load").cast("long").alias("load")).where("src <> dst"), v))
    pinned = fixed.select("id", "part") if fixed is not None else None
    total = v.agg(F.sum("load")).first()[0] or 0
    bound = max(total / k * (1 + imbalance), v.agg(F.max("load")).first()[0] or 0)
    few = max(20 * k, PLACED)
    levels, n = [], v.count()
    free_v, free_a = v, a
    while n > few:
        groups = cut(_halve(free_v, free_a, 3 * total / few, pinned))
        cv, ca = coarsen(free_v, free_a, groups)
        levels.append((free_v, free_a, groups))
        free_v, free_a = cut(cv), cut(ca)
        n = free_v.count()
    parts = _refine(free_v, free_a, _place(free_v, free_a, k, bound, pinned), k, bound, rounds, pinned)
    for lv, la, groups in reversed(levels):
        parts = cut(groups.join(parts.withColumnRenamed("id", "group"), "group").select("id", "part"))
        parts = _refine(lv, la, parts, k, bound, rounds, pinned)
    return parts


#: Vertices of a coarsest graph, which the driver places; its arcs are at most their pairs.
PLACED = 1_000


def _halve(v: DataFrame, a: DataFrame, most: float, pinned: DataFrame | None) -> DataFrame:
    """(id, group) of one level. Vertices whose pairs hold at most a load of ``most`` are matched; those that found no mate (a
    star has one pair) are paired in the order of their heaviest neighbour, so that leaves of one hub meet. So all but one of
    them have a mate, and heavier ones are few: total / most * 2 at most."""
    light = v.where(F.col("load") * 2 <= most).select("id")
    held = None
    if pinned is not None:
        light = light.join(pinned, "id", "left_anti")
        held = pinned.join(v.select("id"), "id", "left_semi").groupBy("id").agg(F.min("part").alias("part"))
        least = held.groupBy("part").agg(F.min("id").alias("group"))
        held = held.join(F.broadcast(least), "part").select("id", "group")
    light = cut(light)
    mates = cut(match_heavy(_among(a, light), light))
    alone = mates.where("id = mate").select("id")
    by = a.join(alone.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.max(F.struct("load", (-F.col("dst")).alias("d"))).alias("m"))
    placed = cut(global_rank(alone.join(by, "id", "left").select("id", (-F.col("m.d")).alias("near")), "near", "id"))
    pair = F.floor(F.col("pos") / 2)
    heads = placed.where("pos % 2 = 0").select(pair.alias("pair"), F.col("id").alias("head"))
    tails = placed.select(pair.alias("pair"), "id")
    paired = tails.join(heads, "pair").select("id", F.col("head").alias("group"))
    groups = mates.where("id <> mate").select("id", F.least("id", "mate").alias("group")).unionByName(paired)
    if held is not None:
        groups = groups.unionByName(held)
    return v.select("id").join(groups, "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def _among(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Arcs whose ends both are among the vertices."""
    return arcs.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi")


def _place(v: DataFrame, a: DataFrame, k: int, bound: float, pinned: DataFrame | None) -> DataFrame:
    """The coarsest graph on the driver: heaviest first, the part of most connection that has room, else the lightest."""
    loads = {r["id"]: r["load"] for r in v.collect()}
    near: dict[int, list[tuple[int, int]]] = {}
    found = a.select("src", "dst", "load").toArrow()
    for i, j, w in zip(*(found.column(c).to_numpy().tolist() for c in ("src", "dst", "load"))):
        near.setdefault(i, []).append((j, w))
    part = {r["id"]: r["part"] for r in pinned.join(v, "id", "left_semi").collect()} if pinned is not None else {}
    fill = [0] * k
    for i, p in part.items():
        fill[p] += loads[i]
    done = set(part)
    for start in sorted(loads, key=lambda i: (-loads[i], i)):
        frontier = deque([start])
        while frontier:  # regions grow breadth-first, so that parts are connected
            i = frontier.popleft()
            if i in done:
                continue
            pull = [0] * k
            for j, w in near.get(i, ()):
                if j in part:
                    pull[part[j]] += w
            fits = [p for p in range(k) if fill[p] + loads[i] <= bound] or list(range(k))
            best = max(fits, key=lambda p: (pull[p], -fill[p], -p))
            if not pull[best]:
                best = min(fits, key=lambda p: (fill[p], p))
            part[i] = best
            fill[best] += loads[i]
            done.add(i)
            frontier.extend(j for j, _ in sorted(near.get(i, ()), key=lambda x: (-x[1], x[0])) if j not in done)
    return v.sparkSession.createDataFrame(list(part.items()), "id long, part int")


def _refine(v: DataFrame, a: DataFrame, parts: DataFrame, k: int, bound: float, rounds: int, pinned: DataFrame | None) -> DataFrame:
    """Greedy moves of boundary vertices to the part they connect to most. In a round only an independent set of vertices
    moves, and into each part only as many of the best gains as its room allows."""
    parts = cut(parts)
    for i in range(rounds):
        link = a.join(parts.select(F.col("id").alias("dst"), F.col("part").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("load").alias("w"))
        own = parts.join(link, (parts["id"] == link["id"]) & (parts["part"] == link["to"]), "left").select(parts["id"], "part", F.coalesce("w", F.lit(0)).alias("own"))
        best = link.join(parts.withColumnRenamed("part", "p"), "id").where("to <> p").groupBy("id").agg(F.max(F.struct("w", (-F.col("to")).alias("t"))).alias("b"))
        gain = own.join(best, "id").select("id", "part", (-F.col("b.t")).cast("int").alias("to"), (F.col("b.w") - F.col("own")).alias("gain")).where("gain > 0")
        if pinned is not None:
            gain = gain.join(pinned, "id", "left_anti")
        gain = cut(gain.join(v, "id"))
        mark = F.struct("gain", weight_of(F.col("id") + i).alias("h"), "id")
        rival = a.join(gain.select(F.col("id").alias("dst"), mark.alias("m")), "dst").groupBy(F.col("src").alias("id")).agg(F.max("m").alias("m"))
        moves = gain.join(rival, "id", "left").where(F.col("m").isNull() | (mark > F.col("m")))
        fill = v.join(parts, "id").groupBy("part").agg(F.sum("load").alias("fill")).withColumnRenamed("part", "to")
        room = F.sum("load").over(Window.partitionBy("to").orderBy(F.col("gain").desc(), "id").rowsBetween(Window.unboundedPreceding, 0))
        taken = cut(moves.withColumn("need", room).join(fill, "to", "left").where(F.col("need") + F.coalesce("fill", F.lit(0)) <= bound).select("id", F.col("to").alias("new")))
        if taken.isEmpty():
            break
        parts = cut(parts.join(taken, "id", "left").select("id", F.coalesce("new", "part").alias("part")))
    return parts


def _swaps(place: list[int], gain) -> list[int]:  # noqa: ANN001
    """Exchanges pairs of places as long as one lowers the cost."""
    moved = True
    while moved:
        moved = False
        for i in range(len(place)):
            for j in range(i + 1, len(place)):
                if gain(place, i, j) > 1e-9:
                    place[i], place[j] = place[j], place[i]
                    moved = True
    return place


def map_to(vertices: DataFrame, arcs: DataFrame, distance: list[list[int]], imbalance: float = 0.05, fixed: DataFrame | None = None) -> DataFrame:
    """(id, part): a mapping onto an architecture of which distance[a][b] is known, that keeps arc load times distance low.

    A balanced partition comes first; then its parts are placed: part pairs' loads, at most one row a pair, reach the driver,
    where the heaviest part goes to the most central place, each next one where it is nearest to what it talks to, and
    pairs of places are exchanged as long as that helps. Fixed vertices name places: their parts stay where they are.
    """
    k = len(distance)
    parts = cut(partition(vertices, arcs, k, imbalance, fixed))
    if fixed is not None:
        return parts
    talk = [[0.0] * k for _ in range(k)]
    for r in _ends(arcs, parts).where("ps <> pd").groupBy("ps", "pd").agg(F.sum("load").alias("w")).collect():
        talk[r["ps"]][r["pd"]] += r["w"] / 2
        talk[r["pd"]][r["ps"]] += r["w"] / 2
    place, free = [-1] * k, set(range(k))
    placed: list[int] = []
    while free:
        p = max((i for i in range(k) if place[i] < 0), key=lambda i: (sum(talk[i][j] for j in placed), sum(talk[i]), -i))
        at = min(free, key=lambda q: (sum(talk[p][j] * distance[q][place[j]] for j in placed), sum(distance[q]), q))
        place[p] = at
        placed.append(p)
        free.discard(at)

    def gain(where: list[int], i: int, j: int) -> float:
        others = [x for x in range(k) if x not in (i, j)]
        return sum((talk[i][x] - talk[j][x]) * (distance[where[i]][where[x]] - distance[where[j]][where[x]]) for x in others)

    place = _swaps(place, gain)
    named = vertices.sparkSession.createDataFrame(list(enumerate(place)), "p int, place int")
    return parts.withColumnRenamed("part", "p").join(F.broadcast(named), "p").select("id", F.col("place").alias("part"))


def remap(vertices: DataFrame, old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """(id, part): the new partition with its parts renamed so that little load migrates from the old one. Pairs of old and
    new parts, at most k * k rows, reach the driver: best pairs first, then exchanges."""
    load = F.col("load") if "load" in vertices.columns else F.lit(1)
    both = vertices.join(old.select("id", F.col("part").alias("ps")), "id").join(new.select("id", F.col("part").alias("pd")), "id")
    stays = [[0.0] * k for _ in range(k)]
    for r in both.groupBy("ps", "pd").agg(F.sum(load).alias("w")).collect():
        if 0 <= r["ps"] < k and 0 <= r["pd"] < k:
            stays[r["pd"]][r["ps"]] += r["w"]
    name, taken = [-1] * k, set()
    for p, q in sorted(((p, q) for p in range(k) for q in range(k)), key=lambda x: (-stays[x[0]][x[1]], x)):
        if name[p] < 0 and q not in taken:
            name[p] = q
            taken.add(q)
    name = _swaps(name, lambda n, i, j: stays[i][n[j]] + stays[j][n[i]] - stays[i][n[i]] - stays[j][n[j]])
    named = vertices.sparkSession.createDataFrame(list(enumerate(name)), "p int, place int")
    return new.withColumnRenamed("part", "p").join(F.broadcast(named), "p").select("id", F.col("place").alias("part"))


def part_neighbours(arcs: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, neighbours): how many other parts each part has arcs to; parts without any have no row."""
    return _ends(arcs, parts).where("ps <> pd").groupBy(F.col("ps").alias("part")).agg(F.countDistinct("pd").alias("neighbours"))


def migration_cost(vertices: DataFrame, old: DataFrame, new: DataFrame, arcs: DataFrame, weight: float = 1.0, distance: Column | None = None) -> DataFrame:
    """(cut_load, moved_load, cost): arc load between parts of the new mapping, counted once an edge, vertex load that
    migrates, times its distance, and cut_load + weight * moved_load."""
    load = F.col("load") if "load" in vertices.columns else F.lit(1)
    dist = distance if distance is not None else F.lit(1)
    both = vertices.join(old.select("id", F.col("part").alias("ps")), "id").join(new.select("id", F.col("part").alias("pd")), "id").where("ps <> pd")
    moved = both.agg(F.coalesce(F.sum(load * dist), F.lit(0)).cast("double").alias("moved_load"))
    apart = _ends(arcs, new).where("ps <> pd and src < dst").agg(F.coalesce(F.sum("load"), F.lit(0)).cast("double").alias("cut_load"))
    return apart.crossJoin(moved).select("cut_load", "moved_load", (F.col("cut_load") + weight * F.col("moved_load")).alias("cost"))


def repartition(vertices: DataFrame, arcs: DataFrame, k: int, old: DataFrame, imbalance: float = 0.05, rounds: int = 6) -> DataFrame:
    """Improves an old mapping by boundary moves alone, so that little migrates."""
    v = cut(vertices.select("id", (F.col("load") if "load" in vertices.columns else F.lit(1)).cast("long").alias("load")))
    a = cut(_among(_weighted(arcs).select("src", "dst", F.col("load").cast("long").alias("load")).where("src <> dst"), v))
    total, top = v.agg(F.sum("load"), F.max("load")).first()
    return _refine(v, a, old.select("id", F.col("part").cast("int").alias("part")), k, max((total or 0) / k * (1 + imbalance), top or 0), rounds, None)


def overlap_partition(vertices: DataFrame, arcs: DataFrame, k: int, imbalance: float = 0.05) -> DataFrame:
    """Vertex-separator partition: of every cut edge the end of more cut edges (then the smaller id) gets part -1."""
    parts = partition(vertices, arcs, k, imbalance)
    cuts = cut(_ends(arcs, parts).where("ps <> pd").select("src", "dst"))
    deg = cuts.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    both = cuts.join(deg.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    sep = both.select(F.when((F.col("ds") > F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst"))), F.col("src")).otherwise(F.col("dst")).alias("id")).distinct()
    return parts.join(sep.withColumn("s", F.lit(True)), "id", "left").select("id", F.when(F.col("s"), F.lit(-1)).otherwise(F.col("part")).alias("part"))


# --- target architectures --------------------------------------------------------------------------------------------


def arch(spark, n: int, distance: Column) -> DataFrame:  # noqa: ANN001
    """(src_part, dst_part, dist) of an architecture of n parts; distance over columns a and b."""
    a, b = spark.range(n).withColumnRenamed("id", "a"), spark.range(n).withColumnRenamed("id", "b")
    return a.crossJoin(b).select(F.col("a").alias("src_part"), F.col("b").alias("dst_part"), distance.cast("long").alias("dist"))


def complete(a: Column, b: Column) -> Column:
    return (a != b).cast("int")


def hypercube(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _axes(a: Column, b: Column, dims: tuple[int, ...]) -> list[tuple[Column, int]]:
    out = []
    for n in dims:
        out.append((F.abs(a % n - b % n), n))
        a, b = F.floor(a / n), F.floor(b / n)
    return out


def mesh(a: Column, b: Column, dims: tuple[int, ...]) -> Column:
    return sum((d for d, _ in _axes(a, b, dims)), F.lit(0))


def torus(a: Column, b: Column, dims: tuple[int, ...]) -> Column:
    return sum((F.least(d, n - d) for d, n in _axes(a, b, dims)), F.lit(0))


def tree_leaf(a: Column, b: Column, sizes: tuple[int, ...], costs: tuple[int, ...]) -> Column:
    """Leaves of a tree with so many children a level, from the root; the links of each level cost what costs says."""
    out, width = F.lit(0), 1
    for n, c in zip(reversed(sizes), reversed(costs)):
        out = out + F.when(F.floor(a / width) != F.floor(b / width), F.lit(2 * c)).otherwise(0)
        width *= n
    return out
