"""Named queries over the driver's tables, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.functions import hll
from rowmesh.operators import collectives as C
from rowmesh.operators import learn as L
from rowmesh.operators import linalg as M
from rowmesh.operators import reductions as R
from rowmesh.operators import sorting as S
from rowmesh.plans import graph as G
from rowmesh.plans.iterate import cut, scratch
from rowmesh.sources import formats as X
from rowmesh.sources import generators

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep


# --- views -----------------------------------------------------------------------------------------------------------

VEC = "SELECT l_suppkey % 8 AS rank, l_linenumber AS idx, CAST(SUM(l_quantity) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2"
MSG = "SELECT l_suppkey % 8 AS src, l_partkey % 8 AS dst, l_linenumber AS seq, CAST(SUM(l_quantity) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2, 3"
MAT = 'SELECT l_partkey AS "row", l_suppkey AS col, SUM(l_quantity) AS val FROM lineitem GROUP BY 1, 2'
ARC = (
    "SELECT src, dst FROM (SELECT c_custkey AS src, (7 * c_custkey + 3) % (SELECT count(*) FROM customer) + 1 AS dst FROM customer "
    "UNION SELECT c_custkey, c_custkey % (SELECT count(*) FROM customer) + 1 FROM customer) WHERE src <> dst"
)
SYM = f"SELECT src, dst FROM ({ARC}) UNION SELECT dst, src FROM ({ARC})"
WSYM = f"SELECT src, dst, least(src, dst) * 13 % 7 + 1 AS load FROM ({SYM})"
BIP = "SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst, 1 + l_partkey % 3 AS load FROM lineitem"
EMB = 'SELECT vec_id AS "row", CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS col, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings'


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vec(spark: SparkSession, sf: str) -> DataFrame:
    items = _table(spark, sf, "lineitem")
    return items.groupBy((F.col("l_suppkey") % 8).alias("rank"), F.col("l_linenumber").alias("idx")).agg(F.sum("l_quantity").cast("long").alias("val"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    items = _table(spark, sf, "lineitem")
    return items.groupBy((F.col("l_suppkey") % 8).alias("src"), (F.col("l_partkey") % 8).alias("dst"), F.col("l_linenumber").alias("seq")).agg(F.sum("l_quantity").cast("long").alias("val"))


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("val"))


def arcs(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "customer").select(F.col("c_custkey").alias("src"))
    n = F.broadcast(c.agg(F.count("*").alias("n")))
    far = c.crossJoin(n).select("src", ((7 * F.col("src") + 3) % F.col("n") + 1).alias("dst"))
    return G.symmetrize(far.unionByName(c.crossJoin(n).select("src", (F.col("src") % F.col("n") + 1).alias("dst"))))


def weighted_arcs(spark: SparkSession, sf: str) -> DataFrame:
    return arcs(spark, sf).withColumn("load", F.least("src", "dst") * 13 % 7 + 1)


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5 + 1).alias("load"))


def bipartite(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "lineitem").select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"), (1 + F.col("l_partkey") % 3).alias("load")).distinct()


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val")).select("row", F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))


def ranks(spark: SparkSession, n: int = 8) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "rank")


# --- reductions ------------------------------------------------------------------------------------------------------

_SQL_OPS = {
    "max": "max(val)", "min": "min(val)", "sum": "CAST(sum(val) AS BIGINT)", "land": "CAST(bool_and(val <> 0) AS INT)", "lor": "CAST(bool_or(val <> 0) AS INT)",
    "lxor": "CAST(sum(CASE WHEN val <> 0 THEN 1 ELSE 0 END) % 2 AS INT)", "band": "bit_and(val)", "bor": "bit_or(val)", "bxor": "bit_xor(val)",
}
for _name, _sql in _SQL_OPS.items():
    _v = "val % 3" if _name in ("land", "lor", "lxor") else "val"

    @query(f"SELECT idx, {_sql} AS val FROM (SELECT rank, idx, {_v} AS val FROM ({VEC})) GROUP BY 1", f"reduce_{_name}")
    def _reduce(spark: SparkSession, sf: str, op: str = _name, v: str = _v) -> DataFrame:
        return R.reduce(vec(spark, sf).withColumn("val", F.expr(v)), op, ["idx"])


@query(f"SELECT idx, CAST(product(val % 3 + 1) AS BIGINT) AS val FROM ({VEC}) GROUP BY 1")
def reduce_prod(spark: SparkSession, sf: str) -> DataFrame:
    return R.reduce(vec(spark, sf).withColumn("val", F.col("val") % 3 + 1), "prod", ["idx"]).withColumn("val", F.col("val").cast("long"))


@query(f"SELECT idx, max(v) AS val, CAST(arg_max(rank, (v, -rank)) AS BIGINT) AS loc FROM (SELECT *, val % 4 AS v FROM ({VEC})) GROUP BY 1")
def reduce_maxloc(spark: SparkSession, sf: str) -> DataFrame:
    return R.reduce(vec(spark, sf).withColumn("val", F.col("val") % 4), "maxloc", ["idx"], loc="rank")


@query(f"SELECT idx, min(v) AS val, CAST(arg_min(rank, (v, rank)) AS BIGINT) AS loc FROM (SELECT *, val % 4 AS v FROM ({VEC})) GROUP BY 1")
def reduce_minloc(spark: SparkSession, sf: str) -> DataFrame:
    return R.reduce(vec(spark, sf).withColumn("val", F.col("val") % 4), "minloc", ["idx"], loc="rank")


@query(f"SELECT v.rank, v.idx, v.val, t.total FROM ({VEC}) v JOIN (SELECT idx, CAST(sum(val) AS BIGINT) AS total FROM ({VEC}) GROUP BY 1) t USING (idx)")
def allreduce_sum(spark: SparkSession, sf: str) -> DataFrame:
    return R.allreduce(vec(spark, sf), "sum", ["idx"]).select("rank", "idx", "val", "total")


@query(f"SELECT idx, CAST(sum(val) AS BIGINT) AS val FROM ({VEC}) GROUP BY 1")
def reduce_two_phase(spark: SparkSession, sf: str) -> DataFrame:
    _, fold = R.reduce_parts(vec(spark, sf), "rank", "sum", ["idx"])
    return fold()


@query("SELECT l_partkey AS id, sum(l_quantity) AS val FROM lineitem GROUP BY 1")
def merge_sum(spark: SparkSession, sf: str) -> DataFrame:
    a = _table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("val"), "l_linenumber")
    return R.merge([a.where("l_linenumber % 2 = 1"), a.where("l_linenumber % 2 = 0")])


@query("SELECT l_partkey AS id, max(l_quantity) AS val FROM lineitem GROUP BY 1")
def merge_many(spark: SparkSession, sf: str) -> DataFrame:
    a = _table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("val"), "l_linenumber")
    return R.merge([a.where(F.col("l_linenumber") % 5 == k) for k in range(5)], "max")


for _name, _op, _incl, _sql in (
    ("scan_sum", "sum", True, "CAST(sum(val) OVER (PARTITION BY idx ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT)"),
    ("scan_max", "max", True, "max(val) OVER (PARTITION BY idx ORDER BY rank ROWS UNBOUNDED PRECEDING)"),
    ("scan_bxor", "bxor", True, "bit_xor(val) OVER (PARTITION BY idx ORDER BY rank ROWS UNBOUNDED PRECEDING)"),
    ("exscan_sum", "sum", False, "CAST(coalesce(sum(val) OVER (PARTITION BY idx ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"),
    ("exscan_identity", "band", False, "coalesce(bit_and(val) OVER (PARTITION BY idx ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)"),
):

    @query(f"SELECT rank, idx, val, {_sql} AS scan FROM ({VEC})", _name)
    def _scan(spark: SparkSession, sf: str, op: str = _op, inclusive: bool = _incl) -> DataFrame:
        return R.scan(vec(spark, sf), op, inclusive=inclusive).select("rank", "idx", "val", "scan")


@query("SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey RANGE UNBOUNDED PRECEDING) AS BIGINT) AS scan FROM orders")
def scan_long(spark: SparkSession, sf: str) -> DataFrame:
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return R.long_scan(orders, "o_orderkey", "o_custkey", ranges=32).select("o_orderkey", "scan")


# --- collectives and messages ----------------------------------------------------------------------------------------

_GATHER = f"SELECT rank, idx, val, CAST(row_number() OVER (ORDER BY rank, idx) - 1 AS BIGINT) AS pos FROM ({VEC})"


@query(_GATHER)
def gather(spark: SparkSession, sf: str) -> DataFrame:
    return C.gather(vec(spark, sf)).select("rank", "idx", "val", "pos")


@query(f"SELECT rank, count(*) AS count, CAST(coalesce(sum(count(*)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS displ FROM ({VEC}) WHERE idx <= rank GROUP BY 1")
def gatherv_displs(spark: SparkSession, sf: str) -> DataFrame:
    return C.displacements(vec(spark, sf).where("idx <= rank"))


@query(f"SELECT pos // 9 AS rank, pos % 9 AS idx, val FROM ({_GATHER})")
def scatter(spark: SparkSession, sf: str) -> DataFrame:
    return C.scatter(C.gather(vec(spark, sf)).select("pos", "val"), 9).select("rank", "idx", "val")


@query(f"SELECT s.rank, pos - displ AS idx, val FROM ({_GATHER}) g JOIN (SELECT range AS rank, range * (range + 1) // 2 AS displ, range + 1 AS count FROM range(8)) s ON pos >= displ AND pos < displ + count")
def scatterv(spark: SparkSession, sf: str) -> DataFrame:
    slices = ranks(spark).select("rank", F.expr("rank * (rank + 1) div 2").alias("displ"), (F.col("rank") + 1).alias("count"))
    return C.scatterv(C.gather(vec(spark, sf)).select("pos", "val"), slices).select("rank", "idx", "val")


@query(f"SELECT range AS at, pos, val FROM ({_GATHER}), range(8)")
def allgather(spark: SparkSession, sf: str) -> DataFrame:
    return C.allgather(vec(spark, sf), ranks(spark)).select("at", "pos", "val")


@query(f"SELECT dst AS src, src AS dst, seq, val FROM ({MSG})")
def alltoall_transpose(spark: SparkSession, sf: str) -> DataFrame:
    return C.alltoall(messages(spark, sf))


@query(f"SELECT src, dst, seq, val, CAST(row_number() OVER (PARTITION BY dst ORDER BY src, seq) - 1 AS BIGINT) AS \"offset\" FROM ({MSG})")
def alltoallv(spark: SparkSession, sf: str) -> DataFrame:
    return C.alltoallv(messages(spark, sf)).select("src", "dst", "seq", "val", "offset")


@query(f"SELECT range AS rank, idx, val FROM ({VEC}) v, range(8) WHERE v.rank = 3")
def bcast_join(spark: SparkSession, sf: str) -> DataFrame:
    return C.bcast(vec(spark, sf), 3, ranks(spark)).select("rank", "idx", "val")


@query(f"SELECT a.rank, a.idx, a.val, b.val AS received FROM ({VEC}) a LEFT JOIN ({VEC}) b ON xor(a.rank, 2) = b.rank AND a.idx = b.idx")
def sendrecv_hypercube(spark: SparkSession, sf: str) -> DataFrame:
    return C.sendrecv(vec(spark, sf), F.col("rank").bitwiseXOR(F.lit(2))).select("rank", "idx", "val", "received")


@query(f"SELECT rank, idx, val, (rank + idx) % 8 AS dest FROM ({VEC})")
def route_send(spark: SparkSession, sf: str) -> DataFrame:
    return C.send(vec(spark, sf), (F.col("rank") + F.col("idx")) % 8)


@query(f"SELECT src, dst, seq, val FROM ({MSG}) WHERE dst = 5 AND src = 2")
def recv_match(spark: SparkSession, sf: str) -> DataFrame:
    return C.recv(messages(spark, sf).where("dst = 5"), source=2)


@query(f"SELECT src, seq % 3 AS tag, count(*) AS pending FROM ({MSG}) GROUP BY 1, 2")
def probe_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.probe(messages(spark, sf).withColumn("tag", F.col("seq") % 3))


@query("SELECT range AS rank, range % 3 AS color, row_number() OVER (PARTITION BY range % 3 ORDER BY range % 2, range) - 1 AS new_rank, count(*) OVER (PARTITION BY range % 3) AS size FROM range(24)")
def comm_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.comm_split(ranks(spark, 24), F.col("rank") % 3, F.col("rank") % 2)


@query("SELECT range AS rank, range // 8 AS color, row_number() OVER (PARTITION BY range // 8 ORDER BY range) - 1 AS new_rank, count(*) OVER (PARTITION BY range // 8) AS size FROM range(24)")
def comm_split_grid3(spark: SparkSession, sf: str) -> DataFrame:
    return C.comm_split(ranks(spark, 24), F.expr("rank div 8"), F.col("rank"))


@query("SELECT range AS rank, range // 4 AS node, range % 4 AS lrank, count(*) OVER (PARTITION BY range // 4) AS lsize, CAST(6 AS BIGINT) AS nsize, min(range) OVER (PARTITION BY range // 4) AS rrank, row_number() OVER (ORDER BY range % 4, range // 4) - 1 AS crank FROM range(22)")
def comm_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    return C.comm_nodes(ranks(spark, 22), 4)


# --- sorting ---------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY l_extendedprice) - 1 AS pos, l_extendedprice FROM lineitem")
def sample_sort_rank(spark: SparkSession, sf: str) -> DataFrame:
    return S.global_rank(_table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice").select("pos", "l_extendedprice")


_SPLIT = "SELECT r.range AS i, x.v AS splitter FROM range(1, 8) r JOIN (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS pos FROM lineitem) x ON x.pos = r.range * (SELECT count(*) FROM lineitem) // 8"


@query(_SPLIT)
def splitters(spark: SparkSession, sf: str) -> DataFrame:
    return S.splitters(_table(spark, sf, "lineitem"), "l_extendedprice", 8)


@query(f"SELECT (SELECT count(*) FROM ({_SPLIT}) s WHERE s.splitter < l_extendedprice) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def bucket_hist(spark: SparkSession, sf: str) -> DataFrame:
    items = _table(spark, sf, "lineitem")
    return S.bucket_histogram(items, "l_extendedprice", S.splitters(items, "l_extendedprice", 8))


@query("SELECT count(*) FILTER (WHERE b > o_totalprice) AS inversions FROM (SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS b FROM orders)")
def sort_inversions(spark: SparkSession, sf: str) -> DataFrame:
    placed = S.global_rank(_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return S.inversions(placed, "pos", "o_totalprice")


@query(f'SELECT "row", arg_max(col, (val, -col)) AS col, max(val) AS val FROM ({MAT}) GROUP BY 1')
def argmax_row(spark: SparkSession, sf: str) -> DataFrame:
    return S.argmax(matrix(spark, sf), "row", "val", "col")


# --- matrices --------------------------------------------------------------------------------------------------------


@query(f'SELECT "row", round(sum(val * (col % 10)), 6) AS y FROM ({MAT}) GROUP BY 1')
def spmv(spark: SparkSession, sf: str) -> DataFrame:
    x = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 10).cast("double").alias("x"))
    return M.spmv(matrix(spark, sf), x).withColumn("y", F.round("y", 6))


@query(f'SELECT "row", col, round(val / sqrt(sum(val * val) OVER (PARTITION BY "row")), 6) AS val FROM ({MAT})')
def row_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return M.row_normalize(matrix(spark, sf)).withColumn("val", F.round("val", 6))


@query(f'SELECT "row" // 300 AS block_r, col // 30 AS block_c, count(*) AS nnz FROM ({MAT}) GROUP BY 1, 2')
def block_nnz(spark: SparkSession, sf: str) -> DataFrame:
    return M.blocked(matrix(spark, sf), 300, 30).groupBy("block_r", "block_c").agg(F.count("*").alias("nnz"))


@query(f'SELECT "row", nnz, CAST(floor(coalesce(sum(nnz) OVER (ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 / sum(nnz) OVER ()) AS BIGINT) AS part FROM (SELECT "row", count(*) AS nnz FROM ({MAT}) GROUP BY 1)')
def nnz_balanced_partition(spark: SparkSession, sf: str) -> DataFrame:
    return M.balanced_rows(matrix(spark, sf), 8)


@query(f'SELECT "row" + r.range * 5000 AS "row", col + c.range * 500 AS col, val FROM ({MAT}), range(2) r, range(3) c')
def block_replicate(spark: SparkSession, sf: str) -> DataFrame:
    return M.replicate(matrix(spark, sf), 2, 3, 5000, 500)


@query("SELECT round(sum(cos((range + 0.5) * pi() / 8000) * pi() / 8000), 9) AS integral FROM range(4000)")
def integral_cos(spark: SparkSession, sf: str) -> DataFrame:
    import math

    return M.integral(spark, F.cos, 0.0, math.pi / 2, 4000).select(F.round("integral", 9).alias("integral"))


# --- ranking ---------------------------------------------------------------------------------------------------------


def _pagerank_sql(arcs_: str, rounds: int, sinks: bool = True, weighted: bool = False, source: str | None = None, every: bool = False) -> str:
    share = "CAST(load AS DOUBLE) / sum(load) OVER (PARTITION BY src)" if weighted else "1.0 / count(*) OVER (PARTITION BY src)"
    restart = f"CASE WHEN id = {source} THEN 1.0 ELSE 0.0 END" if source else "1.0 / count(*) OVER ()"
    out = [
        f"a AS MATERIALIZED ({arcs_})", "v AS MATERIALIZED (SELECT src AS id FROM a UNION SELECT dst FROM a)",
        f"s AS MATERIALIZED (SELECT src, dst, CAST({share} AS DOUBLE) AS share FROM a)", f"b AS MATERIALIZED (SELECT id, CAST({restart} AS DOUBLE) AS restart, id NOT IN (SELECT src FROM a) AS sink FROM v)",
        "p0 AS MATERIALIZED (SELECT id, restart AS pr FROM b)",
    ]
    for i in range(rounds):
        pool = f" + restart * (SELECT coalesce(sum(pr), 0) FROM p{i} JOIN b USING (id) WHERE sink)" if sinks else ""
        out.append(f"g{i} AS MATERIALIZED (SELECT dst AS id, sum(pr * share) AS gain FROM s JOIN p{i} ON id = src GROUP BY 1), p{i + 1} AS MATERIALIZED (SELECT id, 0.2 * restart + 0.8 * (coalesce(gain, 0){pool}) AS pr FROM b LEFT JOIN g{i} USING (id))")
    last = f"SELECT round(sqrt(sum((x.pr - y.pr) ** 2)), 9) AS residual FROM p{rounds} x JOIN p{rounds - 1} y USING (id)" if every else f"SELECT id, round(pr, 9) AS pr FROM p{rounds}"
    return "WITH " + ", ".join(out) + " " + last


def _ranked(spark: SparkSession, arcs_: DataFrame, rounds: int, **options) -> DataFrame:  # noqa: ANN003
    arcs_ = cut(arcs_)
    return G.pagerank(arcs_, G.vertices_of(arcs_), rounds, **options)


@query(_pagerank_sql(BIP, 5))
def pagerank_5(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, bipartite(spark, sf), 5).withColumn("pr", F.round("pr", 9))


@query(_pagerank_sql(BIP, 5, sinks=False))
def pagerank_nosink_5(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, bipartite(spark, sf), 5, sinks=False).withColumn("pr", F.round("pr", 9))


@query(_pagerank_sql(WSYM, 5, weighted=True))
def pagerank_weighted_5(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, weighted_arcs(spark, sf), 5, weighted=True).withColumn("pr", F.round("pr", 9))


@query(_pagerank_sql(SYM, 5, source="1"))
def ppr_5(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, arcs(spark, sf), 5, source=1).withColumn("pr", F.round("pr", 9))


@query(_pagerank_sql(BIP, 5, every=True))
def pagerank_residual(spark: SparkSession, sf: str) -> DataFrame:
    a = cut(bipartite(spark, sf))
    change = G.pagerank_change(a, G.vertices_of(a), 5)
    return spark.range(1).select(F.round(F.lit(change), 9).alias("residual"))


# --- graphs ----------------------------------------------------------------------------------------------------------


def _spread_sql(what: str, value: str) -> str:
    return f"SELECT '{what}' AS what, min(v) AS low, max(v) AS high, sum(v) AS total, round(avg(v), 6) AS mean, round(avg(abs(v - m)), 6) AS dlt FROM (SELECT v, avg(v) OVER () AS m FROM (SELECT CAST({value} AS DOUBLE) AS v"


@query(
    _spread_sql("vertex", "c_custkey % 5 + 1") + " FROM customer)) UNION ALL "
    + _spread_sql("degree", "coalesce(n, 0)") + f" FROM customer LEFT JOIN (SELECT src, count(*) AS n FROM ({SYM}) GROUP BY 1) ON src = c_custkey)) UNION ALL "
    + _spread_sql("edge", "load") + f" FROM ({WSYM})))"
)
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = G.graph_stats(customers(spark, sf), weighted_arcs(spark, sf))
    return s.withColumns({"mean": F.round("mean", 6), "dlt": F.round("dlt", 6)})


_RAW = "SELECT c_custkey % 50 AS src, c_nationkey AS dst FROM customer"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "customer").select((F.col("c_custkey") % 50).alias("src"), F.col("c_nationkey").cast("long").alias("dst"))


@query(f"SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM ({_RAW}) WHERE src = dst")
def graph_check_loops(spark: SparkSession, sf: str) -> DataFrame:
    return G.loops(_raw(spark, sf))


@query(f"SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, count(*) AS n FROM ({_RAW}) GROUP BY 1, 2 HAVING count(*) > 1")
def graph_check_dups(spark: SparkSession, sf: str) -> DataFrame:
    return G.duplicate_arcs(_raw(spark, sf))


@query(f"SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM ({_RAW}) a WHERE NOT EXISTS (SELECT 1 FROM ({_RAW}) b WHERE a.src = b.dst AND a.dst = b.src)")
def graph_check_asym(spark: SparkSession, sf: str) -> DataFrame:
    return G.unmatched_arcs(_raw(spark, sf))


@query(f"SELECT src - 1 AS src, dst - 1 AS dst FROM ({SYM})")
def rebase(spark: SparkSession, sf: str) -> DataFrame:
    return G.rebase(arcs(spark, sf), -1)


_IND = "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS new FROM customer WHERE {}"


@query(f"WITH n AS ({_IND.format('c_custkey % 3 <> 0')}) SELECT s.new AS src, d.new AS dst FROM ({SYM}) a JOIN n s ON s.id = src JOIN n d ON d.id = dst")
def induce_list(spark: SparkSession, sf: str) -> DataFrame:
    return G.induce(customers(spark, sf).where("id % 3 <> 0"), arcs(spark, sf))[1]


@query(f"WITH n AS ({_IND.format('c_nationkey % 2 = 1')}) SELECT s.new AS src, d.new AS dst, a.load FROM ({WSYM}) a JOIN n s ON s.id = src JOIN n d ON d.id = dst")
def induce_part(spark: SparkSession, sf: str) -> DataFrame:
    part = _table(spark, sf, "customer").where("c_nationkey % 2 = 1").select(F.col("c_custkey").alias("id"))
    return G.induce(part, weighted_arcs(spark, sf))[1]


@query(f"SELECT src AS id, CAST(sum(c_nationkey) AS BIGINT) AS total FROM ({SYM}) JOIN customer ON c_custkey = dst GROUP BY 1")
def halo_sum(spark: SparkSession, sf: str) -> DataFrame:
    attr = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("total"))
    return G.halo(arcs(spark, sf), attr, "total")


_MESH = "SELECT DISTINCT l_orderkey AS elem, l_suppkey AS node FROM lineitem"


@query(f"SELECT DISTINCT a.node AS src, b.node AS dst FROM ({_MESH}) a JOIN ({_MESH}) b USING (elem) WHERE a.node <> b.node")
def mesh_dual(spark: SparkSession, sf: str) -> DataFrame:
    m = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_suppkey").alias("node"))
    return G.mesh_dual(m)


def _grow_sql(seeds: str, depth: int, last: str) -> str:
    out = [f"a AS MATERIALIZED ({SYM})", f"s0 AS MATERIALIZED (SELECT id, color, 0 AS level FROM ({seeds}))"]
    for i in range(1, depth + 1):
        out.append(f"s{i} AS MATERIALIZED (SELECT id, color, level FROM s{i - 1} UNION ALL SELECT dst, min(color), {i} FROM s{i - 1} JOIN a ON id = src WHERE level = {i - 1} AND dst NOT IN (SELECT id FROM s{i - 1}) GROUP BY 1)")
    return "WITH " + ", ".join(out) + " " + last.format(f"s{depth}")


@query(_grow_sql("SELECT c_custkey AS id, c_custkey AS color FROM customer WHERE c_custkey IN (5, 40, 90)", 3, "SELECT id, color, level FROM {}"))
def bfs_grow_3(spark: SparkSession, sf: str) -> DataFrame:
    seeds = _table(spark, sf, "customer").where("c_custkey in (5, 40, 90)").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("color"))
    return G.grow(cut(arcs(spark, sf)), seeds, 3)


@query(_grow_sql("SELECT c_custkey AS id, 0 AS color FROM customer WHERE c_custkey IN (7, 70)", 2, "SELECT src, dst FROM a WHERE src IN (SELECT id FROM {0}) AND dst IN (SELECT id FROM {0})"))
def band_2(spark: SparkSession, sf: str) -> DataFrame:
    front = _table(spark, sf, "customer").where("c_custkey in (7, 70)").select(F.col("c_custkey").alias("id"))
    return G.band(cut(arcs(spark, sf)), front, 2)[1]


@query()
def part_diameter(spark: SparkSession, sf: str) -> DataFrame:
    d = G.pseudo_diameter(cut(arcs(spark, sf)), 1)
    return spark.createDataFrame([(d,)], "diameter int")


_KIN = f"SELECT src, dst FROM ({SYM}) JOIN customer s ON s.c_custkey = src JOIN customer d ON d.c_custkey = dst WHERE s.c_nationkey % 4 = d.c_nationkey % 4"


@query(f"WITH RECURSIVE a AS MATERIALIZED ({_KIN}), r AS (SELECT DISTINCT src AS id, src AS far FROM a UNION SELECT r.id, a.dst FROM r JOIN a ON a.src = r.far) SELECT id, min(far) AS root FROM r GROUP BY 1")
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Of the customers' graph without the arcs between different quarters of the nations, which leaves many components."""
    quarter = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 4).alias("q"))
    ends = arcs(spark, sf).join(quarter.withColumnsRenamed({"id": "src", "q": "qs"}), "src").join(quarter.withColumnsRenamed({"id": "dst", "q": "qd"}), "dst")
    return G.components(cut(ends.where("qs = qd").select("src", "dst")))


# --- sketches --------------------------------------------------------------------------------------------------------


def _hash_sql(x: str) -> str:
    h = f"(({x} * 48271 + 11) % 2147483647)"
    h = f"(({h} * 69621 + 7) % 2147483647)"
    return f"((xor({h}, {h} >> 13) * 16807 + 3) % 2147483647)"


def _sketch_sql(by: str, value: str, source: str, bits: int) -> str:
    return f"SELECT {by}, h % {1 << bits} AS reg, max(CASE WHEN (h >> {bits}) = 0 THEN 32 ELSE bit_count(((h >> {bits}) & -(h >> {bits})) - 1) + 1 END) AS val FROM (SELECT {by}, {_hash_sql(value)} AS h FROM {source}) GROUP BY 1, 2"


def _estimate_sql(inner: str, by: str, bits: int) -> str:
    m = 1 << bits
    return f"SELECT {by}, {m * m * 0.72134!r}::DOUBLE / (sum(pow(2.0::DOUBLE, -val)) + ({m} - count(*))) AS size FROM ({inner}) GROUP BY 1"


@query(f"SELECT l_suppkey, reg, CAST(val AS INT) AS val FROM ({_sketch_sql('l_suppkey', 'l_partkey', 'lineitem', 6)})")
def hll_registers(spark: SparkSession, sf: str) -> DataFrame:
    return hll.sketch(_table(spark, sf, "lineitem"), ["l_suppkey"], "l_partkey", 6)


@query(f"SELECT l_suppkey, round(size, 6) AS size FROM ({_estimate_sql(_sketch_sql('l_suppkey', 'l_partkey', 'lineitem', 6), 'l_suppkey', 6)})")
def hll_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return hll.estimate(hll.sketch(_table(spark, sf, "lineitem"), ["l_suppkey"], "l_partkey", 6), ["l_suppkey"], 6).withColumn("size", F.round("size", 6))


@query(f"SELECT l_suppkey, reg, CAST(max(val) AS INT) AS val FROM (SELECT * FROM ({_sketch_sql('l_suppkey', 'l_partkey', 'lineitem', 4)}) UNION ALL SELECT * FROM ({_sketch_sql('l_suppkey', 'l_orderkey', 'lineitem', 4)})) GROUP BY 1, 2")
def hll_union(spark: SparkSession, sf: str) -> DataFrame:
    items = _table(spark, sf, "lineitem")
    return hll.union(hll.sketch(items, ["l_suppkey"], "l_partkey"), hll.sketch(items, ["l_suppkey"], "l_orderkey"), ["l_suppkey"])


def _anf_sql(rounds: int, bits: int, last: str) -> str:
    out = [f"a AS MATERIALIZED ({SYM})", "v AS MATERIALIZED (SELECT DISTINCT src AS id FROM a)", f"k0 AS MATERIALIZED ({_sketch_sql('id', 'id', 'v', bits)})"]
    for i in range(1, rounds + 1):
        out.append(f"k{i} AS MATERIALIZED (SELECT id, reg, max(val) AS val FROM (SELECT id, reg, val FROM k{i - 1} UNION ALL SELECT src, reg, val FROM a JOIN k{i - 1} ON id = dst) GROUP BY 1, 2)")
    union = " UNION ALL ".join(f"SELECT {i} AS t, sum(size) AS n FROM ({_estimate_sql(f'SELECT * FROM k{i}', 'id', bits)})" for i in range(rounds + 1))
    return "WITH " + ", ".join(out) + f", anf AS ({union}) " + last


@query(_anf_sql(3, 6, "SELECT t, round(n, 3) AS n FROM anf"))
def hyperanf_3(spark: SparkSession, sf: str) -> DataFrame:
    a = cut(arcs(spark, sf))
    return hll.hyper_anf(a, G.vertices_of(a), 3, 6).withColumn("n", F.round("n", 3))


@query(_anf_sql(20, 6, "SELECT round(CASE WHEN t = 0 THEN 0 ELSE t - 1 + (0.9 * top - b) / (n - b) END, 6) AS effective_diameter FROM (SELECT t, n, coalesce(lag(n) OVER (ORDER BY t), 0) AS b, max(n) OVER () AS top FROM anf) WHERE n >= 0.9 * top ORDER BY t LIMIT 1"))
def effective_diameter(spark: SparkSession, sf: str) -> DataFrame:
    a = cut(arcs(spark, sf))
    return hll.effective_diameter(hll.hyper_anf(a, G.vertices_of(a), None, 6)).select(F.round("effective_diameter", 6).alias("effective_diameter"))


# --- colouring, matching, partition ----------------------------------------------------------------------------------


def _color_sql(rounds: int, smallest: bool) -> str:
    w = "({0} * 2654435761 % 2147483648)"
    out = [f"a AS MATERIALIZED ({SYM})", "c0 AS MATERIALIZED (SELECT c_custkey AS id, CAST(0 AS BIGINT) AS color FROM customer)"]
    for i in range(1, rounds + 1):
        p = f"c{i - 1}"
        won = f"SELECT o.id FROM {p} o WHERE color = 0 AND NOT EXISTS (SELECT 1 FROM a JOIN {p} x ON x.id = a.dst AND x.color = 0 WHERE a.src = o.id AND ({w.format('x.id')}, x.id) > ({w.format('o.id')}, o.id))"
        free = f"(SELECT min(r.range) FROM range(1, 64) r WHERE r.range NOT IN (SELECT y.color FROM a JOIN {p} y ON y.id = a.dst WHERE a.src = w{i}.id))" if smallest else str(i)
        out += [f"w{i} AS MATERIALIZED ({won})", f"n{i} AS MATERIALIZED (SELECT id, CAST({free} AS BIGINT) AS new FROM w{i})", f"c{i} AS MATERIALIZED (SELECT id, coalesce(new, color) AS color FROM {p} LEFT JOIN n{i} USING (id))"]
    return "WITH " + ", ".join(out) + f" SELECT id, color FROM c{rounds}"


@query(_color_sql(20, True))  # far more rounds than either takes: the SQL has no loop
def coloring_jp(spark: SparkSession, sf: str) -> DataFrame:
    return G.color_jones_plassmann(cut(arcs(spark, sf)), customers(spark, sf))


@query(_color_sql(20, False))
def coloring_luby(spark: SparkSession, sf: str) -> DataFrame:
    return G.color_luby(cut(arcs(spark, sf)), customers(spark, sf))


@query(f"SELECT count(*) FILTER (WHERE s.c_nationkey = d.c_nationkey) AS conflicts, count(DISTINCT src) FILTER (WHERE s.c_nationkey = d.c_nationkey) AS vertices FROM ({SYM}) JOIN customer s ON s.c_custkey = src JOIN customer d ON d.c_custkey = dst")
def color_clashes(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts of a colouring that isn't proper: customers by nation."""
    colors = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 1).cast("long").alias("color"))
    return G.color_conflicts(arcs(spark, sf), colors).agg(F.count("*").alias("conflicts"), F.countDistinct("src").alias("vertices"))


@query("SELECT CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS uncolored")
def color_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    a = cut(arcs(spark, sf))
    colors = G.color_jones_plassmann(a, customers(spark, sf))
    return G.color_conflicts(a, colors).agg(F.count("*").alias("conflicts")).crossJoin(colors.agg(F.count(F.when(F.col("color") == 0, 1)).alias("uncolored")))


_MATE = (
    f"WITH a AS MATERIALIZED (SELECT src, dst, load, (least(src, dst) * 31 + greatest(src, dst)) * 2654435761 % 2147483648 AS t FROM ({WSYM}) WHERE src IN (SELECT c_custkey FROM customer) AND dst IN (SELECT c_custkey FROM customer)), "
    "p AS MATERIALIZED (SELECT src, arg_max(dst, (load, t, -dst)) AS dst FROM a GROUP BY 1), "
    "m AS MATERIALIZED (SELECT c_custkey AS id, coalesce(q.src, c_custkey) AS mate FROM customer LEFT JOIN p ON p.src = c_custkey LEFT JOIN p q ON q.src = p.dst AND q.dst = c_custkey)"
)


@query(_MATE + " SELECT id, mate FROM m")
def matching_hem(spark: SparkSession, sf: str) -> DataFrame:
    return G.match_heavy(cut(weighted_arcs(spark, sf)), customers(spark, sf), 1)


@query(_MATE + ", g AS (SELECT id, least(id, mate) AS grp FROM m) SELECT s.grp AS src, d.grp AS dst, CAST(sum(load) AS BIGINT) AS load FROM a JOIN g s ON s.id = src JOIN g d ON d.id = dst WHERE s.grp <> d.grp GROUP BY 1, 2")
def coarsen_once(spark: SparkSession, sf: str) -> DataFrame:
    return G.coarsen_matched(customers(spark, sf), cut(weighted_arcs(spark, sf)), 1)[1]


_PARTS = "SELECT c_custkey AS id, c_nationkey % 4 AS part FROM customer"


def _parts(spark: SparkSession, sf: str, by: str = "c_nationkey % 4") -> DataFrame:
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(by).alias("part"))


@query(f"SELECT count(*) AS arcs, round(avg(CAST(p.part <> q.part AS INT)), 6) AS comm_dilat, round(sum(CASE WHEN p.part <> q.part THEN load ELSE 0 END) / sum(load), 6) AS comm_expan, round(sum(CASE WHEN p.part <> q.part THEN load ELSE 0 END) / sum(load), 6) AS comm_cut FROM ({WSYM}) JOIN ({_PARTS}) p ON p.id = src JOIN ({_PARTS}) q ON q.id = dst")
def map_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = G.map_metrics(weighted_arcs(spark, sf), _parts(spark, sf))
    return m.select("arcs", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"SELECT CAST(bit_count(xor(p.part, q.part)) AS BIGINT) AS distance, round(sum(load) / sum(sum(load)) OVER (), 6) AS share FROM ({WSYM}) JOIN ({_PARTS}) p ON p.id = src JOIN ({_PARTS}) q ON q.id = dst GROUP BY 1")
def map_comm_loads(spark: SparkSession, sf: str) -> DataFrame:
    d = G.hypercube(F.col("ps"), F.col("pd")).cast("long")
    return G.comm_loads(weighted_arcs(spark, sf), _parts(spark, sf), d).withColumn("share", F.round("share", 6))


@query(f"SELECT part, count(*) AS size, CAST(sum(c_custkey % 5 + 1) AS BIGINT) AS load FROM customer JOIN ({_PARTS}) ON id = c_custkey GROUP BY 1")
def map_part_loads(spark: SparkSession, sf: str) -> DataFrame:
    return G.part_loads(customers(spark, sf), _parts(spark, sf))


@query("SELECT count(*) AS migrated, round(coalesce(avg(abs(c_nationkey % 4 - c_custkey % 4)), 0), 6) AS mean_distance, CAST(coalesce(sum(c_custkey % 5 + 1), 0) AS BIGINT) AS load FROM customer WHERE c_nationkey % 4 <> c_custkey % 4")
def remap_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = G.remap_metrics(customers(spark, sf), _parts(spark, sf), _parts(spark, sf, "c_custkey % 4"), F.abs(F.col("ps") - F.col("pd")))
    return m.withColumn("mean_distance", F.round("mean_distance", 6))


@query(f"SELECT p.part AS part, count(DISTINCT q.part) AS neighbours FROM ({WSYM}) JOIN ({_PARTS}) p ON p.id = src JOIN ({_PARTS}) q ON q.id = dst WHERE p.part <> q.part GROUP BY 1")
def map_part_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return G.part_neighbours(weighted_arcs(spark, sf), _parts(spark, sf))


@query(
    f"WITH c AS (SELECT CAST(coalesce(sum(load), 0) AS DOUBLE) AS cut_load FROM ({WSYM}) JOIN customer p ON p.c_custkey = src JOIN customer q ON q.c_custkey = dst WHERE p.c_custkey % 4 <> q.c_custkey % 4 AND src < dst), "
    "m AS (SELECT CAST(coalesce(sum(abs(c_nationkey % 4 - c_custkey % 4) * (c_custkey % 5 + 1)), 0) AS DOUBLE) AS moved_load FROM customer WHERE c_nationkey % 4 <> c_custkey % 4) "
    "SELECT cut_load, moved_load, cut_load + 0.5 * moved_load AS cost FROM c, m"
)
def remap_cost(spark: SparkSession, sf: str) -> DataFrame:
    return G.migration_cost(customers(spark, sf), _parts(spark, sf), _parts(spark, sf, "c_custkey % 4"), weighted_arcs(spark, sf), 0.5, F.abs(F.col("ps") - F.col("pd")))


@query()
def part_diameters(spark: SparkSession, sf: str) -> DataFrame:
    return G.part_diameters(arcs(spark, sf), _parts(spark, sf))


@query()
def map_to_hypercube(spark: SparkSession, sf: str) -> DataFrame:
    return G.map_to(customers(spark, sf), weighted_arcs(spark, sf), [[(a ^ b).bit_count() for b in range(8)] for a in range(8)])


def _arch_sql(n: int, dist: str) -> str:
    return f"SELECT a.range AS src_part, b.range AS dst_part, CAST({dist} AS BIGINT) AS dist FROM range({n}) a, range({n}) b"


_ARCHES = {
    "cmplt": (6, G.complete, "a.range <> b.range"),
    "hcub": (8, G.hypercube, "bit_count(xor(a.range, b.range))"),
    "mesh": (12, lambda a, b: G.mesh(a, b, (4, 3)), "abs(a.range % 4 - b.range % 4) + abs(a.range // 4 - b.range // 4)"),
    "torus": (20, lambda a, b: G.torus(a, b, (5, 4)), "least(abs(a.range % 5 - b.range % 5), 5 - abs(a.range % 5 - b.range % 5)) + least(abs(a.range // 5 - b.range // 5), 4 - abs(a.range // 5 - b.range // 5))"),
    "tleaf": (12, lambda a, b: G.tree_leaf(a, b, (3, 4), (10, 1)), "CASE WHEN a.range <> b.range THEN 2 ELSE 0 END + CASE WHEN a.range // 4 <> b.range // 4 THEN 20 ELSE 0 END"),
}
for _name, (_n, _dist, _sql) in _ARCHES.items():

    @query(_arch_sql(_n, _sql), f"arch_dist_{_name}")
    def _arch(spark: SparkSession, sf: str, n: int = _n, dist=_dist) -> DataFrame:  # noqa: ANN001
        return G.arch(spark, n, dist(F.col("a"), F.col("b")))


@query("SELECT true AS every_vertex, true AS balanced, true AS cut_below_hashing")
def partition_kway(spark: SparkSession, sf: str) -> DataFrame:
    v, a = cut(customers(spark, sf)), cut(weighted_arcs(spark, sf))
    p = cut(G.partition(v, a, 4))
    hashed = v.select("id", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("part"))
    sizes = G.part_loads(v, p).agg((F.max("load") <= F.sum("load") / 4 * 1.05 + 5).alias("balanced"), F.sum("size").alias("n"))
    cuts = G.map_metrics(a, p).select(F.col("comm_cut").alias("c")).crossJoin(G.map_metrics(a, hashed).select(F.col("comm_cut").alias("h")))
    return sizes.crossJoin(v.agg(F.count("*").alias("all"))).crossJoin(cuts).select((F.col("n") == F.col("all")).alias("every_vertex"), "balanced", (F.col("c") < F.col("h")).alias("cut_below_hashing"))


# --- files: written to the shared folder and read back ----------------------------------------------------------------


def _dense(spark: SparkSession, sf: str, base: int) -> tuple[DataFrame, DataFrame]:
    """All ends of the customers' arcs, which are dense from 0, and the arcs, both from ``base`` on."""
    a = cut(G.rebase(weighted_arcs(spark, sf), base))
    return G.vertices_of(a).withColumn("load", F.col("id") % 5 + 1), a


@query(f"SELECT src, dst, load FROM ({WSYM})")
def file_source_graph(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "grf")
    X.write_grf(*_dense(spark, sf, 0), path)
    return X.read_grf(spark, path)[1]


@query(f"SELECT DISTINCT src + 1 AS id, (src + 1) % 5 + 1 AS load FROM ({SYM})")
def file_source_graph_vertices(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "grf")
    X.write_grf(*_dense(spark, sf, 1), path, base=1)
    return X.read_grf(spark, path)[0].select("id", "load")


@query(f"SELECT src + 1 AS src, dst + 1 AS dst, load FROM ({WSYM})")
def file_chaco(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "chaco")
    X.write_chaco(*_dense(spark, sf, 1), path)
    return X.read_chaco(spark, path)[1]


@query(f"SELECT src, dst FROM ({SYM})")
def file_matrix_market(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "mm")
    X.write_matrix_market(arcs(spark, sf), _table(spark, sf, "customer").count(), path)
    return X.read_matrix_market(spark, path)


@query(f"SELECT src, dst FROM ({SYM})")
def file_dimacs(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "dimacs")
    X.write_dimacs(arcs(spark, sf), path)
    return X.read_dimacs(spark, path)


@query(f"SELECT src, dst FROM ({SYM})")
def file_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "adj")
    X.write_adjacency(arcs(spark, sf), path)
    return X.adjacency_arcs(X.read_adjacency(spark, path))


@query(f"SELECT src, dst FROM ({SYM})")
def file_edge_list(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "edges")
    X.write_edge_list(arcs(spark, sf), path)
    return X.edge_list(spark, path)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, CAST(o_custkey AS DOUBLE) AS x FROM orders")
def file_vector(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "vector")
    X.write_vector(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").cast("double").alias("x")), path)
    return X.read_vector(spark, path)


@query(f'SELECT "row", col, val FROM ({MAT})')
def file_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "coo")
    X.write_coo(matrix(spark, sf), path)
    return X.read_coo(spark, path)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_nationkey % 4 END AS part FROM customer")
def file_mapping(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "map")
    X.write_mapping(_parts(spark, sf).where("id % 3 <> 0"), path)
    return X.read_mapping(spark, path, customers(spark, sf))


@query("SELECT c_custkey AS id, c_custkey % 6 AS part FROM customer")
def file_scatter(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "parts")
    X.scatter_files(customers(spark, sf).select("id"), path, 6)
    return spark.read.parquet(path).select("id", F.col("part").cast("long").alias("part"))


# --- generators ------------------------------------------------------------------------------------------------------


def _both_ways(sql: str) -> str:
    return f"SELECT DISTINCT s AS src, d AS dst FROM (SELECT a AS s, b AS d FROM ({sql}) UNION ALL SELECT b, a FROM ({sql})) WHERE s <> d"


_XY, _XYZ = "SELECT range AS id, range % 7 AS x, range // 7 AS y FROM range(35)", "SELECT range AS id, range % 4 AS x, range // 4 % 3 AS y, range // 12 AS z FROM range(60)"
_GENERATED = {
    "grid2": (lambda s: generators.grid(s, 7, 5), f"SELECT p.id AS a, q.id AS b FROM ({_XY}) p, ({_XY}) q WHERE abs(p.x - q.x) + abs(p.y - q.y) = 1"),
    "torus2": (lambda s: generators.grid(s, 7, 5, torus=True), f"SELECT p.id AS a, q.id AS b FROM ({_XY}) p, ({_XY}) q WHERE least(abs(p.x - q.x), 7 - abs(p.x - q.x)) + least(abs(p.y - q.y), 5 - abs(p.y - q.y)) = 1"),
    "grid3": (lambda s: generators.grid(s, 4, 3, 5), f"SELECT p.id AS a, q.id AS b FROM ({_XYZ}) p, ({_XYZ}) q WHERE abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1"),
    "torus3": (lambda s: generators.grid(s, 4, 3, 5, torus=True), f"SELECT p.id AS a, q.id AS b FROM ({_XYZ}) p, ({_XYZ}) q WHERE least(abs(p.x - q.x), 4 - abs(p.x - q.x)) + least(abs(p.y - q.y), 3 - abs(p.y - q.y)) + least(abs(p.z - q.z), 5 - abs(p.z - q.z)) = 1"),
    "hypercube": (lambda s: generators.hypercube(s, 6), "SELECT p.range AS a, q.range AS b FROM range(64) p, range(64) q WHERE bit_count(xor(p.range, q.range)) = 1"),
    "de_bruijn": (lambda s: generators.de_bruijn(s, 6), "SELECT p.range AS a, (2 * p.range + q.range) % 64 AS b FROM range(64) p, range(2) q"),
}
for _name, (_make, _sql) in _GENERATED.items():

    @query(_both_ways(_sql), f"gen_{_name}")
    def _generated(spark: SparkSession, sf: str, make=_make) -> DataFrame:  # noqa: ANN001
        return make(spark).select("src", "dst")


@query(_both_ways("SELECT p.id AS a, q.id AS b FROM (SELECT range AS id, range % 5 AS x, range // 5 AS y FROM range(20)) p, (SELECT range AS id, range % 5 AS x, range // 5 AS y FROM range(20)) q WHERE abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1"))
def gen_mesh2_dual(spark: SparkSession, sf: str) -> DataFrame:
    return G.mesh_dual(generators.elements(spark, 4, 3))


@query(_both_ways("SELECT p.id AS a, q.id AS b FROM (SELECT range AS id, range % 4 AS x, range // 4 % 3 AS y, range // 12 AS z FROM range(36)) p, (SELECT range AS id, range % 4 AS x, range // 4 % 3 AS y, range // 12 AS z FROM range(36)) q WHERE abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.z - q.z) <= 1"))
def gen_mesh3_dual(spark: SparkSession, sf: str) -> DataFrame:
    return G.mesh_dual(generators.bricks(spark, 3, 2, 2))


# --- learning --------------------------------------------------------------------------------------------------------

_UNIT = f'SELECT "row", col, val / sqrt(sum(val * val) OVER (PARTITION BY "row")) AS val FROM ({EMB})'


def _kmeans_sql(rounds: int, last: str) -> str:
    out = [f"u AS MATERIALIZED ({_UNIT})", 'c0 AS MATERIALIZED (SELECT "row" AS k, col, val FROM u WHERE "row" < 4)']
    for i in range(1, rounds + 1):
        out.append(f'd{i} AS MATERIALIZED (SELECT u."row", k, sum(u.val * c.val) AS sim FROM u JOIN c{i - 1} c USING (col) GROUP BY 1, 2)')
        out.append(f'l{i} AS MATERIALIZED (SELECT "row", arg_max(k, (sim, -k)) AS k, max(sim) AS sim FROM d{i} GROUP BY 1)')
        out.append(f's{i} AS MATERIALIZED (SELECT k, col, sum(val) AS val FROM u JOIN l{i} USING ("row") GROUP BY 1, 2)')
        out.append(f"c{i} AS MATERIALIZED (SELECT k, col, val / sqrt(sum(val * val) OVER (PARTITION BY k)) AS val FROM s{i})")
    return "WITH " + ", ".join(out) + " " + last


def _start(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    unit = cut(M.row_normalize(embedded(spark, sf)))
    return unit, unit.where("row < 4").select(F.col("row").alias("k"), "col", "val")


@query(_kmeans_sql(1, 'SELECT "row", k, round(sim, 5) AS sim FROM l1'))
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    return L.assign(*_start(spark, sf)).withColumn("sim", F.round("sim", 5))


@query(_kmeans_sql(1, "SELECT k, col, round(val, 5) AS val FROM c1"))
def kmeans_centers(spark: SparkSession, sf: str) -> DataFrame:
    unit, centers = _start(spark, sf)
    return L.centers_of(unit, L.assign(unit, centers)).select("k", "col", F.round("val", 5).alias("val"))


@query(_kmeans_sql(2, 'SELECT "row", k FROM l2'))
def kmeans_2iter(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.range(4).select(F.col("id").alias("k"), F.col("id").alias("row"))
    return L.spherical_kmeans(embedded(spark, sf), seeds, 2)[0].select("row", "k")


@query(_kmeans_sql(1, "SELECT k, any_value(n) AS size, round(sqrt(sum(val * val)), 5) AS norm FROM s1 JOIN (SELECT k, count(*) AS n FROM l1 GROUP BY 1) USING (k) GROUP BY 1"))
def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    unit, centers = _start(spark, sf)
    return L.cluster_stats(unit, L.assign(unit, centers)).withColumn("norm", F.round("norm", 5))


@query(f'WITH u AS MATERIALIZED ({_UNIT}), d AS (SELECT col, sum(CASE WHEN "row" = 0 THEN val ELSE -val END) AS d FROM u WHERE "row" IN (0, 1) GROUP BY 1) SELECT "row", CASE WHEN sum(val * d) > 0 THEN 0 ELSE 1 END AS k FROM u JOIN d USING (col) GROUP BY 1')
def bisect_once(spark: SparkSession, sf: str) -> DataFrame:
    return L.bisect(embedded(spark, sf), (0, 1), 1)


@query()
def bisecting_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return L.bisecting_kmeans(embedded(spark, sf), 3, 4)


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    o = _table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("row"))
    i = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("col"), "l_quantity")
    return o.join(i, "o_orderkey").groupBy("row", "col").agg(F.avg("l_quantity").alias("val"))


RAT = 'SELECT o_custkey AS "row", l_partkey AS col, avg(l_quantity) AS val FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2'


@query(f"SELECT round(avg(val), 6) AS mu FROM ({RAT})")
def mf_mean(spark: SparkSession, sf: str) -> DataFrame:
    return ratings(spark, sf).agg(F.round(F.avg("val"), 6).alias("mu"))


@query(f'WITH r AS MATERIALIZED ({RAT}), m AS (SELECT avg(val) AS mu FROM r), b AS MATERIALIZED (SELECT "row", avg(val) - (SELECT mu FROM m) AS rb FROM r GROUP BY 1), c AS MATERIALIZED (SELECT col, avg(val - (SELECT mu FROM m) - rb) AS cb FROM r JOIN b USING ("row") GROUP BY 1) SELECT round(avg(abs(val - mu - rb - cb)), 6) AS mae, round(sqrt(avg((val - mu - rb - cb) ** 2)), 6) AS rmse FROM r JOIN b USING ("row") JOIN c USING (col), m')
def mf_bias_error(spark: SparkSession, sf: str) -> DataFrame:
    r = cut(ratings(spark, sf))
    mu, rb, cb = L.bias_model(r)
    e = L.error(r.join(rb, "row").join(cb, "col").withColumn("pred", F.lit(mu) + F.col("rb") + F.col("cb")))
    return e.select(F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@query()
def mf_sgd_epoch(spark: SparkSession, sf: str) -> DataFrame:
    r = cut(ratings(spark, sf))
    return L.error(L.predict(r, *L.sgd(r, rank=4, blocks=2, epochs=1)))
