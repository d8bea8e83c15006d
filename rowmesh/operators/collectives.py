"""Collectives and point-to-point messages over a rank column: shuffles, joins and windows within ranks.

A buffer is (rank, idx, val). Positions across ranks come from per-rank counts, which are few, never from one window over
all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def displacements(df: DataFrame, by: str = "rank") -> DataFrame:
    """(by, count, displ): rows of each rank and the rows of all ranks before it."""
    counts = df.groupBy(by).agg(F.count("*").alias("count"))
    return counts.withColumn("displ", F.coalesce(F.sum("count").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def gather(df: DataFrame, by: str = "rank", order: list[str] = ["idx"], into: str = "pos") -> DataFrame:  # noqa: B006
    """Every row with its place in the concatenation of the ranks' buffers, by rank and then by order."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return df.withColumn("__at", at).join(displacements(df, by).select(by, "displ"), by).withColumn(into, (F.col("displ") + F.col("__at")).cast("long")).drop("__at", "displ")


def scatter(df: DataFrame, count: int, pos: str = "pos") -> DataFrame:
    """Slices of ``count`` consecutive places: rank and idx of each row."""
    if count < 1:
        raise ValueError("count must be positive")
    return df.withColumn("rank", F.floor(F.col(pos) / count).cast("long")).withColumn("idx", F.col(pos) % count)


def scatterv(df: DataFrame, slices: DataFrame, pos: str = "pos") -> DataFrame:
    """Slices of given (rank, displ, count), which are few: a range join. Overlapping slices repeat rows."""
    s = slices.select("rank", "displ", "count")
    return df.join(s, (F.col(pos) >= F.col("displ")) & (F.col(pos) < F.col("displ") + F.col("count"))).withColumn("idx", F.col(pos) - F.col("displ")).drop("displ", "count")


def bcast(df: DataFrame, root: int, ranks: DataFrame, by: str = "rank") -> DataFrame:
    """The root's buffer on every rank of ``ranks``; the receiver takes the place of the sender."""
    return df.where(F.col(by) == root).drop(by).crossJoin(ranks.select(by))


def allgather(df: DataFrame, ranks: DataFrame, by: str = "rank") -> DataFrame:
    """The concatenation on every rank: (at, pos, val)."""
    return gather(df, by).drop(by, "idx").crossJoin(ranks.select(F.col(by).alias("at")))


def alltoall(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Block transpose: what src holds for dst is what dst receives from src. One hash shuffle by the receiver."""
    swapped = {src: F.col(dst).alias(src), dst: F.col(src).alias(dst)}
    return df.select(*[swapped.get(c, F.col(c)) for c in df.columns]).repartition(src)


def alltoallv(df: DataFrame, src: str = "src", dst: str = "dst", order: list[str] = ["seq"]) -> DataFrame:  # noqa: B006
    """Variable block transpose: each row with its offset in the receiver's buffer, by sender and then by order."""
    counts = df.groupBy(src, dst).agg(F.count("*").alias("count"))
    offsets = counts.withColumn("displ", F.coalesce(F.sum("count").over(Window.partitionBy(dst).orderBy(src).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy(src, dst).orderBy(*order)) - 1
    return df.withColumn("__at", at).join(offsets.select(src, dst, "displ"), [src, dst]).withColumn("offset", F.col("displ") + F.col("__at")).drop("__at", "displ")


def send(df: DataFrame, dest: Column) -> DataFrame:
    """Rows routed to the rank that dest gives."""
    return df.withColumn("dest", dest).repartition("dest")


def recv(messages: DataFrame, source: int | None = None, tag: int | None = None) -> DataFrame:
    """Messages that match; None stands for any."""
    for name, want in (("src", source), ("tag", tag)):
        messages = messages if want is None else messages.where(F.col(name) == want)
    return messages


def probe(messages: DataFrame, by: tuple[str, ...] = ("src", "tag")) -> DataFrame:
    """Number of pending messages of each envelope."""
    return messages.groupBy(*by).agg(F.count("*").alias("pending"))


def iprobe(messages: DataFrame, source: int | None = None, tag: int | None = None) -> bool:
    return not recv(messages, source, tag).isEmpty()


def get_count(messages: DataFrame, source: int | None = None, tag: int | None = None) -> int:
    return recv(messages, source, tag).count()


def sendrecv(df: DataFrame, partner: Column, by: str = "rank", keys: tuple[str, ...] = ("idx",), val: str = "val") -> DataFrame:
    """Every row beside its partner's value of the same keys; null where there is no such partner."""
    other = df.select(F.col(by).alias("__rank"), *[F.col(k).alias(f"__{k}") for k in keys], F.col(val).alias("received"))
    on = F.col("__partner") == F.col("__rank")
    for k in keys:
        on &= F.col(k) == F.col(f"__{k}")
    return df.withColumn("__partner", partner).join(other, on, "left").drop("__rank", "__partner", *[f"__{k}" for k in keys])


def comm_split(ranks: DataFrame, color: Column, key: Column, by: str = "rank") -> DataFrame:
    """(rank, color, new_rank, size): groups by color, ordered by key and then by old rank. A null color joins none."""
    rows = ranks.select(by, color.alias("color"), key.alias("__key")).where("color is not null")
    w = Window.partitionBy("color")
    return rows.select(by, "color", (F.row_number().over(w.orderBy("__key", by)) - 1).cast("long").alias("new_rank"), F.count("*").over(w).alias("size"))


def comm_nodes(ranks: DataFrame, per_node: int, by: str = "rank") -> DataFrame:
    """Node groups of consecutive ranks: node, rank and size within it, number of nodes, the node's first rank, and the
    cyclic rank, which goes round the nodes."""
    rows = ranks.select(by).withColumn("node", F.floor(F.col(by) / per_node).cast("long")).withColumn("lrank", F.col(by) % per_node)
    nodes = rows.select(F.countDistinct("node").alias("nsize"))
    sized = rows.withColumn("lsize", F.count("*").over(Window.partitionBy("node"))).withColumn("rrank", F.min(by).over(Window.partitionBy("node")))
    before = rows.groupBy("lrank").agg(F.count("*").alias("n"))
    before = before.select(F.col("lrank"), F.coalesce(F.sum("n").over(Window.orderBy("lrank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    ranked = sized.join(before, "lrank").withColumn("crank", (F.col("b") + F.row_number().over(Window.partitionBy("lrank").orderBy("node")) - 1).cast("long"))
    return ranked.crossJoin(nodes).select(by, "node", "lrank", "lsize", "nsize", "rrank", "crank")
