"""Graph and matrix files as DataFrames. Text formats are read with the text reader and parsed by expressions; line
numbers, where a format needs them, come from the counts of the partitions of one file.

Vertices are (id, load, label), arcs (src, dst, load), matrices (row, col, val).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


# --- binary CSR ------------------------------------------------------------------------------------------------------


def write_csr(path: str, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray | None, columns: int) -> None:
    """int32 rows, int32 columns, int64 row starts, int32 column numbers, float32 values if there are any."""
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", len(indptr) - 1, columns))
        f.write(np.asarray(indptr, "<i8").tobytes())
        f.write(np.asarray(indices, "<i4").tobytes())
        if values is not None:
            f.write(np.asarray(values, "<f4").tobytes())


class _Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _CsrReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.parts = options["path"], int(options.get("parts", "8"))
        with open(self.path, "rb") as f:
            self.rows, self.cols = struct.unpack("<ii", f.read(8))
        size = os.path.getsize(self.path) - 8 - 8 * (self.rows + 1)
        self.nnz = int(np.memmap(self.path, "<i8", "r", 8 + 8 * self.rows, (1,))[0])
        self.valued = size >= 8 * self.nnz and self.nnz > 0

    def partitions(self) -> list[InputPartition]:
        """Row ranges of about equal entries."""
        starts = np.memmap(self.path, "<i8", "r", 8, (self.rows + 1,))
        cuts = np.searchsorted(starts, [i * self.nnz // self.parts for i in range(1, self.parts)]).tolist()
        edges = sorted({0, *cuts, self.rows})
        return [_Rows(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        starts = np.memmap(self.path, "<i8", "r", 8, (self.rows + 1,))[partition.first : partition.last + 1].astype(np.int64)
        base = 8 + 8 * (self.rows + 1)
        rows = np.repeat(np.arange(partition.first, partition.last), np.diff(starts))
        for at in range(0, len(rows), 1 << 20):
            n = min(1 << 20, len(rows) - at)
            cols = np.fromfile(self.path, "<i4", n, offset=base + 4 * (int(starts[0]) + at))
            vals = np.fromfile(self.path, "<f4", n, offset=base + 4 * (self.nnz + int(starts[0]) + at)) if self.valued else np.ones(n, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(rows[at : at + n]), pa.array(cols.astype(np.int64)), pa.array(vals)], ["row", "col", "val"])


class CsrSource(DataSource):
    """Format ``csrbin``: option path, and parts, the number of row ranges of about equal entries."""

    @classmethod
    def name(cls) -> str:
        return "csrbin"

    def schema(self) -> str:
        return "row bigint, col bigint, val float"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _CsrReader(self.options)


def read_csr(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(CsrSource)
    return spark.read.format("csrbin").option("path", path).option("parts", str(parts)).load()


# --- text ------------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines of a file, or of a folder's files in order of their names, from 0. Each split is counted, and then
    placed by the counts before; a split's own lines are read in order by one task."""
    from rowmesh.plans.iterate import cut

    read = spark.read.text(path)
    placed = cut(read.withColumns({"f": F.input_file_name(), "s": F.input_file_block_start(), "m": F.monotonically_increasing_id()}))
    splits = placed.groupBy("f", "s").agg(F.count("*").alias("c"), F.min("m").alias("m0"))
    before = splits.select("f", "s", "m0", F.coalesce(F.sum("c").over(Window.orderBy("f", "s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return placed.join(F.broadcast(before), ["f", "s"]).select((F.col("b") + F.col("m") - F.col("m0")).alias("n"), "value")


def _fields(value: str = "value"):  # noqa: ANN202
    return F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != "")


def read_coo(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``row col value``."""
    f = spark.read.text(path).select(_fields().alias("f")).where(F.size("f") >= 3)
    return f.select(F.col("f")[0].cast("long").alias("row"), F.col("f")[1].cast("long").alias("col"), F.col("f")[2].cast("double").alias("val"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(i, x): one number a line."""
    return _lines(spark, path).select(F.col("n").alias("i"), F.trim("value").cast("double").alias("x"))


def write_coo(matrix: DataFrame, path: str) -> None:
    """Lines ``row col value``."""
    matrix.select(F.concat_ws(" ", "row", "col", "val").alias("value")).write.text(path)


def write_mapping(parts: DataFrame, path: str) -> None:
    """The number of vertices, then lines ``vertex part`` in order of the vertices."""
    head = parts.agg(F.count("*").alias("c")).select(F.lit(None).cast("long").alias("id"), F.col("c").cast("string").alias("value"))
    body = parts.select("id", F.concat_ws("\t", "id", "part").alias("value"))
    head.unionByName(body).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def write_edge_list(arcs: DataFrame, path: str) -> None:
    """Lines ``u v``, one for both directions."""
    arcs.where("src < dst").select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)


def write_vector(df: DataFrame, path: str, i: str = "i", x: str = "x") -> None:
    """One number a line, by i: range-partitioned files in order."""
    df.repartitionByRange(i).sortWithinPartitions(i).select(F.format_string("%f", F.col(x)).alias("value")).write.text(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id | out ids | in ids``: (id, out, in, bad); bad holds a line that doesn't parse, the rest then being null."""
    sound = F.col("value").rlike(r"^\s*\d+\s*\|[\d\s]*\|[\d\s]*$")
    part = F.split("value", r"\|")
    ids = lambda k: F.transform(F.filter(F.split(F.trim(part[k]), r"\s+"), lambda x: x != ""), lambda x: x.cast("long"))
    t = spark.read.text(path).where(F.trim("value") != "")
    return t.select(F.when(sound, F.trim(part[0]).cast("long")).alias("id"), F.when(sound, ids(1)).alias("out"), F.when(sound, ids(2)).alias("in"), F.when(~sound, F.col("value")).alias("bad"))


def write_adjacency(arcs: DataFrame, path: str) -> None:
    out = arcs.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("out"))
    back = arcs.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("in"))
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), " "), F.lit(""))
    both = out.join(back, "id", "full").orderBy("id")
    both.select(F.concat(F.col("id").cast("string"), F.lit(" | "), text("out"), F.lit(" | "), text("in")).alias("value")).write.text(path)


def adjacency_arcs(adjacency: DataFrame) -> DataFrame:
    return adjacency.where("id is not null").select(F.col("id").alias("src"), F.explode("out").alias("dst"))


def count_numbers(text):  # noqa: ANN001, ANN201
    """Number of integers in a string of digits and blanks; -1 if there is anything else."""
    return F.when(text.rlike(r"[^\d\s]"), F.lit(-1)).otherwise(F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")))


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """Arcs of the lines ``e u v``."""
    f = spark.read.text(path).where(F.col("value").startswith("e ")).select(_fields().alias("f"))
    return f.select(F.col("f")[1].cast("long").alias("src"), F.col("f")[2].cast("long").alias("dst"))


def write_dimacs(arcs: DataFrame, path: str) -> None:
    n = arcs.agg(F.max(F.greatest("src", "dst")).alias("v"), F.count("*").alias("e"))
    head = n.select(F.lit(0).alias("o"), F.concat_ws(" ", F.lit("p edge"), "v", "e").alias("value"))
    body = arcs.select(F.lit(1).alias("o"), F.concat_ws(" ", F.lit("e"), "src", "dst").alias("value"))
    head.unionByName(body).repartitionByRange("o").sortWithinPartitions("o", "value").select("value").write.text(path)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """A square coordinate pattern as a symmetric graph: comments skipped, loops and repeated arcs dropped; ids from 1."""
    from rowmesh.plans.graph import symmetrize

    f = _lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).select("n", _fields().alias("f"))
    head = f.orderBy("n").first()
    if head is None or head["f"][0] != head["f"][1]:
        raise ValueError("not a square matrix")
    return symmetrize(f.where(F.col("n") > head["n"]).select(F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst")))


def write_matrix_market(arcs: DataFrame, vertices: int, path: str) -> None:
    """The lower triangle of a symmetric pattern; ids from 1."""
    low = arcs.where("src > dst")
    head = low.agg(F.count("*").alias("n")).select(F.lit(0).alias("o"), F.concat(F.lit(f"%%MatrixMarket matrix coordinate pattern symmetric\n{vertices} {vertices} "), F.col("n").cast("string")).alias("value"))
    body = low.select(F.lit(1).alias("o"), F.concat_ws(" ", "src", "dst").alias("value"))
    head.unionByName(body).repartitionByRange("o").sortWithinPartitions("o", "value").select("value").write.text(path)


def read_chaco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, arcs) of ``n m [fmt]`` and one line of neighbours a vertex, ids from 1. fmt: last digit arc loads, the one
    before vertex loads."""
    rows = _lines(spark, path).where(~F.col("value").startswith("%"))
    head = rows.orderBy("n").first()
    fmt = (head["value"].split() + ["0"])[2].zfill(3) if len(head["value"].split()) > 2 else "000"
    body = rows.where((F.col("n") > head["n"])).select((F.col("n") - head["n"]).alias("id"), _fields().alias("f")).where(F.col("id") <= int(head["value"].split()[0]))
    skip = int(fmt[1] == "1")
    load = F.col("f")[0].cast("long") if skip else F.lit(1).cast("long")
    vertices = body.select("id", load.alias("load"))
    step = 2 if fmt[2] == "1" else 1
    at = body.where(F.size("f") > skip).select("id", "f", F.explode(F.sequence(F.lit(skip), F.size("f") - step, F.lit(step))).alias("k"))
    arcs = at.select(F.col("id").alias("src"), F.get("f", F.col("k")).cast("long").alias("dst"), (F.get("f", F.col("k") + 1).cast("long") if step == 2 else F.lit(1).cast("long")).alias("load"))
    return vertices, arcs


def write_chaco(vertices: DataFrame, arcs: DataFrame, path: str) -> None:
    """Vertices (id from 1 on, load) and arcs (src, dst, load), with all loads."""
    near = arcs.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dst", "load"))), lambda x: F.concat_ws(" ", x["dst"], x["load"])), " ").alias("near"))
    n = vertices.count()
    head = arcs.agg(F.count("*").alias("m")).select(F.lit(0).cast("long").alias("id"), F.concat(F.lit(f"{n} "), F.expr("cast(m div 2 as string)"), F.lit(" 011")).alias("value"))
    body = vertices.join(near, "id", "left").select("id", F.concat_ws(" ", F.col("load").cast("string"), "near").alias("value"))
    head.unionByName(body).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def read_grf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, arcs) of a source graph: version, ``vertices arcs``, ``base flags``, then a line a vertex: label if the first
    flag is set, load if the last is, degree, neighbours, each after its load if the middle flag is set."""
    rows = _lines(spark, path).where(F.trim("value") != "")
    head = [r["value"].split() for r in rows.orderBy("n").limit(3).collect()]
    if len(head) < 3 or head[0] != ["0"]:
        raise ValueError("not a source graph of version 0")
    n, base, flags = int(head[1][0]), int(head[2][0]), head[2][1].zfill(3)
    labelled, arc_loads, loads = (c == "1" for c in flags)
    body = rows.where("n > 2").select((F.col("n") - 3 + base).alias("id"), _fields().alias("f")).where(F.col("id") < n + base)
    at = int(labelled)
    vertices = body.select("id", (F.col("f")[at].cast("long") if loads else F.lit(1).cast("long")).alias("load"), (F.col("f")[0].cast("long") if labelled else F.col("id")).alias("label"))
    first = at + int(loads) + 1
    step = 2 if arc_loads else 1
    cells = body.where(F.size("f") > first).select("id", "f", F.explode(F.sequence(F.lit(first), F.size("f") - step, F.lit(step))).alias("k"))
    arcs = cells.select(F.col("id").alias("src"), F.get("f", F.col("k") + step - 1).cast("long").alias("dst"), (F.get("f", F.col("k")).cast("long") if arc_loads else F.lit(1).cast("long")).alias("load"))
    if labelled:
        by_label = vertices.select(F.col("label").alias("dst"), F.col("id").alias("d"))
        arcs = arcs.join(by_label, "dst").select("src", F.col("d").alias("dst"), "load")
    return vertices, arcs


def write_grf(vertices: DataFrame, arcs: DataFrame, path: str, base: int = 0) -> None:
    """Vertices (id dense from base, load) and arcs (src, dst, load), with all loads."""
    near = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dst", "load"))), lambda x: F.concat_ws(" ", x["load"], x["dst"])), " ").alias("near"))
    n, m = vertices.count(), arcs.count()
    head = vertices.sparkSession.createDataFrame([(-1 + base, f"0\n{n} {m}\n{base} 011")], "id long, value string")
    body = vertices.join(near, "id", "left").select("id", F.concat_ws(" ", F.col("load").cast("string"), F.coalesce("deg", F.lit(0)).cast("string"), "near").alias("value"))
    head.unionByName(body).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def read_mapping(spark: SparkSession, path: str, vertices: DataFrame | None = None) -> DataFrame:
    """(id, part) of ``n`` and lines ``vertex part``; vertices that the file doesn't name get -1."""
    f = spark.read.text(path).select(_fields().alias("f")).where(F.size("f") == 2)
    m = f.select(F.col("f")[0].cast("long").alias("id"), F.col("f")[1].cast("int").alias("part"))
    return m if vertices is None else vertices.select("id").join(m, "id", "left").select("id", F.coalesce("part", F.lit(-1)).alias("part"))


def edge_list(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    """Arcs of the lines ``u v``; both ways unless directed."""
    f = spark.read.text(path).select(_fields().alias("f")).where(F.size("f") >= 2)
    one = f.select(F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"))
    return one.distinct() if directed else one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def scatter_files(df: DataFrame, path: str, parts: int, by: str = "id") -> None:
    """One folder a remainder of the key."""
    df.withColumn("part", F.pmod(by, F.lit(parts))).repartition(parts, "part").write.partitionBy("part").parquet(path)


def read_harwell_boeing(spark: SparkSession, path: str) -> DataFrame:
    """The symmetric graph of an assembled square pattern, ids from 1. The format is one fixed-width stream, so the driver
    reads it; it is meant for matrices that fit there."""
    import re

    from rowmesh.plans.graph import symmetrize

    with open(path) as f:
        lines = f.read().split("\n")
    _, pointer_cards, index_cards, _, rhs_cards = (int(lines[1][14 * i : 14 * (i + 1)].strip() or 0) for i in range(5))
    kind, shape = lines[2][:3].upper(), [int(x) for x in lines[2][3:].split()]
    if shape[0] != shape[1] or kind[2:3] != "A":
        raise ValueError("not an assembled square matrix")
    formats = re.findall(r"\((?:\d+)?I(\d+)", lines[3].upper())
    at = 5 if rhs_cards else 4

    def numbers(cards: list[str], width: int) -> list[int]:
        return [int(c[i : i + width]) for c in cards for i in range(0, len(c.rstrip()), width) if c[i : i + width].strip()]

    starts = numbers(lines[at : at + pointer_cards], int(formats[0]))
    rows = numbers(lines[at + pointer_cards : at + pointer_cards + index_cards], int(formats[1]))
    pairs = [(c + 1, r) for c, (a, b) in enumerate(zip(starts, starts[1:])) for r in rows[a - 1 : b - 1]]
    return symmetrize(spark.createDataFrame(pairs, "src long, dst long"))
