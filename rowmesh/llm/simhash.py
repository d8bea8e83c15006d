"""SimHash near-duplicate detection by segment-popcount embedding.

A 64-bit fingerprint is cut into segments; the vector of the segments' bit counts is its embedding. The Manhattan distance
of two embeddings is a lower bound of the Hamming distance, so a link (3 differing bits or fewer) means a Manhattan
distance of at most 3, hence of at most 1 over one of the two halves. The grid has one cell for each half's exact vector
of counts; every fingerprint stands in its two home cells and looks into them and into the cells one step up in one
coordinate (of two fingerprints a step apart just one looks into the other's). That range join is an equi-join of cells:
only distinct fingerprints take part, so copies never meet. Whatever it finds is verified by the exact number of
differing bits.

Segments of two bits make about 7 million cells a half that random fingerprints fill evenly, segments of one bit 4 billion
for a third more probes: the width is chosen by the number of distinct fingerprints, so that cells stay nearly empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.llm.frame import cut, fold_pairs, hide_nulls, only, show_nulls, table
from rowmesh.llm.text import utf8

WORDS = 3
NEAR = 3
SEED = 42
#: Distinct fingerprints up to which segments have two bits; a fingerprint then meets a handful of others by chance.
FEW = 2_000_000
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_xxh64(raw: bytes, n: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of n space-joined words; fewer words: of all of them; none: nothing."""
    words = raw.split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = len(words) - n + 1
    return np.fromiter([h(joined[s:e], seed) for s, e in zip(starts[:k].tolist(), ends[n - 1 :].tolist())], np.uint64, k)


def fingerprints(texts: list[str | None], n: int = WORDS) -> np.ndarray:
    """SimHash of whole texts with A-Z lowered: a bit is 1 if it is set in over half the shingles' hashes. No words: 0."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        h = shingle_xxh64(utf8(text).translate(_UPPER), n)
        if len(h):
            ones = np.zeros(64, np.int64)
            for part in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = (weights * (2 * ones > len(h)).astype(np.uint64)).sum(dtype=np.uint64)
    return out


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also, fp): the fingerprint of every whole text as a signed long, with the columns also (no nulls in them).
    Null text: no words, fingerprint 0."""
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (key, *also))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in (key, *also)}, "fp": fingerprints(b[text].tolist()).view(np.int64)})

    return show_nulls(hide_nulls(only(docs, key, text, *also), key).mapInPandas(run, f"{kinds}fp long"), key)


def near_pairs(fps: DataFrame, width: int | None = None) -> DataFrame:
    """(u, v): every pair of distinct fingerprints of the column fp that differ in 3 bits or fewer, once or twice. width:
    bits of a segment, 1 or 2; by default as the number of fingerprints asks for. The pairs are the same for both."""
    width = width or (2 if fps.count() <= FEW else 1)
    half = F.expr("stack(2, 0, fp & 4294967295L, 1, shiftrightunsigned(fp, 32))").alias("half", "bits")
    count = "(bits & 1431655765L) + (shiftright(bits, 1) & 1431655765L)" if width == 2 else "bits"
    cells = fps.select("fp", half).select("fp", "half", F.expr(count).alias("cell"))
    steps = F.expr(f"filter(transform(sequence(0, {32 // width - 1}), i -> if((shiftright(cell, {width} * i) & {2**width - 1}L) < {width}L, cell + shiftleft(1L, {width} * i), -1L)), c -> c >= 0)")
    look = cells.select(F.col("fp").alias("v"), "half", F.col("cell").alias("home"), F.explode(F.concat(F.array("cell"), steps)).alias("cell"))
    met = cells.select(F.col("fp").alias("u"), "half", "cell").join(look, ["half", "cell"])
    return met.where((F.col("cell") != F.col("home")) | (F.col("u") < F.col("v"))).where(F.expr(f"u <> v and bit_count(u ^ v) <= {NEAR}")).select("u", "v")


def near_components(fps: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fp, root, component_id): for each distinct fp of (key, fp), a fingerprint that names its component and the least
    key reachable over links. Null keys rank last: a component of null keys alone has a null id."""
    groups = cut(fps.groupBy("fp").agg(F.min(key).alias("rep")))
    roots = fold_pairs(near_pairs(groups.select("fp")))
    named = groups.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(best, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits) and component_id, the least key reachable over links of 3
    differing bits or fewer.

    Null and blank texts have the fingerprint zero and link like any other. Repeated rows keep a row each. An empty
    table gives an empty result; further columns are ignored.
    """
    fps = cut(simhash(docs, key, text))
    return fps.join(near_components(fps, key), "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each component: the row of the least key stays (null keys rank last), of rows
    that share it the one of the least text, then of the least other columns. Components are told apart by their root, so
    rows of one key, or of null keys, that aren't linked all stay. The columns are those given; none may be a map.
    """
    rows = docs.withColumn("__digest", F.coalesce(F.md5(F.col(f"`{text}`")), F.lit("")))
    fps = cut(simhash(rows, key, text, ("__digest",)))
    first = fps.join(near_components(fps, key), "fp").where(F.col(key).eqNullSafe(F.col("component_id")))
    first = first.select(F.col(key).alias("__k"), F.col("__digest").alias("__d"), F.col("root").alias("__root")).distinct()
    held = rows.join(first, rows[key].eqNullSafe(first["__k"]) & (F.col("__digest") == F.col("__d")))
    order = [text, *[c for c in docs.columns if c != text]]
    least = held.groupBy("__root").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in order])).alias("__row"))
    return least.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts have the fingerprint zero; a component of null doc_ids alone has a null id."""
    return near_duplicates(table(spark, sf_dir, "documents"))
