"""Exact top-k inner-product search by the threshold algorithm.

Vectors are quantised to integers and dealt into blocks of bounded size. Within a block of candidates every dimension has
a list of the rows sorted by that component. A query reads lists from the end that its sign favours, scores in full what
it meets for the first time, and stops once no unread row can beat its k-th best score (to equal it is not enough: a tie
may have a smaller id). The bound on unread rows is the greatest inner product of a vector that lies below the current
depth of every list and, seen from the block's centre, is no longer than its longest row; without the length it would be
the classic sum over the depths. Which list is read next is decided by how much a stretch of it would lower that bound for each row read, so
lists of small query components may stay unread. Where the bound falls too slowly to end before half of the rows are met,
the rest is scored at once: an isolated query in many dense dimensions has no shorter exact search.

Blocks' answers are merged by a window over each query's k rows a block. Rows are known by number throughout; keys, null
or large, are joined back at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmesh.llm.frame import cut, only, table

K = 20
SCALE = 64
EVERY = 20
#: Most components of a block of candidates, and rows of a block of queries.
CANDIDATES = 1 << 23
QUERIES = 1 << 12
#: List entries of the shortest reading of a dimension, and the shares of a free component at which readings may pause.
STRETCH, LEVELS = 64, np.array([0.9, 0.75, 0.6, 0.5, 0.4, 0.25, 0.0])
#: Room for rounding in bounds, which are doubles.
SLACK = 1e-9


def quantise(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, v): floor(scale * x) as longs; rows whose vector is null, empty or holds a null or non-finite component are
    left out."""
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return only(vectors, key, vector).where(F.coalesce(good, F.lit(False))).select(F.col(key), v.alias("v"))


def greatest_product(w: np.ndarray, edge: np.ndarray, norm: float) -> tuple[float, float]:
    """The maximum of w.x over x <= edge and |x| <= norm, for w > 0, and the factor t at which it lies: x = min(edge, t w).
    t is infinite where the norm doesn't bind."""
    ratio = edge / w
    order = np.argsort(ratio)
    e2 = np.concatenate([[0.0], np.cumsum(edge[order] ** 2)])
    w2 = np.append(np.cumsum((w[order] ** 2)[::-1])[::-1], 0.0)
    if e2[-1] <= norm * norm and ratio[order[-1]] >= 0:
        return float(w @ edge), np.inf
    t = np.sqrt(np.maximum(norm * norm - e2[:-1], 0.0) / w2[:-1])
    held = np.flatnonzero(t <= ratio[order])  # the first so many caps that leave the rest below theirs
    t_ = float(t[held[0]]) if len(held) else np.inf
    return float(w @ np.minimum(edge, t_ * w)) if np.isfinite(t_) else float(w @ edge), t_


class Block:
    """Candidates (numbers of rows, ranks of their keys, integer vectors) with one sorted list a dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        self.rows, self.ids, self.v = rows, ids, v
        self.top = float(np.abs(v).max(initial=0))
        kind = np.float32 if self.top < 1 << 24 else np.float64
        self.lists = np.empty(v.shape[::-1], np.int32)
        self.sorted = np.empty(v.shape[::-1], kind)
        for d in range(v.shape[1]):
            self.lists[d] = np.argsort(v[:, d], kind="stable")
            self.sorted[d] = v[self.lists[d], d]
        # One more list: rows by their distance from the centre, the longest first.
        self.centre = v.mean(axis=0, dtype=np.float64) if len(v) else np.zeros(v.shape[1])
        length = np.sqrt(((v - self.centre) ** 2).sum(axis=1)) * (1 + SLACK)
        self.long = np.argsort(-length, kind="stable")
        self.lengths = np.append(length[self.long], 0.0)
        self.kinds: dict[type, np.ndarray] = {}

    def _as(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The query and the candidates in the narrowest type in which all sums are exact."""
        most = float(np.abs(q).max(initial=0)) * self.top * len(q)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        if kind not in self.kinds:
            self.kinds[kind] = self.v.astype(kind)
        return q.astype(kind), self.kinds[kind]

    def _stops(self, dims: np.ndarray, up: np.ndarray, w: np.ndarray, t: float) -> np.ndarray:
        """Depths at which reading a list may pause: doubling ones, and those at which its values fall to shares of t w."""
        n = len(self.ids)
        out = np.tile(STRETCH << np.arange(max(1, (n // STRETCH).bit_length())), (len(dims), 1))
        if np.isfinite(t):
            level = np.outer(t * w, LEVELS) + (np.where(up, 1, -1) * self.centre[dims])[:, None]
            at = [n - np.searchsorted(self.sorted[d], x, "left") if high else np.searchsorted(self.sorted[d], -x, "right") for d, high, x in zip(dims, up, level)]
            out = np.concatenate([out, np.array(at) + 1], axis=1)
        return np.minimum(out, n // 2 + 1)

    def search(self, row: int, q: np.ndarray, k: int) -> tuple[np.ndarray, list[int], int]:
        """(positions, scores, rows scored) of the best k rows other than the query's own, ties to smaller ids."""
        n, dims = len(self.ids), np.flatnonzero(q)
        qd, v = self._as(q)
        seen = self.rows == row
        at, scores = np.empty(0, np.int64), np.empty(0, v.dtype)
        scored = 0

        def take(new: np.ndarray) -> None:
            nonlocal at, scores, scored
            seen[new] = True
            scored += len(new)
            s = v[new] @ qd if 2 * len(new) < n else (v @ qd)[new]
            if len(scores) >= k:
                good = s >= scores.min()
                new, s = new[good], s[good]
            at, scores = np.concatenate([at, new]), np.concatenate([scores, s])
            if len(scores) > k:  # all that reach the k-th score stay: a tie may have a smaller id
                kth = np.partition(scores, len(scores) - k)[len(scores) - k] if v.dtype != object else sorted(scores)[-k]
                stay = scores >= kth
                at, scores = at[stay], scores[stay]

        if len(dims) and n > STRETCH:
            w, up, side = np.abs(q[dims]).astype(np.float64), q[dims] > 0, self.centre[dims] * np.where(q[dims] > 0, 1, -1)
            base = float(w @ side)

            def value(place: np.ndarray) -> np.ndarray:
                """What stands at these depths of each list, seen from the centre and by the query's sign."""
                p = np.minimum(place, n - 1)
                d = dims[(slice(None),) + (None,) * (p.ndim - 1)]
                high = up[(slice(None),) + (None,) * (p.ndim - 1)]
                raw = self.sorted[d, np.where(high, n - 1 - p, p)].astype(np.float64)
                return np.where(high, raw, -raw) - side[(slice(None),) + (None,) * (p.ndim - 1)]

            depth = np.zeros(len(dims), np.int64)
            edge = value(depth)
            far, size = 0, float(np.sqrt(w @ w))
            bound, t = greatest_product(w, edge, self.lengths[0])
            stops = self._stops(dims, up, w, t)
            then = value(stops)
            while True:
                now = np.minimum(edge, t * w) if np.isfinite(t) else edge
                fall = np.maximum(now[:, None] - then, 0) * (w[:, None] - ((now[:, None] + then) / (2 * t) if np.isfinite(t) else 0.0))
                rate = np.where(stops > depth[:, None], fall / np.maximum(stops - depth[:, None], 1), 0.0)
                i, j = divmod(int(rate.argmax()), rate.shape[1])
                best = float(rate[i, j])
                ahead = min(n, max(STRETCH, 2 * far))
                shorter = (self.lengths[far] - self.lengths[ahead]) * size / (ahead - far) if np.isfinite(t) and ahead > far else 0.0
                kth = float(scores.min()) - base if len(scores) >= k else -np.inf
                if max(best, shorter) <= 0 or scored > n // 2 or (depth.any() and np.isfinite(kth) and bound - kth > max(best, shorter) * (n // 2)):
                    break  # at this rate half of the rows would be met
                if shorter > best and depth.any():
                    entries, far = self.long[far:ahead], ahead
                else:
                    a, b, d = int(depth[i]), int(stops[i, j]), int(dims[i])
                    entries = self.lists[d, n - b : n - a] if up[i] else self.lists[d, a:b]
                    depth[i] = b
                    edge = value(depth)
                take(entries[~seen[entries]])
                bound, t = greatest_product(w, edge, float(self.lengths[far]))
                if len(scores) >= k and bound + SLACK * (1 + abs(bound) + abs(base)) < float(scores.min()) - base:
                    return *self._best(at, scores, k), scored
        take(np.flatnonzero(~seen))
        return *self._best(at, scores, k), scored

    def _best(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        order = sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]]))[:k]
        return at[order], [int(scores[i]) for i in order]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, <key>, score): the k rows of greatest integer inner product with each row that ``queries``, a
    condition on the key, picks; never the query's own row.

    Rows without a finite vector take no part. Vectors of unequal length: missing components count as zero. Ties go to
    smaller keys, null keys being the smallest; rows that repeat a key are rows of their own, and among equal keys ties go
    to any. A null key is a candidate like any other and a query where the condition holds for null. Components must fit
    64 bits once scaled. An empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    base = cut(quantise(vectors, key, vector, scale).withColumn("row", F.monotonically_increasing_id()))
    n, asked, width = base.agg(F.count("*"), F.count(F.when(queries, 1)), F.max(F.size("v"))).first()
    cb = max(1, -(-n * (width or 1) // CANDIDATES))
    # As many blocks of queries as keep all cores busy, more where queries are many.
    qb = max(1, -(-asked // QUERIES), min(-(-asked // 64), -(-2 * spark.sparkContext.defaultParallelism // cb)))
    place = F.col("row") + F.spark_partition_id()
    order = F.struct(F.col(key).isNotNull().alias("some"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"))
    asks = base.where(queries).select(F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("c"), F.pmod(place, F.lit(qb)).cast("int").alias("q"), "row", "v")
    holds = base.select(F.pmod(place, F.lit(cb)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"), order["some"].alias("some"), order["id"].alias("id"), "row", "v")

    def run(a: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(h):
            rank = np.lexsort((h["row"].to_numpy(), h["id"].to_numpy(), h["some"].to_numpy())).argsort()
            block = Block(h["row"].to_numpy(np.int64), rank, _matrix(h["v"], width))
            for row, q in zip(a["row"].tolist(), _matrix(a["v"], width)):
                at, scores, _ = block.search(row, q, k)
                found += [(row, int(block.rows[i]), s) for i, s in zip(at, scores)]
        return pd.DataFrame(found, columns=["qrow", "row", "score"])

    near = cut(asks.groupBy("c", "q").cogroup(holds.groupBy("c", "q")).applyInPandas(run, "qrow long, row long, score long"))
    named = near.join(base.select("row", key), "row").join(base.select(F.col("row").alias("qrow"), F.col(key).alias("query_id")), "qrow")
    by = Window.partitionBy("qrow").orderBy(F.col("score").desc(), F.col(key).asc_nulls_first(), "row")
    return named.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def shares_scored(vectors: np.ndarray, queries: np.ndarray, k: int = K) -> np.ndarray:
    """For each query, a number of a row, the share of the other rows that its search scores in one block of them all."""
    block = Block(np.arange(len(vectors)), np.arange(len(vectors)), vectors)
    return np.array([block.search(int(r), vectors[r], k)[2] for r in queries]) / max(1, len(vectors) - 1)


def op10_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null vec_ids are candidates and never queries."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % EVERY == 0)
