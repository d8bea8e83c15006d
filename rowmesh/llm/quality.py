"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: lower-cased words, and one to three consecutive word shapes (runs of one kind
of character drawn together, with a mark where a word repeats the one before). Indicators are scaled by the classes'
log-count ratios, vectors brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A
fifth of the training rows is left out of that and turns margins into probabilities (Platt scaling).

It is fitted on at most SAMPLE labelled rows, those of the least hash; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.llm.frame import only, table
from rowmesh.llm.text import blocks, mix, shingle_hashes, utf8, word_hashes

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
DIM = 1 << 18
COST, EPOCHS, SMOOTH = 1.0, 12, 1.0
BLOCK = 1 << 19

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_KIND = bytes(88 if 65 <= i < 91 else 120 if 97 <= i < 123 or i >= 128 else 48 if 48 <= i < 58 else i for i in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _shape(raw: bytes) -> bytes:
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    keep = _BLANK[kind]
    keep[:1] = True
    keep[1:] |= kind[1:] != kind[:-1]
    return kind[keep].tobytes()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, one after the other, and where each text's begin. Every text has at least
    one feature: that of its number of words' magnitude."""
    words, first = word_hashes([t.translate(_LOWER) for t in texts])
    shapes, _ = word_hashes([_shape(t) for t in texts])
    again = np.zeros(len(words), np.uint64)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][np.diff(first) > 0]] = 0
    shapes = mix(shapes + again)
    size = np.diff(first)
    owner = np.arange(len(texts))
    docs = [np.repeat(owner, size), owner]
    hashes = [mix(words + np.uint64(11)), mix(np.uint64(7) + np.array([int(s).bit_length() for s in size], np.uint64))]
    for n in (1, 2, 3):
        h, at = shingle_hashes(shapes, first, n)
        docs.append(np.repeat(owner, np.diff(at)))
        hashes.append(mix(h + np.uint64(100 + n)))
    key = np.unique(np.concatenate(docs).astype(np.int64) * DIM + (np.concatenate(hashes) & np.uint64(DIM - 1)).astype(np.int64))
    at = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) * DIM)
    return key % DIM, at


@dataclass
class Model:
    """Weights of the scaled indicators, the squares of their scales, the bias, and the slope and offset of Platt scaling."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.add.reduceat(self.square[feature], at[:-1], dtype=np.float64)) + 1e-12
        return np.add.reduceat(self.weight[feature], at[:-1], dtype=np.float64) / norm + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = [np.empty(0)]
        for part in blocks([len(t) for t in texts], BLOCK):
            out.append(1 / (1 + np.exp(-np.clip(self.slope * self.margins(*features(texts[part])) + self.offset, -40, 40))))
        return np.concatenate(out)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Linear L1-loss support vectors by dual coordinate descent; the bias is a constant feature."""
    w, bias, alpha = np.zeros(dim), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins, by damped Newton steps on Platt's smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - target))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """A model of feature lists and labels 0 or 1. Without both labels, each at least five times, every text scores the
    share of ones (one half of no rows)."""
    y = np.where(label == 1, 1.0, -1.0)
    if min((y > 0).sum(), (y < 0).sum()) < 5:
        share = (np.count_nonzero(label == 1) + 1) / (len(label) + 2)
        return Model(np.zeros(DIM, np.float32), np.zeros(DIM, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    fitted = np.arange(len(rows)) % 5 != 0
    both = [np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(fitted & (y == s))]), minlength=DIM) + SMOOTH for s in (1, -1)]
    ratio = np.log(both[0] / both[0].sum()) - np.log(both[1] / both[1].sum())
    values = [ratio[r] / (np.sqrt((ratio[r] ** 2).sum()) + 1e-12) for r in rows]
    train = np.flatnonzero(fitted)
    w, bias = descend([rows[i] for i in train], [values[i] for i in train], y[train], DIM)
    model = Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)
    rest = np.flatnonzero(~fitted)
    margin = np.array([w[rows[i]] @ values[i] + bias for i in rest])
    model.slope, model.offset = platt(margin, y[rest])
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", use: Column | None = None) -> Model:
    """Fits the model on the rows of labels (key, label in 0, 1) that ``use`` keeps and docs has. At most SAMPLE label
    rows are taken, so the side sent to every executor is bounded; texts of other documents never leave their scan. Null keys
    and labels but 0 and 1 are left out, of a key's labels the least counts, of its texts one. Empty tables: every text
    scores one half."""
    rows = only(labels, key, label).where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    rows = rows if use is None else rows.where(use)
    rows = rows.groupBy(key).agg(F.min(label).alias("__y")).orderBy(F.xxhash64(key), key).limit(SAMPLE).withColumnRenamed(key, "__k")
    picked = only(docs, key, text).join(F.broadcast(rows), F.col(key) == F.col("__k")).select("__k", "__y", text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [utf8(t) for t in b[text]]
            found = []
            for part in blocks([len(r) for r in raw], BLOCK):
                feature, at = features(raw[part])
                found += [feature[i:j].astype("<i4").tobytes() for i, j in zip(at, at[1:])]
            yield pd.DataFrame({"k": b["__k"], "y": b["__y"], "f": found})

    made = picked.mapInPandas(run, f"k {docs.schema[key].dataType.simpleString()}, y int, f binary")
    # One row a key, however many rows of docs share it: what reaches the driver stays within SAMPLE.
    got = made.groupBy("k").agg(F.min("y").alias("y"), F.min("f").alias("f")).toPandas().sort_values("k", ignore_index=True)
    return fit([np.frombuffer(f, "<i4").astype(np.int64) for f in got["f"]], got["y"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The documents with a column ``into``: the probability of label 1. Null texts count as empty; repeated rows
    score alike and keep a row each; further columns are kept, one named like ``into`` is replaced."""
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(shared.value.scores([utf8(t) for t in b]), dtype="float64")

    return docs.withColumn(into, of(F.col(f"`{text}`")))


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key's text leaves the remainder ``part``; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that a model of their own labels doesn't reject (score 0.5 or more), with the columns given.
    Null and empty texts are scored like any other; an empty table gives no rows."""
    model = train(docs, labels, key, text)
    return score(docs, model, text, "__score").where("__score >= 0.5").drop("__score")


def op8_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once per row, empty and null texts too; labels of held-out documents are never seen."""
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    model = train(docs, table(spark, sf_dir, "labels"), use=~out)
    scored = score(only(docs, "doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
