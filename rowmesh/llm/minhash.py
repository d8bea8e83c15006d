"""Document fingerprints by one-permutation MinHash with optimal densification and b-bit storage.

The hashes of a text's shingles (five words; fewer words make one shingle) are binned once by their top bits; each bin
keeps its least hash. An empty bin copies the first full bin in its own fixed random order of all bins, the same order
for every text. Of each bin the low b bits are stored, packed, as hexadecimal digits. Two fingerprints that agree in a
share s of their bins have likeness (s - c) / (1 - c), c = 2**-b being the share that unlike bins agree in by chance.

Fingerprints of word-less texts are the empty string: likeness 1 to each other, 0 to any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.llm.frame import hide_nulls, only, show_nulls, table
from rowmesh.llm.text import blocks, shingle_hashes, utf8, word_hashes

WORDS = 5
BINS = 512
BITS = 4
#: Bytes of text that are fingerprinted at once, and what a text counts beside its own bytes: its bins take room too.
BLOCK, EACH = 1 << 20, 1 << 11
#: Bytes of text of a range of keys, about: what one task of the comparison with the next document reads.
RANGE = 1 << 25

_ORDER = np.argsort(np.random.Generator(np.random.PCG64(97)).random((BINS, BINS)), axis=1)
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)
#: Texts of at most so many full bins are densified by the ranks of these; the others bin by bin along the orders.
_FEW = 48


def densify(least: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fills the empty bins of texts x bins; texts without a full bin stay as they are."""
    out = least.copy()
    held = full.sum(axis=1)
    for k in np.unique(held[(held > 0) & (held <= _FEW)]):  # texts of equally many full bins at once
        texts = np.flatnonzero(held == k)
        own = np.nonzero(full[texts])[1].reshape(-1, k)
        for i in range(0, len(texts), max(1, 4096 // k)):
            part = own[i : i + max(1, 4096 // k)]
            donor = np.take_along_axis(part, _RANK[:, part].argmin(axis=2).T, axis=1)
            rows = texts[i : i + len(part), None]
            out[rows, np.arange(BINS)] = np.where(full[rows[:, 0]], least[rows[:, 0]], least[rows, donor])
    text, bin_ = np.nonzero(~full & (held > _FEW)[:, None])
    turn = 0
    while len(text):  # every order holds a full bin
        donor = _ORDER[bin_, turn]
        hit = full[text, donor]
        out[text[hit], bin_[hit]] = least[text[hit], donor[hit]]
        text, bin_, turn = text[~hit], bin_[~hit], turn + 1
    return out


def sketch(texts: list[bytes]) -> np.ndarray:
    """Texts x bins of b-bit values, as uint8; texts without words are all 255."""
    words, first = word_hashes(texts)
    h, at = shingle_hashes(words, first, WORDS)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    slot = owner * BINS + (h >> shift).astype(np.int64)
    least = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, h)
    full = np.zeros(len(texts) * BINS, bool)
    full[slot] = True
    dense = densify(least.reshape(-1, BINS), full.reshape(-1, BINS))
    values = (dense & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    values[np.diff(at) == 0] = 255
    return values


def pack(values: np.ndarray) -> list[str]:
    """Two four-bit values a byte, as hexadecimal digits; the empty string for texts without words."""
    bytes_ = (values[:, ::2] & 15) << 4 | values[:, 1::2] & 15
    return ["" if v[0] == 255 else b.tobytes().hex() for v, b in zip(values, bytes_)]


def unpack(fingerprints: list[str]) -> np.ndarray:
    out = np.full((len(fingerprints), BINS), 255, np.uint8)
    for i, f in enumerate(fingerprints):
        if f:
            b = np.frombuffer(bytes.fromhex(f), np.uint8)
            out[i, ::2], out[i, 1::2] = b >> 4, b & 15
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles, row by row, cleared of chance agreement and held within 0 to 1."""
    chance = 2.0**-BITS
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    none = (a[:, 0] == 255).astype(int) + (b[:, 0] == 255)
    return np.where(none == 2, 1.0, np.where(none == 1, 0.0, found))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every whole text. Null texts count as empty; repeated rows keep a row each."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [utf8(t) for t in b[text]]
            found: list[str] = []
            for part in blocks([len(r) + EACH for r in raw], BLOCK):
                found += pack(sketch(raw[part]))
            yield pd.DataFrame({key: b[key], "fingerprint": found})

    return show_nulls(hide_nulls(only(docs, key, text), key).mapInPandas(run, f"`{key}` {kind}, fingerprint string"), key)


def _place(key: str, text: str):  # noqa: ANN202
    """Rows' order: by key, null first as the least long, then by the text's hash."""
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _bounds(quantiles: list[int]) -> list[tuple[int, int]]:
    """Where parts begin, as (key, hash): a key that several quantiles fall on is cut by hash into as many parts."""
    out: list[tuple[int, int]] = []
    for k in sorted(set(quantiles)):
        times = quantiles.count(k)
        out += [(k, -(1 << 63) + (i << 64) // times) for i in range(times)]
    return out


def in_order(docs: DataFrame, key: str, text: str, ranges: int) -> DataFrame:
    """Rows (key, text, part, at, h, guest) such that each part, sorted by guest, at and h, holds a range of keys and then,
    as its guest, the first row of the next part (after the last: of the first). Parts are cut at approximate quantiles of
    the key, and inside a key that holds several of them by the text's hash.
    """
    at, h = _place(key, text)
    rows = only(docs, key, text).withColumns({"at": at, "h": h})
    cuts = rows.stat.approxQuantile("at", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    bounds = _bounds([max(-(1 << 63), min(int(c), (1 << 63) - 1)) for c in cuts])
    # Two steps, each over a short list of constants: the run of bounds, then the place in it.
    width = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    pair = lambda b: f"struct({_long(b[0])}, {_long(b[1])})"
    passed = lambda found: F.size(F.filter(found, lambda b: b <= F.struct(F.col("at").alias("col1"), F.col("h").alias("col2"))))
    if bounds:
        run = passed(F.expr(f"array({', '.join(pair(r[0]) for r in runs)})"))
        inner = F.expr(f"array({', '.join('array(' + ', '.join(map(pair, r)) + ')' for r in runs)})")
        part = F.when(run == 0, F.lit(0)).otherwise((run - 1) * width + passed(F.element_at(inner, run)))
    else:
        part = F.lit(0)
    rows = rows.withColumn("part", part)
    # The first row of each part: its place from a narrow pass, then its text.
    heads = rows.groupBy("part").agg(F.min(F.struct("at", "h")).alias("m")).select("part", "m.*").collect()
    if not heads:
        return rows.withColumn("guest", F.lit(False))
    order = sorted(r["part"] for r in heads)
    host = {p: order[i - 1] for i, p in enumerate(order)}
    small = docs.sparkSession.createDataFrame([(r["at"], r["h"], host[r["part"]]) for r in heads], "a bigint, b bigint, host int")
    first = rows.join(F.broadcast(small), (rows["at"] == small["a"]) & (rows["h"] == small["b"])).groupBy("host").agg(F.min(F.struct(F.coalesce(text, F.lit("")).alias("t"), F.col(key).alias("k"), "at", "h")).alias("r"))
    guests = first.select(F.col("r.k").alias(key), F.col("r.t").alias(text), "r.at", "r.h", F.col("host").alias("part"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests)


def _long(x: int) -> str:
    return f"cast('{x}' as bigint)"


def edited(text: str, after: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the other, or all of them."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document by ascending key.

    Null texts are empty; null keys come first; rows of one key follow each other by their texts' xxhash64. A lone document
    is its own next one; an empty table gives no rows; further columns are ignored. The table is cut into ranges of key and
    hash and each range is read in order, one batch at a time: memory is bounded by a batch and one text.
    """
    spark = docs.sparkSession
    held = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0
    ranges = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE))
    kind = docs.schema[key].dataType.simpleString()
    parts = in_order(docs, key, text, ranges)
    parts = parts.withColumn(text, F.coalesce(text, F.lit("")))
    parts = hide_nulls(parts, key).repartition(ranges, "part").sortWithinPartitions("part", "guest", "at", "h", text).select("part", "guest", key, text)

    def answer(rows: list[tuple], head: tuple) -> Iterator[pd.DataFrame]:
        """rows: (part, guest, key, text) whose next ones are the row after each, and head after the last. A block of guests
        alone has no frame: empty columns have no type, and Arrow turns them into chunks that Spark refuses."""
        live = [i for i, r in enumerate(rows) if not r[1]]
        if not live:
            return
        texts = [r[3] for r in rows] + [head[3]]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        raw = [utf8(t) for t in texts]
        raw_changed = [utf8(t) for t in changed]
        own, other = sketch(raw), sketch(raw_changed)
        own_hex, other_hex = pack(own[:-1]), pack(other)
        yield pd.DataFrame(
            {
                key: [rows[i][2] for i in live],
                "n_chars": [len(texts[i]) for i in live],
                "edited_sha256": [hashlib.sha256(raw_changed[i]).hexdigest() for i in live],
                "fingerprint": [own_hex[i] for i in live],
                "edited_fingerprint": [other_hex[i] for i in live],
                "near_edited": likeness(own[:-1], other)[live],
                "near_next": likeness(own[:-1], own[1:])[live],
            }
        ).astype({key: "object"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            keys = [None if pd.isna(k) else int(k) for k in b[key]]
            for row in zip(b["part"], b["guest"], keys, b[text]):
                if held and size >= BLOCK:
                    yield from answer(held, row)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + EACH
        if held:  # a part ends with its guest, which has no answer of its own
            yield from answer(held, held[-1])

    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return show_nulls(parts.mapInPandas(run, schema), key)


def op3_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty, null doc_ids come first and stay null; an empty table gives no rows."""
    return compare_with_next(table(spark, sf_dir, "documents"))
