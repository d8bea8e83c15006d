"""Substring dedup: words in windows that occur elsewhere, found with one FM-index per shard.

Sharding is by content. A window (35 words) belongs to the least hash of its 8-word grams, its anchor; a run of windows
of one anchor is a fragment. Equal windows have equal anchors, so all their occurrences meet in one shard, and every
window is in exactly one fragment. Three sieves and folds keep what is shuffled small, none of them loses an occurrence:
anchors that stand at one place only are left out (a bit table of bounded size, built from the counted anchors and sent
to the workers, keeps most of them from ever moving; what it lets through, which is all once it is full, is told by exact
counts before any text moves), equal fragments are folded into one with a count, and anchors with very many different
fragments are split again by minima of further hash functions.

A shard's distinct fragments make one text: its suffix array gives the Burrows-Wheeler transform, kept in a wavelet
matrix of packed bits with rank counts; beside it stand a byte of common prefix a suffix, two 16-bit distances to the
parent interval's ends and a bit for fragments with copies. The shard's fragments are streamed through that index from right to left, all in
step: backward search extends each match by a word as long as it has two occurrences, copies counted, and falls back to
the parent interval where it hasn't. Where the matching statistic reaches the window's length, the window is reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.llm.frame import cut, hide_nulls, only, show_nulls, table, written
from rowmesh.llm.text import blocks, mix, utf8, word_hashes

WINDOW = 35
GRAM = 8
#: Most windows of a fragment.
RUN = 64
#: Words of a shard, about.
SHARD = 400_000
#: Different fragments of an anchor beyond which it is split again.
HOT = 4096
#: Most bits of the sieve; bits for each anchor up to there; bits set for each.
SIEVE_BITS, BITS_EACH, PROBES = 1 << 28, 12, 4
BLOCK = 1 << 20
_NONE = -(1 << 63)


# --- fragments -------------------------------------------------------------------------------------------------------


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the words i to i + gram - 1 for each i; the last ones run over the end and are never used."""
    padded = np.concatenate([words, np.zeros(gram, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    for i in range(gram):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + padded[i : i + len(words)])
    return h


def least_of(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value among h[i : i + width] for each i, and its leftmost place."""
    value, place, span = h.copy(), np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        if step >= len(h):
            break
        less = value[step:] < value[:-step]
        value[:-step][less] = value[step:][less]
        place[:-step][less] = place[step:][less]
        span += step
    return value, place


def fragments(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, text, start, windows, places) of each fragment; start counts words of the text, places the places at
    which the anchor stands as a window's first least gram."""
    size = np.diff(first)
    value, place = least_of(gram_hashes(words, gram), window - gram + 1)
    ok = np.arange(len(words)) + window <= np.repeat(first[1:], size)
    at = np.flatnonzero(ok)
    if not len(at):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, none
    v, p = value[at], place[at]
    new = np.ones(len(at), bool)
    new[1:] = (v[1:] != v[:-1]) | (np.diff(at) != 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    if (length > RUN).any():
        more = (np.arange(len(at)) - np.repeat(begin, length)) % RUN == 0
        begin = np.flatnonzero(new | more)
        length = np.diff(np.append(begin, len(at)))
    moved = np.ones(len(at), np.int64)
    moved[1:] = p[1:] != p[:-1]
    moved[begin] = 1
    doc = np.searchsorted(first, at[begin], "right") - 1
    return v[begin], doc, at[begin] - first[doc], length, np.add.reduceat(moved, begin)


def span_hashes(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each run of words, by the prefix sums of a polynomial."""
    base = 0x9E3779B97F4A7C15
    n = len(words) + 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:-1], dtype=np.uint64)])
    return mix((total[start + length] - total[start]) * down[start] + length.astype(np.uint64))


def _sieve_places(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(anchor ^ np.uint64(0xA5A5 + 77 * i)) & np.uint64(bits - 1)) for i in range(PROBES)]


# --- the index -------------------------------------------------------------------------------------------------------


def suffix_ranks(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks of the prefixes of 1, 2, 4 ... symbols."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    ranks, k = [rank], 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1 or 2 * k >= n:
            return order, ranks
        ranks.append(rank)
        k *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order, from the ranks of prefixes; one more for the end."""
    n = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = np.append(ranks[level], -1)
        same = (a < n) & (b < n) & (r[np.minimum(a, n)] == r[np.minimum(b, n)])
        out[same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return np.concatenate([[0], out, [0]])


def smaller_around(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller values before and after each value; the ends count as smaller. Values are few: the
    places of those below each are taken at once."""
    n = len(h)
    before, after = np.zeros(n, np.int64), np.full(n, n - 1, np.int64)
    for v in np.unique(h)[1:]:
        at, less = np.flatnonzero(h == v), np.flatnonzero(h < v)
        k = np.searchsorted(less, at)
        before[at] = less[np.maximum(k - 1, 0)]
        after[at] = less[np.minimum(k, len(less) - 1)]
    return before, after


class Distances:
    """Whole numbers from 0, of which most fit 16 bits; the others stand apart, by place."""

    def __init__(self, values: np.ndarray) -> None:
        self.far = np.flatnonzero(values >= 0xFFFF).astype(np.int32)
        self.wide = values[self.far].astype(np.int32)
        self.near = np.minimum(values, 0xFFFF).astype(np.uint16)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.near[at].astype(np.int64)
        over = np.flatnonzero(out == 0xFFFF)
        if len(over):
            out[over] = self.wide[np.searchsorted(self.far, at[over])]
        return out


class Bits:
    """Packed bits with a 32-bit count of the ones before each 64-bit block."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.packbits(bit.astype(np.uint8), bitorder="little")
        self.packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view("<u8")
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed))[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[i >> 6] + np.bitwise_count(self.packed[i >> 6] & mask)


class FMIndex:
    """Backward search over fragments of words, with occurrences weighted by the fragments' copies, one or more.

    Symbols: 0 ends each fragment (the ends are ordered by fragment), words follow. Levels of the wavelet matrix are packed
    bits with counts, about one and a half bits a symbol and level; the rest of the index takes five bytes and a half a
    symbol. The symbols themselves are kept for the fragments' own way through the index.
    """

    def __init__(self, frags: list[np.ndarray], weights: np.ndarray) -> None:
        lengths = np.array([len(f) for f in frags])
        words = np.concatenate(frags)
        self.vocabulary, symbol = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        n, k = int(ends[-1]) + 1, len(frags)
        text = np.zeros(n, np.int32)
        inside = np.ones(n, bool)
        inside[ends] = False
        self.n, self.starts, self.lengths = n, ends - lengths, lengths
        text[inside] = symbol + 1
        full = text.astype(np.int64) + k
        full[ends] = np.arange(k)
        order, ranks = suffix_ranks(full)
        del full
        lcp = common_prefixes(order, ranks)
        del ranks
        before, after = smaller_around(lcp)
        place = np.arange(n + 1)
        self.before, self.after = Distances(place - before), Distances(after - place)
        del before, after
        self.lcp = lcp.astype(np.uint8 if lcp.max(initial=0) < 256 else np.int32)
        self.copied = Bits(np.repeat(weights > 1, lengths + 1)[order])
        bwt = text[order - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.first = np.searchsorted(np.sort(text), np.arange(len(self.vocabulary) + 2)).astype(np.int32)
        self.text = text
        self._wavelet(bwt)

    def _wavelet(self, s: np.ndarray) -> None:
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int((bit == 0).sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        every = np.arange(len(self.vocabulary) + 1)
        self.base = self._descend(every, np.zeros(len(every), np.int64)).astype(np.int32)

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.ones(i)
            i = np.where((c >> (self.levels - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of c followed by what the intervals stand for."""
        both = self._descend(np.concatenate([c, c]), np.concatenate([lo, hi])) - np.tile(self.base[c] - self.first[c], 2)
        return both[: len(c)], both[len(c) :]

    def matches(self) -> list[np.ndarray]:
        """For each word of each fragment: the length of the longest match from there, within the fragment, that occurs
        twice in the index."""
        k = len(self.lengths)
        lo, hi, size = np.zeros(k, np.int64), np.full(k, self.n, np.int64), np.zeros(k, np.int64)
        at, stop = self.starts + self.lengths - 1, self.starts
        out = np.zeros(self.n, np.int32)
        while len(at):  # every fragment takes a step of its own: a word further, or one parent up
            a, b = self.extend(self.text[at], lo, hi)
            good = (b - a >= 2) | ((b - a == 1) & (self.copied.ones(b) > self.copied.ones(a)))
            low, high = self.lcp[lo].astype(np.int64), self.lcp[hi].astype(np.int64)
            depth = np.maximum(low, high)
            root = depth == 0
            up_lo = np.where(root, 0, np.where(low == depth, lo - self.before[lo], lo))
            up_hi = np.where(root, self.n, np.where(high == depth, hi + self.after[hi], hi))
            done = good | (size == 0)  # at the root nothing is left to shorten
            lo, hi = np.where(good, a, up_lo), np.where(good, b, up_hi)
            size = np.where(good, size + 1, np.where(done, 0, depth))
            out[at[done]] = size[done]
            at = at - done
            live = at >= stop
            if not live.all():
                at, stop, lo, hi, size = at[live], stop[live], lo[live], hi[live], size[live]
        return [out[s : s + n] for s, n in zip(self.starts, self.lengths)]


def repeated_windows(frags: list[np.ndarray], weights: np.ndarray, window: int) -> list[list[int]]:
    """For each fragment: runs of its windows that occur twice, as first, end, first, end ..."""
    out = []
    for m in FMIndex(frags, weights).matches():
        edge = np.flatnonzero(np.diff(m >= window, prepend=False, append=False))
        out.append(edge.tolist())
    return out


# --- on tables -------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, t, text): a document's place is its key and its text's hash; repeated rows share both."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NONE)).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(d, t, spans): per place with any, the spans of words, as structs lo, hi (end excluded), that windows occurring
    elsewhere cover. d is the key (the least long for null), t xxhash64 of the text."""
    spark = docs.sparkSession
    keyed = _keyed(only(docs, key, text), key, text)

    def each(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
        raw = [utf8(x) for x in batch["text"]]
        for part in blocks([len(r) for r in raw], BLOCK):
            words, first = word_hashes(raw[part])
            yield batch.iloc[part], fragments(words, first, window, gram), words, first

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, (anchor, _, _, _, count), _, _ in each(batch):
                value, inverse = np.unique(anchor, return_inverse=True)
                yield pd.DataFrame({"anchor": value.view(np.int64), "n": np.minimum(np.bincount(inverse, count, len(value)), 2).astype(np.int32)})

    often = cut(keyed.select("text").mapInPandas(places, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    bits = 1 << min(SIEVE_BITS.bit_length() - 1, max(16, (often.count() * BITS_EACH).bit_length()))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.concatenate(_sieve_places(batch["anchor"].to_numpy(np.int64).view(np.uint64), bits))
            block, inverse = np.unique(p >> np.uint64(6), return_inverse=True)
            word = np.zeros(len(block), np.uint64)
            np.bitwise_or.at(word, inverse, np.uint64(1) << (p & np.uint64(63)))
            yield pd.DataFrame({"block": block.astype(np.int32), "word": word.view(np.int64)})

    sieve = np.zeros(bits >> 6, np.uint64)
    set_bits = often.mapInPandas(probe, "block int, word long").groupBy("block").agg(F.bit_or("word").alias("word")).toArrow()
    sieve[set_bits["block"].to_numpy()] = set_bits["word"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(sieve)

    occurrence = "anchor long, frag long, d long, t long, pos int, windows int, many boolean"

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = shared.value
        for batch in batches:
            for rows, (anchor, doc, pos, n, count), words, first in each(batch):
                if not len(anchor):
                    continue
                ok = np.ones(len(anchor), bool)
                for p in _sieve_places(anchor, bits):
                    ok &= (table_[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                anchor, doc, pos, n, many = anchor[ok], doc[ok], pos[ok], n[ok], count[ok] > 1
                frag = span_hashes(words, first[doc] + pos, n + window - 1)
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "frag": frag.view(np.int64), "d": rows["d"].to_numpy()[doc], "t": rows["t"].to_numpy()[doc], "pos": pos, "windows": n, "many": many})

    found = written(keyed.mapInPandas(occurrences, occurrence), "occurrences")
    kinds = written(found.groupBy("anchor", "frag").agg(F.count("*").alias("copies"), F.max("many").alias("many"), F.min(F.struct("d", "t", "pos", "windows")).alias("at")).select("anchor", "frag", "copies", "many", "at.*"), "fragments")
    # What the sieve let through is told here: an anchor that stands at one place has no repeated window.
    met = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all"), F.max("many").alias("many"), F.sum(F.col("windows") + (window - 1)).alias("words"))
    met = cut(met.withColumn("lone", (F.col("all") == 1) & ~F.col("many")).where("lone or kinds > %d" % HOT).select("anchor", "lone", "kinds", "words"))
    total = kinds.agg(F.sum(F.col("windows") + (window - 1))).first()[0] or 0
    shards = max(1, -(-(total - (met.where("lone").agg(F.sum("words")).first()[0] or 0)) // SHARD))
    kinds = kinds.join(met.where("lone").select("anchor"), "anchor", "left_anti")
    hot = met.where("not lone").select("anchor", "kinds")
    wanted = kinds.join(hot, "anchor", "left").groupBy("d", "t").agg(F.collect_list(F.struct("anchor", "frag", F.least("copies", F.lit(2)).cast("int").alias("copies"), "pos", "windows", F.coalesce("kinds", F.lit(0)).alias("kinds"))).alias("wanted"))

    piece = "shard int, anchor long, frag long, off int, copies int, words binary"

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked, raw in zip(batch["wanted"], batch["text"]):
                words = utf8(raw).split()
                rows = []
                home = _shard(np.array([w["anchor"] for w in asked], np.int64).view(np.uint64), shards).tolist()
                for w, shard in zip(asked, home):
                    span = words[w["pos"] : w["pos"] + w["windows"] + window - 1]
                    if not w["kinds"]:
                        rows.append((shard, w["anchor"], w["frag"], 0, w["copies"], b" ".join(span)))
                        continue
                    for part, off, n in _split(span, w["anchor"], w["kinds"], window, gram, shards):
                        rows.append((part, w["anchor"], w["frag"], off, w["copies"], b" ".join(span[off : off + n + window - 1])))
                yield pd.DataFrame(rows, columns=_columns(piece))

    pieces = keyed.join(wanted, ["d", "t"]).mapInPandas(fetch, piece)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["anchor", "frag", "off"])  # repeated rows fetch a fragment more than once
        words, first = word_hashes(group["words"].tolist())
        frags = [words[a:b] for a, b in zip(first, first[1:])]
        runs = repeated_windows(frags, group["copies"].to_numpy(np.int64), window)
        rows = [(a, f, o + lo, o + hi) for a, f, o, run in zip(group["anchor"], group["frag"], group["off"], runs) for lo, hi in zip(run[::2], run[1::2])]
        return pd.DataFrame(rows, columns=["anchor", "frag", "lo", "hi"])

    runs = pieces.groupBy("shard").applyInPandas(search, "anchor long, frag long, lo int, hi int").groupBy("anchor", "frag").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    spans = F.transform("runs", lambda r: F.struct((F.col("pos") + r["lo"]).alias("lo"), (F.col("pos") + r["hi"] + (window - 1)).alias("hi")))
    return found.join(runs, ["anchor", "frag"]).select("d", "t", spans.alias("spans")).groupBy("d", "t").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key) % np.uint64(shards)).astype(np.int64)


def _split(span: list[bytes], anchor: int, kinds: int, window: int, gram: int, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first window, windows) of the parts of a fragment whose anchor has too many kinds: each run of windows that
    agree in the minima of some more hash functions, more of them the more kinds there are."""
    n = len(span) - window + 1
    words, _ = word_hashes([b" ".join(span)])
    h = gram_hashes(words, gram)[: len(span) - gram + 1]
    key = np.full(n, np.int64(anchor).view(np.uint64), np.uint64)
    for i in range((kinds // HOT).bit_length() + 2):
        key = mix(key + least_of(mix(h ^ np.uint64(0x51ED + 9973 * i)), window - gram + 1)[0][:n])
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(begin[1:], n)
    return [(int(s), int(b), int(e - b)) for s, b, e in zip(_shard(key[begin], shards), begin, ends)]


def keep_words(words: list[bytes], spans: list | np.ndarray | None) -> list[bytes]:
    """The words outside the spans."""
    if spans is None or not len(spans):
        return words
    keep = np.ones(len(words) + 1, np.int64)
    change = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        change[s["lo"]] += 1
        change[s["hi"]] -= 1
    keep = np.cumsum(change) == 0
    return [w for w, k in zip(words, keep) if k]


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256 and kept, the words that no repeated window covers, joined by
    one space.

    Words are runs outside space and 0x09-0x0D, unchanged; null and blank texts have none; texts shorter than a window
    lose nothing. A row that repeats another one counts as an occurrence elsewhere. An empty table gives no rows;
    further columns are ignored.
    """
    spans = repeated_spans(docs, key, text, window).withColumnsRenamed({"d": "__d", "t": "__t"})
    rows = only(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    joined = rows.join(spans, (F.coalesce(F.col(key).cast("long"), F.lit(_NONE)) == F.col("__d")) & (F.xxhash64(text) == F.col("__t")), "left").select(key, text, "spans")
    joined = hide_nulls(joined, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw, s in zip(b[text], b["spans"]):
                words = utf8(raw).split()
                kept = keep_words(words, s)
                joined_ = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined_).hexdigest(), joined_.decode("utf-8", "replace")))
            yield pd.concat([b[[key]].reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])], axis=1)

    return show_nulls(joined.mapInPandas(run, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string, kept string"), key)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """The documents with the words that repeated windows cover taken out of their texts, and ``size``, if they have such a
    column, set to the new text's code points. Texts that lose nothing, null ones too, stay as they are; a row that repeats
    another counts as an occurrence elsewhere, so both lose their windows. An empty table gives no rows; further columns are
    kept."""
    spans = repeated_spans(docs, key, text, window).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("spans").alias("__spans"))
    joined = docs.join(spans, (F.coalesce(F.col(key).cast("long"), F.lit(_NONE)) == F.col("__d")) & (F.xxhash64(text) == F.col("__t")), "left")

    @F.pandas_udf("string")
    def cut_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, all_spans in batches:
            yield pd.Series([b" ".join(keep_words(utf8(t).split(), s)).decode("utf-8", "replace") if s is not None and len(s) else t for t, s in zip(texts, all_spans)], dtype="object")

    changed = F.col("__spans").isNotNull()
    out = joined.withColumn("__cut", cut_text(F.col(text), F.col("__spans"))).withColumn(text, F.col("__cut"))
    if size in docs.columns:
        out = out.withColumn(size, F.when(changed, F.char_length(text).cast(docs.schema[size].dataType)).otherwise(F.col(size)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null doc_ids stay null and null texts have no words."""
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")
