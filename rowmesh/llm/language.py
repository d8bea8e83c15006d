"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary; each language has a probability for every piece. A word's probability is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words (runs of
letters, lower-cased, with the vocabulary's word mark in front). Piece probabilities are fitted by expectation
maximisation (forward-backward over the training words) and smoothed. Characters that no piece covers cost a constant.

Every language found is learned, and every piece that lower-case letters can match is used. The model is fitted on at most
SAMPLE documents a language, those of the least hash of key and text (rows that repeat both come along); there, runs of
more than LONGEST letters are fitted in parts. Scoring reads every whole text and sums all segmentations of every run,
whatever its length: a long run's forward vector is carried through it and brought back to scale on the way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmesh.llm.frame import hide_nulls, only, show_nulls, table
from rowmesh.llm.quality import held_out

#: Training documents a language, at most; rounds of expectation maximisation.
SAMPLE, ROUNDS = 400, 3
#: Letters of the longest runs that are scored many at a time; longer ones are scored one by one.
LONGEST = 24
SMOOTH = 0.1
#: Words that a worker remembers.
REMEMBERED = 200_000
UNKNOWN = "und"
MARK = "▁"
_WORDS = re.compile(r"[^\W\d_]+")
_UNCOVERED = 1e-7


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str | None = None) -> dict[str, int]:
    """The vocabulary's pieces of lower-case letters, with or without the word mark, numbered."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary())
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if p and (p == MARK or p.removeprefix(MARK).isalpha()) and p == p.lower():
            found.setdefault(p, len(found))
    return found


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORDS.findall((text or "").lower())


class Pieces:
    """Numbers of pieces by the hashes of their characters, looked up for whole arrays."""

    BASE, BITS = np.uint64(0x9E3779B97F4A7C15), 20

    def __init__(self, number: dict[str, int]) -> None:
        self.other, self.longest = len(number), max(map(len, number), default=1)
        self.keys = np.array([*(int(self.hash(p)) for p in number), 0], np.uint64)
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces of one hash")
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(self.other)
        while len(left):  # what shares a slot goes to the next table
            odd = np.uint64(0xD6E8FEB86659FD93 + 2 * 104729 * len(self.tables) ** 3)
            slot = self._slot(self.keys[left], odd)
            own, at = np.unique(slot, return_index=True)
            table_ = np.full(1 << self.BITS, self.other, np.int32)
            table_[own] = left[at]
            self.tables.append((odd, table_))
            left = np.delete(left, at)

    def hash(self, piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * self.BASE + np.uint64(ord(c) + 1)
        return h[0]

    def _slot(self, h: np.ndarray, odd: np.uint64) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * odd) >> np.uint64(64 - self.BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's piece, or -1."""
        out = np.full(h.shape, -1, np.int32)
        for odd, table_ in self.tables:
            i = table_[self._slot(h, odd)]
            np.copyto(out, i, where=self.keys[i] == h)
        return out


def lattice(batch: list[str], known: Pieces) -> np.ndarray:
    """Of strings of one length, [string, end, length - 1]: the piece that ends there, one past the last piece for an
    uncovered character, or -1."""
    size = len(batch[0])
    code = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(batch), size).astype(np.uint64) + np.uint64(1)
    out = np.full((len(batch), size + 1, known.longest), -1, np.int32)
    h = np.zeros_like(code)
    for n in range(1, min(size, known.longest) + 1):
        h = h[:, : size - n + 1] * known.BASE + code[:, n - 1 :]
        out[:, n:, n - 1] = known.find(h)
    single = out[:, 1:, 0]
    single[single < 0] = known.other
    return out


def _alike(batch: list[str], languages: int) -> Iterator[list[int]]:
    """Places of the strings, in groups of one length and bounded size."""
    size = np.array([len(w) for w in batch])
    most = max(16, min(4096, (1 << 20) // (LONGEST * max(1, languages))))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for k in range(0, len(at), most):
            yield at[k : k + most].tolist()


def forward(paths: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """[string, end, language]: summed probability of all segmentations of each prefix. prob: [piece, language], with two
    more rows, the cost of an uncovered character and, last, zero."""
    n, ends, longest = paths.shape
    a = np.zeros((n, ends, prob.shape[1]))
    a[:, 0] = 1
    for end in range(1, ends):
        for length in range(1, min(end, longest) + 1):
            piece = paths[:, end, length - 1]
            some = np.flatnonzero(piece >= 0)
            if len(some) == n:
                a[:, end] += a[:, end - length] * prob[piece]
            elif len(some):
                a[some, end] += a[some, end - length] * prob[piece[some]]
    return a


def run_score(run: str, known: Pieces, prob: np.ndarray, block: int = 4096) -> np.ndarray:
    """Log probability in each language of one string of any length: the last forward values are carried along, divided by
    their greatest whenever they get small."""
    keep = known.longest
    held = np.zeros((keep, prob.shape[1]))  # forward values of the last ends, the latest last
    held[-1] = 1
    scale = 0.0
    for begin in range(0, len(run), block):
        left = max(0, begin - keep)
        paths = lattice([run[left : begin + block]], known)[0][begin - left + 1 :]
        for row in paths:
            lengths = np.flatnonzero(row >= 0)
            new = (held[keep - 1 - lengths] * prob[row[lengths]]).sum(axis=0)
            held = np.concatenate([held[1:], new[None]])
            if new.max() < 1e-100:
                top = held.max()
                held, scale = held / top, scale + np.log(top)
    return np.log(held[-1] + 1e-300) + scale


def word_scores(batch: list[str], known: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(batch), prob.shape[1]))
    long = [i for i, w in enumerate(batch) if len(w) > LONGEST]
    for i in long:
        out[i] = run_score(MARK + batch[i], known, prob)
    short = [i for i, w in enumerate(batch) if len(w) <= LONGEST]
    for part in _alike([batch[i] for i in short], prob.shape[1]) if short else ():
        out[[short[i] for i in part]] = np.log(forward(lattice([MARK + batch[short[i]] for i in part], known), prob)[:, -1] + 1e-300)
    return out


def parts(word: str) -> list[str]:
    """What a word is fitted as: itself behind the mark, or parts of LONGEST letters, the mark before the first."""
    return [MARK + word[:LONGEST], *[word[i : i + LONGEST] for i in range(LONGEST, len(word), LONGEST)]]


def _rows(prob: np.ndarray) -> np.ndarray:
    """Adds the rows of uncovered characters and of no piece."""
    return np.concatenate([prob, np.full((1, prob.shape[1]), _UNCOVERED), np.zeros((1, prob.shape[1]))])


def expectation(batch: list[str], count: np.ndarray, known: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language over strings with counts [string, language], under prob."""
    used = np.zeros((known.other + 2) * prob.shape[1])
    column = np.arange(prob.shape[1])
    for part in _alike(batch, prob.shape[1]):
        paths = lattice([batch[i] for i in part], known)
        a = forward(paths, prob)
        b = np.zeros_like(a)
        b[:, -1] = count[part] / (a[:, -1] + 1e-300)
        for end in range(a.shape[1] - 1, 0, -1):
            for length in range(1, min(end, known.longest) + 1):
                piece = paths[:, end, length - 1]
                if (piece < 0).all():
                    continue
                through = b[:, end] * prob[piece]
                b[:, end - length] += through
                used += np.bincount(((piece % (known.other + 2))[:, None] * prob.shape[1] + column).ravel(), (a[:, end - length] * through).ravel(), len(used))
    return used.reshape(-1, prob.shape[1])[: known.other]


@dataclass
class Model:
    """Languages in order of their names, and log-ready piece probabilities [piece + 2, language]."""

    languages: list[str]
    prob: np.ndarray
    known: Pieces
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    rows: list[np.ndarray] = field(default_factory=list, repr=False)

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior probability; ``und`` and 0 without letters."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(self.cache) > REMEMBERED:
            self.cache.clear()
            self.rows = []
        counts = [Counter(words(t)) for t in texts]
        new = list({w for c in counts for w in c if w not in self.cache})
        if new:
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new))))
            self.rows = [np.concatenate([*self.rows, word_scores(new, self.known, self.prob)])]
        names, scores = [], []
        for c in counts:
            if not c:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = np.fromiter(c.values(), float, len(c)) @ self.rows[0][np.fromiter(map(self.cache.__getitem__, c), np.int64, len(c))]
            p = np.exp(total - total.max())
            best = int(p.argmax())
            names.append(self.languages[best])
            scores.append(float(p[best] / p.sum()))
        return names, scores


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", use: Column | None = None, path: str | None = None) -> Model:
    """Fits the model on documents with a language and a text. Each language gives at most SAMPLE documents: whole texts,
    of which just the counts of their parts reach the driver. No such rows: a model of no language, which predicts none."""
    rows = only(docs, key, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows if use is None else rows.where(use)
    named = rows.select(F.col(f"`{lang}`").alias("__lang"), F.col(f"`{text}`").alias("__text"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit("language")).alias("__h"))
    least = named.select("__lang", "__h").withColumn("k", F.row_number().over(Window.partitionBy("__lang").orderBy("__h"))).where(F.col("k") <= SAMPLE)
    bounds = least.groupBy("__lang").agg(F.max("__h").alias("most")).toPandas()
    languages = sorted(bounds["__lang"])
    known = Pieces(pieces(path))
    number = range(known.other)
    if not languages:
        return Model([], np.zeros((len(number) + 2, 0)), known)
    spark = docs.sparkSession
    limits = F.broadcast(spark.createDataFrame([(a, int(m)) for a, m in zip(bounds["__lang"], bounds["most"])], "lang string, most long"))
    chosen = named.join(limits, named["__lang"] == limits["lang"]).where(F.col("__h") <= F.col("most")).select("lang", F.col("__text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by: dict[str, Counter] = {}
            for name, t in zip(b["lang"], b["text"]):
                by.setdefault(name, Counter()).update(p for w in words(t) for p in parts(w))
            for name, c in by.items():
                yield pd.DataFrame({"lang": name, "word": list(c), "n": list(c.values())})

    seen = chosen.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    word, which = np.unique(seen["word"].to_numpy(str), return_inverse=True) if len(seen) else (np.empty(0, str), np.empty(0, int))
    table_ = np.zeros((len(word), len(languages)))
    table_[which, np.searchsorted(languages, seen["lang"].to_numpy(str))] = seen["n"].to_numpy()
    prob = np.full((len(number), len(languages)), 1.0 / len(number))
    # Only each word's count under its own language matters: rounds run over all languages at once.
    for _ in range(ROUNDS if len(word) else 0):
        used = expectation(word.tolist(), table_, known, _rows(prob)) + SMOOTH
        prob = used / used.sum(axis=0)
    return Model(languages, _rows(prob), known)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text; ``und`` and 0 where it is null or has no letter, or nothing was learned.
    Repeated rows keep a row each, null keys stay null, an empty table gives no rows; further columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                names, scores = shared.value.classify(part[text].tolist())
                yield pd.DataFrame({key: part[key].to_numpy(), "lang_pred": names, "score": scores})

    return show_nulls(hide_nulls(only(docs, key, text), key).mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double"), key)


def op9_unigram_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is never held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    return identify(docs, train(docs, use=~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
