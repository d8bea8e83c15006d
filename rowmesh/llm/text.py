"""Word tables over batches of texts: the vectorised ground floor of the text operators.

A word is a maximal run of bytes outside space and 0x09-0x0D, as ``bytes.split()`` has it. Word hashes are 64-bit
multilinear hashes of the word's UTF-8 bytes, finished by a bijective mixer: a function of the word alone, alike on
every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text that are hashed at once; arrays of about forty times this size live at the same time.
CHUNK = 1 << 20
#: Words of more bytes are hashed by XXH64 instead.
LONG = 1 << 12

_COEFF = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty, lone surrogates become question marks."""
    return text.encode("utf-8", "replace") if text else b""


def mix(h: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser, a bijection of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash(buf: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one buffer."""
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    length = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    pos = np.arange(len(at)) - np.repeat(first, length)
    long = np.flatnonzero(length > LONG)
    if len(long):
        pos %= LONG
    h = mix(np.add.reduceat((buf[at].astype(np.uint64) + np.uint64(1)) * _COEFF[pos], first) + length.astype(np.uint64))
    for i in long:
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], 7)
    return h, starts


def _cuts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK bytes, cut between words."""
    i = 0
    while len(raw) - i > CHUNK:
        j = max(raw.rfind(c, i, i + CHUNK) for c in (b" ", b"\n"))
        if j <= i:
            j = min((k for k in (raw.find(c, i + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0), default=len(raw))
        yield raw[i:j]
        i = j
    yield raw[i:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one entry more than texts)."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)

    def flush(group: list[int]) -> None:
        raw = b" ".join([texts[k] for k in group])
        h, starts = _hash(np.frombuffer(raw, np.uint8), raw)
        ends = np.cumsum([len(texts[k]) + 1 for k in group])
        counts[group] = np.diff(np.searchsorted(starts, ends), prepend=0)
        parts.append(h)

    group, size = [], 0
    for k, raw in enumerate(texts):
        if len(raw) > CHUNK:
            if group:
                flush(group)
                group, size = [], 0
            for cut in _cuts(raw):
                h, _ = _hash(np.frombuffer(cut, np.uint8), cut)
                counts[k] += len(h)
                parts.append(h)
            continue
        if size + len(raw) > CHUNK:
            flush(group)
            group, size = [], 0
        group.append(k)
        size += len(raw) + 1
    if group:
        flush(group)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of n consecutive words, repeats included; fewer words make one shingle of all of
    them, none make none. Also where each text's shingles begin."""
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    if not at[-1]:
        return np.empty(0, np.uint64), at
    start = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    h = np.zeros(at[-1], np.uint64)
    width = np.minimum(np.repeat(size, count), n)
    for i in range(n):
        w = padded[start + i]
        if (size < n).any():
            w = np.where(i < width, w, np.uint64(0))
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(i + 1))
    return h, at


def blocks(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of consecutive items of at most so much together, or of one item."""
    i, total = 0, 0
    for j, s in enumerate(sizes):
        if j > i and total + s > most:
            yield slice(i, j)
            i, total = j, 0
        total += s
    if i < len(sizes):
        yield slice(i, len(sizes))
