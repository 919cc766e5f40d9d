"""Word shingles as 64-bit hashes, computed with whole-array operations."""

from __future__ import annotations

import numpy as np
import xxhash

from wayfloor.llm.common import process_cache

SHINGLE = 5

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: A-Z in lower case, digits, a-z and bytes of non-ASCII characters kept, all else a space.
TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20) for b in range(256))

_ODD, _MUL = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_CHUNK = 1 << 17
#: Bytes of texts handled together, and what parts them: more than a blank line.
_TOGETHER, _GAP = 1 << 22, b"\n\n\n"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, by position in a chunk, and a random value for every byte."""
    cache = process_cache()
    if "shingle_powers" not in cache:
        n = 2 * _CHUNK
        up = np.full(n, _ODD, np.uint64)
        down = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        cache["shingle_powers"] = np.multiply.accumulate(up), np.multiply.accumulate(down), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
    return cache["shingle_powers"]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of every normalised word of UTF-8 bytes, in order.  It depends on the word's bytes alone."""
    return words_of(data)[1]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begin and end in bytes, hash) of every normalised word of UTF-8 bytes, in order."""
    data = data.translate(TABLE)
    if len(data) <= _CHUNK:
        return _hashes(data)
    spans, hashes, at = [], [], 0
    while at < len(data):
        end = data.find(b" ", at + _CHUNK)
        end = len(data) if end < 0 else end
        found = _hashes(data[at:end])
        spans.append(found[0] + at)
        hashes.append(found[1])
        at = end
    return np.concatenate(spans), np.concatenate(hashes)


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = a != 32
    spans = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    start, end = spans[:, 0], spans[:, 1]
    up, down, value = _powers()
    if len(a) > len(up):  # a single word of more than a chunk
        return spans, np.array([xxhash.xxh3_64_intdigest(w) for w in data.split()], np.uint64)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(value[a] * up[: len(a)], out=total[1:])
    return spans, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of every run of ``size`` words, in order; fewer words, but not none, are one shingle."""
    n = len(words)
    if n == 0:
        return words
    size_here = min(size, n)
    out = np.full(n - size_here + 1, size_here, np.uint64)
    for k in range(size_here):
        out = out * np.uint64(_MUL) + words[k : n - size_here + 1 + k]
    return mix(out)


class Texts:
    """The words of several texts in a row, so that one pass of whole-array operations serves all of them."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        #: First byte of every text in ``data``; what parts two texts is wider than a blank line.
        self.start = np.cumsum(size + len(_GAP)) - size - len(_GAP)
        self.data = _GAP.join(texts)
        self.spans, self.words = words_of(self.data)
        n = len(self.words)
        self.doc = np.searchsorted(self.start, self.spans[:, 0], side="right") - 1
        #: Number of the first word of every text.
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.shingles = shingle_hashes(self.words) if n >= SHINGLE else np.zeros(0, np.uint64)

    def within(self, words: int) -> np.ndarray:
        """Whether so many words from each on are of one text."""
        return self.doc[words - 1 :] == self.doc[: len(self.doc) - words + 1] if len(self.doc) >= words else np.zeros(0, bool)


def in_parts(texts: list[bytes | None]):
    """``(rows, Texts)`` of the texts that are not empty, in parts of about ``_TOGETHER`` bytes."""
    rows, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if rows and size + len(t) > _TOGETHER:
            yield np.array(rows), Texts([texts[j] for j in rows])
            rows, size = [], 0
        rows.append(i)
        size += len(t)
    if rows:
        yield np.array(rows), Texts([texts[j] for j in rows])


def weighted_shingles(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingles, weights) of every text; the weight is the binary length of the number of places.

    Text without a word but not blank is one shingle of its own.
    """
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(texts)
    for rows, t in in_parts(texts):
        ends = np.append(t.first[1:], len(t.words))
        for i, a, b in zip(rows.tolist(), t.first.tolist(), ends.tolist()):
            if b - a >= SHINGLE:
                found = t.shingles[a : b - SHINGLE + 1]
            elif b > a:
                found = shingle_hashes(t.words[a:b])
            else:
                bare = texts[i].strip()
                found = np.array([xxhash.xxh3_64_intdigest(bare, seed=1)] if bare else [], np.uint64)
            elements, count = np.unique(found, return_counts=True)
            out[i] = elements, np.frexp(count)[1].astype(np.int64)
    return out


def expanded(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A sorted set with an element for every unit of weight, whose Jaccard similarities are the weighted ones."""
    if not len(elements) or weights.max() == 1:
        return elements
    levels = [mix(elements[weights > k] + np.uint64(k * _ODD % (1 << 64))) for k in range(1, int(weights.max()))]
    return np.unique(np.concatenate((elements, *levels)))


def set_node(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=2)
    return value - (1 << 64) if value >= 1 << 63 else value
