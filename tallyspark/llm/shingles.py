"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words in a shingle; bytes that are hashed at once (longer texts go in parts, cut at white space).
WORDS, CHUNK = 5, 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _rng.integers(1, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse mod 2 ** 64, for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, x in (("up", _BASE), ("down", _BACK)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data, and the place where each begins. No word reaches over a start of a document."""
    word = ~_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = False
    before[1:-1] = word[:-1]
    cut = starts_of_docs[starts_of_docs < len(data)]
    before[cut] = False
    begin = np.flatnonzero(word & ~before[:-1])
    after = np.append(word[1:], False)
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin]), begin


def join_words(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    m = len(words) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = out * _STEP + words[i : i + m]
    return mix(out)


def long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, in parts that end at white space."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            while not len(gaps) and end < len(data):  # one word longer than a part
                end = min(len(data), end + CHUNK)
                gaps = np.flatnonzero(_SPACE[data[at:end]])
            if end < len(data):
                end = at + int(gaps[-1]) + 1
        found.append(word_hashes(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The set of each text, sorted and distinct: its runs of n words; with fewer words all of them as one; without, none."""
    texts = texts.cast(pa.large_string()) if not isinstance(texts, pa.LargeStringArray) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) > CHUNK:
            words, ends = long_text(part), None
            edges = np.array([0, len(words)])
        else:
            words, begin = word_hashes(part, cuts[:-1])
            edges = np.searchsorted(begin, cuts)
        runs = join_words(words, n) if len(words) >= n else np.empty(0, np.uint64)
        for k in range(j - i):
            a, b = int(edges[k]), int(edges[k + 1])
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            elif b > a:
                yield join_words(words[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)
        i = j
