"""Vectorised hashing of words and shingles (numpy, inside tasks).

All hashes are 64 bits. A substring's hash comes from a prefix polynomial over
the bytes, so word, prefix and shingle hashes cost a few array operations per
text instead of one Python object per word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: ASCII white space: \x20 and \x09 to \x0D
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: bytes that letters are made of: ASCII letters and all of non-ASCII UTF-8
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True

_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, at least n of each."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inv = pow(_P, -1, 1 << 64)
        out = []
        for base in (_P, inv):
            a = np.ones(1, U)
            step = base
            while len(a) < size:
                a = np.concatenate((a, a * U(step)))
                step = step * step & _MASK
            out.append(a)
        _powers, _inverse = out
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all 64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """The words of one text (bytes): where they are and their hashes."""

    def __init__(self, raw: bytes, letters: bool = False):
        b = np.frombuffer(raw, np.uint8)
        inside = _LETTER[b] if letters else ~_SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        power, self._inv = _tables(len(b) + 1)
        self._sum = np.concatenate((np.zeros(1, U), np.cumsum((b.astype(U) + U(1)) * power[:len(b)], dtype=U)))

    def __len__(self) -> int:
        return len(self.start)

    def substring(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inv[start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.substring(self.start, self.end)


def lower_words(text: str | None) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    return Words(text.encode("utf-8", "surrogatepass").lower()).hashes() if text else np.zeros(0, U)


def chain(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    k = len(words) - n + 1
    h = np.zeros(max(k, 0), U)
    for j in range(n if k > 0 else 0):
        h = mix(h * U(0xD6E8FEB86659FD93) + words[j:j + k])
    return h


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer than n words the whole sequence is one shingle."""
    w = lower_words(text)
    if not len(w):
        return w
    return np.unique(chain(w, n) if len(w) >= n else mix(chain(w, len(w)) + U(len(w))))


def text_groups(texts, limit: int = 1 << 20):
    """Consecutive texts of an Arrow array as (first row, list of str or None), about ``limit`` characters each."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        t = t.as_py()
        held.append(t)
        size += len(t) if t else 0
        if size >= limit:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def group_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts, one after another, and each text's number of words: as ``lower_words``, at once."""
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    joined = b"\n".join(raw)
    if not joined:
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    w = Words(joined)
    ends = np.cumsum([len(r) + 1 for r in raw])  # a text's words start before its end
    upto = np.searchsorted(w.start, ends)
    return w.hashes(), np.diff(np.concatenate(([0], upto)))


def group_shingles(texts: list, n: int = 5) -> list[np.ndarray]:
    """``shingle_set`` of many texts at once."""
    w, count = group_words(texts)
    first = np.concatenate(([0], np.cumsum(count)))
    runs = chain(w, n)
    out = []
    for k, c in enumerate(count.tolist()):
        a = int(first[k])
        if c >= n:
            h = np.sort(runs[a:a + c - n + 1])
            if len(h) > 1:
                new = h[1:] != h[:-1]
                if not new.all():
                    h = h[np.concatenate(([True], new))]
        else:
            h = mix(chain(w[a:a + c], c) + U(c)) if c else w[:0]
        out.append(h)
    return out
