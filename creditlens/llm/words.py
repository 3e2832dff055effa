"""Words of UTF-8 text as 64-bit hashes, without a Python step per word.

A word is a run of bytes that a 256-entry table marks. Its hash is the sum modulo
2**64 of one pseudo-random value for each pair of byte and place in the word
(tabulation hashing), mixed with the length. The values of different places are not
related, so regular words collide no more than others: two different words agree
with a probability of about 2**-64. Words over ``LONG_WORD`` bytes are hashed by
BLAKE2 instead, so memory stays bounded.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG_WORD = 1 << 17
_CHUNK = 1 << 18
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) + _GOLD * np.arange(1, n + 1, dtype=np.uint64))


#: Words between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Places in a word whose values are kept in a table; further ones are made when needed.
_TABLED = 64
_BYTE, _PLACE = stream(11, 256), stream(13, LONG_WORD)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
with np.errstate(over="ignore"):
    _EXACT = mix(_PLACE[:_TABLED, None] + mix(_BYTE)[None, :])
_FOLDED = _EXACT[:, _FOLD]


def spans(data: np.ndarray, offsets: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row (plus the end) its first word."""
    inside = marked[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool) -> np.ndarray:
    """A hash for each word; ``folded`` takes A-Z as a-z."""
    table, out, i, n = _FOLDED if folded else _EXACT, np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        if ends[i] - starts[i] > LONG_WORD:
            word = data[starts[i] : ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(_lower(word) if folded else word, digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        long = np.flatnonzero(ends[i:j] - starts[i:j] > LONG_WORD)
        j = i + int(long[0]) if len(long) else j
        base, s, e = int(starts[i]), starts[i:j] - starts[i], ends[i:j] - starts[i]
        byte = data[base : int(ends[j - 1])]
        place = np.arange(len(byte), dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(s, append=len(byte)))
        value = table.take((np.minimum(place, _TABLED - 1) << 8) | byte)
        if len(far := np.flatnonzero(place >= _TABLED)):  # with what stands between words, which no sum takes
            value[far] = mix(_PLACE[np.minimum(place[far], LONG_WORD - 1)] + mix(_BYTE)[_FOLD[byte[far]] if folded else byte[far]])
        sums = np.zeros(len(byte) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        out[i:j] = mix(sums[e] - sums[s] + (e - s).astype(np.uint64) * _GOLD)
        i = j
    return out


def _lower(word: bytes) -> bytes:
    return word.translate(_FOLD.tobytes())


def chained(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash for each run of ``width`` neighbouring values."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    c = stream(seed, width) | np.uint64(1)
    n = len(values) - width + 1
    total = values[:n] * c[0]
    for k in range(1, width):
        total += values[k : k + n] * c[k]
    return mix(total)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[0] ... first[0] + size[0] - 1, first[1] ... and so on."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class TokenMemory:
    """Token ids of words that a worker has met, by the words' hashes, in flat arrays.

    The hashes stand in a table of ``2 ** slots`` places with linear probing, at most half
    full; when that, or ``most`` ids, is exceeded it starts afresh, so its size is bounded:
    12 bytes a place, 12 a word and 4 an id (48 MB with the defaults).
    """

    def __init__(self, slots: int = 20, most: int = 4 << 20):
        self.mask, self.most = (1 << slots) - 1, most
        self.forget()

    def forget(self) -> None:
        self.key, self.number = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        number = self.number[slot]
        left = np.flatnonzero((number >= 0) & (self.key[slot] != h))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            number[left] = self.number[slot[left]]
            left = left[(number[left] >= 0) & (self.key[slot[left]] != h[left])]
        return number

    def _add(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.number[slot[left]] < 0]
            self.key[slot[free]], self.number[slot[free]] = h[free], number[free]
            left = left[self.number[slot[left]] != number[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, and how many each word has; ``encode`` gives ids and
        sizes for a list of words that have not been met."""
        number = self._find(h)
        if len(miss := np.flatnonzero(number < 0)):
            unique, first = np.unique(h[miss], return_index=True)
            if 2 * (len(self.size) + len(unique)) > self.mask or len(self.flat) > self.most:
                self.forget()
                if 2 * len(unique) > self.mask:  # more new words than a table may hold: without memory
                    half = len(h) // 2
                    parts = [self.tokens(data, starts[a], ends[a], h[a], encode) for a in (slice(0, half), slice(half, None))]
                    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                return self.tokens(data, starts, ends, h, encode)
            at, raw = miss[first], data.tobytes()
            ids, size = encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self._add(unique, np.arange(len(self.size), len(self.size) + len(unique), dtype=np.int32))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size.astype(np.int32)]), np.concatenate([self.flat, np.asarray(ids, np.int32)])
            number = self._find(h)
        size = self.size[number].astype(np.int64)
        return self.flat[ragged(self.start[number], size)], size
