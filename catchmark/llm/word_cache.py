"""Words of many texts as 62-bit hashes, and a bounded cache of token ids by word, with numpy over whole batches.

A text's words are found in its UTF-8 bytes. A word's hash is a polynomial in its bytes modulo two primes, taken from running sums,
so no object is made for a word. (Modulo a power of two, Thue-Morse words and their complements would collide whatever the base.)
``WordIds`` compares the bytes of all words that share a hash, so ids never depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: (prime, base) of each lane.
LANES = ((2**31 - 1, 1_370_589_719), (2**31 - 19, 911_382_323))
#: Sums of so many bytes times a power stay below 2^64.
PLAIN_BYTES = 1 << 24
ASCII_SPACE, BLANK = b" \t\n\x0b\x0c\r", b" "


@lru_cache(maxsize=1)
def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """base^i and its inverse for i below ``size``, for each lane."""
    out = []
    for prime, base in LANES:
        pair = []
        for b in (base, pow(base, -1, prime)):
            p = np.ones(size, np.uint32)
            done = 1
            while done < size:
                take = min(done, size - done)
                p[done : done + take] = p[:take].astype(np.uint64) * np.uint64(pow(b, done, prime)) % np.uint64(prime)
                done += take
            pair.append(p)
        out.append(tuple(pair))
    return out


@lru_cache(maxsize=4)
def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of a list of texts (bytes): places in the joined bytes, hashes, and number of words of each text."""

    def __init__(self, texts: list[bytes], spaces: bytes = ASCII_SPACE, lower: bool = False, clip: bytes = b""):
        """``clip``: such a byte is a word of its own where an ASCII letter stands before it and a space after it."""
        joined = b" ".join(texts) + b" "
        data = np.frombuffer(joined, np.uint8)
        if lower:
            data = LOWER[data]
        blank = _members(spaces)[data]
        full = ~blank
        opens, closes = full.copy(), blank.copy()
        opens[1:] &= blank[:-1]
        closes[1:] &= full[:-1]
        closes[0] = False
        if clip:
            at = np.flatnonzero(_members(clip)[data[1:-1]] & blank[2:]) + 1
            before = data[at - 1] | 32
            at = at[(before >= 97) & (before <= 122)]
            opens[at] = closes[at] = True
        self.data, self.starts, self.ends = data, np.flatnonzero(opens), np.flatnonzero(closes)
        self.hashes = np.zeros(len(self.starts), np.uint64)
        for (prime, _), (power, inverse) in zip(LANES, _powers(1 << max(20, int(len(data)).bit_length()))):
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            terms = power[: len(data)].astype(np.uint64)
            terms *= data + np.uint16(1)
            if len(data) > PLAIN_BYTES:
                terms %= np.uint64(prime)
            np.cumsum(terms, out=sums[1:])
            own = (sums[self.ends] - sums[self.starts]) % np.uint64(prime) * inverse[self.starts] % np.uint64(prime)
            self.hashes = self.hashes << np.uint64(31) | own
        edges = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.counts = np.diff(np.searchsorted(self.starts, edges))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def same(self, mine: np.ndarray, other: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bool:
        """Whether each word of ``mine`` (numbers) is the bytes of ``other`` from ``begin``, ``size`` of them."""
        sizes = self.ends[mine] - self.starts[mine]
        if not np.array_equal(sizes, size):
            return False
        for a, b in _runs(sizes):
            n = sizes[a:b]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if not np.array_equal(self.data[np.repeat(self.starts[mine[a:b]], n) + within], other[np.repeat(begin[a:b], n) + within]):
                return False
        return True


def _runs(sizes: np.ndarray, total: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Consecutive slices (start, stop) of words with about ``total`` bytes; a longer word is alone or last."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + total)) + 1
        yield a, min(b, len(sizes))
        a = b


class WordIds:
    """Token ids by word. Up to ``room`` words, of ``room_bytes`` together, are kept; when they are more, all are forgotten. Words are found by
    hash and compared by bytes; texts in which two words share a hash, with each other or with a kept one, are encoded word by word.

    ``encode(words)`` gives all ids of a list of words, how many each word has, and whether each is right (or None).
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray | None]], room: int = 1_000_000, room_bytes: int = 1 << 25):
        self.encode, self.room, self.room_bytes = encode, room, room_bytes
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.bad, self.flat, self.used = np.empty(0, bool), np.empty(1 << 16, np.int32), 0
        self.text_begin, self.text_size, self.text, self.text_used = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(1 << 16, np.uint8), 0

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text, number of words of each text that aren't right)"""
        unique, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        lengths = words.ends[first] - words.starts[first]
        if not words.same(np.arange(len(back)), words.data, words.starts[first][back], lengths[back]):
            return self._one_by_one(words)
        if len(self.keys) > self.room or self.text_used > self.room_bytes:
            self._forget()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        if not words.same(first[known], self.text, self.text_begin[at[known]], self.text_size[at[known]]):
            return self._one_by_one(words)
        if not known.all():
            new = np.flatnonzero(~known)
            said = [words.word(i) for i in first[new].tolist()]
            ids, sizes, right = self.encode(said)
            self.flat, begins, self.used = _added(self.flat, self.used, np.asarray(ids, np.int32), sizes)
            self.text, places, self.text_used = _added(self.text, self.text_used, np.frombuffer(b"".join(said), np.uint8), lengths[new])
            self.keys, self.begin, self.size = np.insert(self.keys, at[new], unique[new]), np.insert(self.begin, at[new], begins), np.insert(self.size, at[new], sizes)
            self.text_begin, self.text_size = np.insert(self.text_begin, at[new], places), np.insert(self.text_size, at[new], lengths[new])
            self.bad = np.insert(self.bad, at[new], np.zeros(len(new), bool) if right is None else ~right)
            at = np.searchsorted(self.keys, unique)
        sizes = self.size[at][back].astype(np.int64)
        ends = np.cumsum(sizes)
        place = np.repeat(self.begin[at][back] - (ends - sizes), sizes)
        place += np.arange(len(place))
        return self.flat[place], *_by_text(words, sizes, self.bad[at][back])

    def _one_by_one(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes, right = self.encode([words.word(i) for i in range(len(words.starts))])
        return np.asarray(ids, np.int32), *_by_text(words, np.asarray(sizes, np.int64), np.zeros(len(sizes), bool) if right is None else ~right)


def _added(flat: np.ndarray, used: int, new: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``flat`` with ``new`` from ``used`` on, where each of its parts of ``sizes`` begins, and the end."""
    while used + len(new) > len(flat):
        flat = np.concatenate([flat, np.empty_like(flat)])
    flat[used : used + len(new)] = new
    return flat, used + np.cumsum(sizes) - sizes, used + len(new)


def _by_text(words: Words, sizes: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and words that aren't right, of each text."""
    bounds = np.concatenate([[0], np.cumsum(words.counts)])
    return tuple(np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (sizes, bad))


def pieces_of(rows: list, chars: int = 800_000):
    """Consecutive slices (start, stop) of a list of texts, of about ``chars`` characters each; long texts stay whole."""
    start = size = 0
    for i, x in enumerate(rows):
        size += len(x)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(rows):
        yield start, len(rows)
