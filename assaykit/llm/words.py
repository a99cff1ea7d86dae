"""Words of texts as 64-bit numbers, and rolling sums over runs of words.

Words are ``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` yields for UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words a worker remembers before it starts afresh.
REMEMBERED = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class WordNumbers(dict):
    """word -> XXH64 of its bytes; forgets everything when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads sums over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(numbers: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit number for every run of ``width`` consecutive words."""
    n = len(numbers) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * BASE + numbers[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low, at, span = values.copy(), np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        keep = low[:-step] <= low[step:]
        at = np.where(keep, at[:-step], at[step:])
        low = np.where(keep, low[:-step], low[step:])
        span += step
    return at[:n]


# A number for each byte value (white space: zero) and odd powers for places inside a word.
_random = np.random.Generator(np.random.PCG64(20))
BYTE_NUMBERS = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_NUMBERS[SPACE] = 0
#: Places of a word have random numbers of their own; beyond these many, a number for each further
#: stretch of places multiplies them, so no two places of a word are treated alike.
PLACES = 4096
PLACE_NUMBERS = _random.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Layout:
    """The words of some texts without making a Python object of each.

    ``raw`` holds the texts one after the other; word k is ``raw[begin[k]:end[k]]``, has the
    64-bit ``number[k]`` and belongs to text ``doc[k]``; text d has the words ``starts[d]`` up to
    ``starts[d + 1]``.
    """

    def __init__(self, texts: list[str | bytes | None]):
        parts = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.raw = b"\n".join([*parts, b""])
        data = np.frombuffer(self.raw, np.uint8)
        inside = ~SPACE[data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.begin, self.end = edges[::2], edges[1::2]
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.starts = np.searchsorted(self.begin, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        if len(self.begin):
            spans = np.diff(self.begin, append=len(data))
            first = int(self.begin[0])
            place = np.arange(first, len(data)) - np.repeat(self.begin, spans)
            with np.errstate(over="ignore"):
                terms = BYTE_NUMBERS[data[first:]] * PLACE_NUMBERS[place & (PLACES - 1)]
                if int((self.end - self.begin).max()) > PLACES:
                    far = np.flatnonzero(place >= PLACES)
                    terms[far] *= mix((place[far] // PLACES).astype(np.uint64) * BASE) | np.uint64(1)
                self.number = mix(np.add.reduceat(terms, self.begin - first) + (self.end - self.begin).astype(np.uint64))
        else:
            self.number = np.empty(0, np.uint64)

    def exact(self) -> np.ndarray:
        """A number for each word that is equal if, and only if, the words are: words with one
        hash are compared byte by byte with the first of them."""
        _, first, rank = np.unique(self.number, return_index=True, return_inverse=True)
        if not len(first):
            return rank
        data, size = np.frombuffer(self.raw, np.uint8), self.end - self.begin
        like = first[rank]
        alike = size == size[like]
        at = np.flatnonzero(alike & (like != np.arange(len(like))))
        if len(at):
            span = size[at]
            stops = np.cumsum(span)
            inner = np.arange(stops[-1]) - np.repeat(stops - span, span)
            same = data[np.repeat(self.begin[at], span) + inner] == data[np.repeat(self.begin[like[at]], span) + inner]
            alike[at] = np.logical_and.reduceat(same, stops - span)
        if not alike.all():
            known: dict[bytes, int] = {}
            return np.array([known.setdefault(self.raw[a:b], len(known)) for a, b in zip(self.begin.tolist(), self.end.tolist())], np.int64)
        return rank

    def joined(self, doc: int) -> bytes:
        """A text's words, joined by one space."""
        a, b = self.starts[doc], self.starts[doc + 1]
        return b" ".join(self.raw[self.begin[a] : self.end[b - 1]].split()) if b > a else b""
