"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``width``
consecutive words of an item; an item of fewer words (but not none) is one window. The windows'
numbers go to every executor as a bit table and a sorted array, beside the items' words as one
string; each document is scanned once, and every hit is verified byte by byte before it counts.

The broadcast is bounded in bytes: items are cut into segments of ``SEGMENT_WORDS`` words (which
overlap by a window less a word, so no window is lost), equal segments count once, and blocks of
segments of about ``max_bytes`` bytes travel at a time, some six times that as arrays. The documents
pass through one scan after the other, carrying their marks along, so the result is the same.

Defined cases: null or empty text has no words and is never contaminated; documents and items of any
length are read whole; an empty benchmark hits nothing; a null item id counts as the empty text;
items with equal ids count once; repeated document rows each give a row; an empty table of documents
gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_rows, share, shared_value, written
from .words import WordNumbers, rolling

WIDTH = 10
MAX_BYTES = 8_000_000
SEGMENT_WORDS = 50_000
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
CARRIED = "doc_id long, text string, marks binary, items array<string>"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class Segments:
    """Items cut into segments that hold all their windows, words joined by one space."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, item_id, text):
        rows = []
        for own, t in zip(item_id, text):
            words = normal_words(t)
            for at in range(0, max(1, len(words) - self.width + 1) if words else 0, SEGMENT_WORDS):
                rows.append((own or "", b" ".join(words[at : at + SEGMENT_WORDS + self.width - 1]).decode("utf-8", "surrogatepass")))
        return {"item_id": [r[0] for r in rows], "text": [r[1] for r in rows]}


class Windows:
    """The windows of a block of segments, by length: arrays and one string."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        words, owner, self.ids = [], [], []
        for k, (item_id, text) in enumerate(sorted(items, key=lambda x: (x[0], x[1] or ""))):
            own = normal_words(text)
            self.ids.append(item_id)
            words += own
            owner.append(len(own))
        self.raw = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.owner = np.repeat(np.arange(len(owner)), owner).astype(np.int32)
        counts = np.array(owner, np.int64)[self.owner] if len(words) else np.empty(0, np.int64)
        numbers = WordNumbers().of(words)
        self.by_length: dict[int, tuple] = {}
        for size in sorted({min(width, n) for n in owner if n}):
            runs = rolling(numbers, size)
            n = len(runs)
            fits = (self.owner[:n] == self.owner[size - 1 : size - 1 + n]) & (np.minimum(counts[:n], width) == size)
            at = np.flatnonzero(fits)
            at = at[np.argsort(runs[at], kind="stable")]
            known = runs[at]
            bits = max(16, int(np.ceil(np.log2(len(known) * 32))))
            table = np.zeros(1 << bits, bool)
            table[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_length[size] = (bits, np.packbits(table), known, at)
        self.known: dict[tuple[int, int], dict[bytes, set]] = {}

    def named(self, size: int, number: int) -> dict[bytes, set]:
        """The windows of a number, as bytes, with the items that have each."""
        found = self.known.get((size, number))
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            _, _, known, places = self.by_length[size]
            found = {}
            low, high = (int(np.searchsorted(known, np.uint64(number), side)) for side in ("left", "right"))
            for at in places[low:high].tolist():
                found.setdefault(self.raw[self.begin[at] : self.begin[at + size] - 1], set()).add(self.ids[self.owner[at]])
            self.known[size, number] = found
        return found

    def scan(self, words: list[list[bytes]], numbers: WordNumbers):
        """For each document: a bool array of hit words, and the ids of the items that occur."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = numbers.of([w for doc in words for w in doc])
        doc_of = np.repeat(np.arange(len(words)), lengths)
        edges = np.zeros(len(flat) + 1, np.int64)
        items: list[set] = [set() for _ in words]
        for size, (bits, packed, _, _) in self.by_length.items():
            runs = rolling(flat, size)
            slot = runs >> np.uint64(64 - bits)
            hits = (packed[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1
            for at in np.flatnonzero(hits).tolist():
                doc = int(doc_of[at])
                if doc_of[at + size - 1] != doc:
                    continue
                found = self.named(size, int(runs[at]))
                if found:
                    local = at - int(starts[doc])
                    ids = found.get(b" ".join(words[doc][local : local + size]))
                    if ids:
                        items[doc] |= ids
                        edges[at] += 1
                        edges[at + size] -= 1
        hit = np.cumsum(edges)[: len(flat)] > 0
        return [hit[starts[k] : starts[k + 1]] for k in range(len(words))], items


class Scan:
    """One pass over documents; ``last`` passes give the result, others carry the marks on."""

    def __init__(self, shared, last: bool):
        self.shared, self.last = shared, last

    def start(self):
        windows, numbers = shared_value(self.shared), WordNumbers()

        def work(doc_id, text, marks=None, items=None):
            words = [normal_words(t) for t in text]
            hits, found = windows.scan(words, numbers)
            if marks is not None:
                hits = [h | np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)).astype(bool) for h, m in zip(hits, marks)]
                found = [f | set(i) for f, i in zip(found, items)]
            if not self.last:
                return {"doc_id": doc_id, "text": text, "marks": [np.packbits(h).tobytes() for h in hits], "items": [sorted(f) for f in found]}
            n_hit = [int(h.sum()) for h in hits]
            return {
                "doc_id": doc_id,
                "n_words": [len(w) for w in words],
                "n_hit": n_hit,
                "n_items": [len(f) for f in found],
                "items_sha256": [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found],
                "contaminated": [n > 0 for n in n_hit],
            }

        return work


def blocks_of(benchmark: DataFrame, width: int, max_bytes: int) -> Iterator[tuple[Windows, bool]]:
    """Windows of one block of segments after the other, and whether it is the last."""
    rows = columns(benchmark, item_id="string", text="string").distinct()
    segments = written(map_rows(rows, Segments(width), "item_id string, text string").distinct())
    size = segments.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // max_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        own = segments.where(part == k).collect()  # about max_bytes bytes
        yield Windows([(r.item_id, r.text) for r in own], width), k == blocks - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: words, hit words, items that occur, and whether it is contaminated."""
    df = columns(docs, doc_id="long", text="string")
    for windows, last in blocks_of(benchmark, width, max_bytes):
        df = map_rows(df, Scan(share(docs.sparkSession, windows), last), RESULT if last else CARRIED)
    return df


class Keep:
    """Passes the rows that no window occurs in, with all their columns."""

    def __init__(self, shared):
        self.shared = shared

    def start(self):
        windows, numbers = shared_value(self.shared), WordNumbers()

        def work(**cols):
            hits, _ = windows.scan([normal_words(t) for t in cols["text"]], numbers)
            at = [k for k, h in enumerate(hits) if not h.any()]
            return {name: [values[k] for k in at] for name, values in cols.items()}

        return work


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents without any benchmark window, columns unchanged."""
    for windows, _ in blocks_of(benchmark, width, max_bytes):
        docs = map_rows(docs, Keep(share(docs.sparkSession, windows)), docs.schema)
    return docs
