"""Substring dedup by prefix-partitioned suffix trees.

Repeats of ``WINDOW`` words or more are deep internal nodes of the corpus' suffix tree. The tree is
never built whole: it holds a suffix only where one is needed, and these suffixes are split by
variable-length prefixes into groups whose subtrees are built on their own.

* A window of 20 words is found through the suffix that starts at the smallest of its 6-word runs
  (by a fixed hash; the leftmost on ties). Equal windows have equal runs at equal places, so they
  are found through suffixes with one prefix. Neighbouring windows mostly share their suffix: it
  stands for all of them, and travels once, with the words before it that they begin with.
* A prefix of 6 words that occurs once leads to a single leaf: a count of prefixes drops it, and
  with it most of the corpus, before any words are moved.
* Prefixes of up to ``GROUP`` leaves make memory-sized groups. The others are split by the longest
  prefix there is, all 20 words of each window: such a group is one deep node, of which each task
  hands on the first leaf only, so a passage in a third of all documents is a few rows.
* In a group, suffixes are sorted by their words; the lengths that neighbours have in common
  (LCP) give the internal nodes. A window that starts k words before its suffix needs a node of
  depth 20 - k; the same is done with the words before the suffix, read backwards, at depth k.
  Windows below one pair of such nodes are equal. The one with the smallest (document, start) is
  the first, the others are repeats.

Words are ``[^\\x20\\x09-\\x0D]+``. In the subtrees they are compared byte by byte; a window of a split
prefix is known by 128 bits of its 20 words.

Each document then loses the words that its repeated windows cover; neighbouring windows make the
spans that are removed.

Defined cases: null text has no words; documents under 20 words lose none; texts and words of any
length are read whole; rows with an equal id and equal text are one document and get equal results
(they tie, and none is a repeat of the other), rows with an equal id and other text are ordered by
31 bits of a hash of the text; a null id comes before all others; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, written
from .words import Layout, rolling, sliding_min

WINDOW, RUN, GROUP = 20, 6, 256
NO_ID = -(2**63)
COMBINED = 300_000
CHUNK_SUFFIXES = 120_000
RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"


def anchors(layout: Layout):
    """Every 6-word run's number, the starts of all windows that lie in one document, and the run
    (position) of each."""
    runs = rolling(layout.number, RUN)
    at = sliding_min(runs, WINDOW - RUN + 1)
    n = len(at)
    inside = np.flatnonzero(layout.doc[:n] == layout.doc[WINDOW - 1 : WINDOW - 1 + n]) if n else np.empty(0, np.int64)
    return runs, inside, at[inside]


class Runs:
    """Every chosen run of every document: its number, the document and its position."""

    def start(self):
        def work(d, h, text):
            layout = Layout(text)
            runs, _, at = anchors(layout)
            at = at[np.flatnonzero(np.diff(at, prepend=-1))]  # runs of windows come in order
            own = layout.doc[at]
            return {"run": runs[at].view(np.int64), "d": np.array(d, np.int64)[own], "h": np.array(h, np.int64)[own], "pos": (at - layout.starts[own]).astype(np.int32)}

        return work


SUFFIXES = "run long, rest long, d long, h long, start int, n int, before int, words binary"


def marks(layout: Layout, places: list[list[int] | None]) -> np.ndarray:
    """Which words of the layout are at the places given for each text."""
    out = np.zeros(len(layout.number) + WINDOW, bool)
    sizes = [len(p) if p else 0 for p in places]
    if any(sizes):
        out[np.fromiter((x for p in places if p for x in p), np.int64, sum(sizes)) + np.repeat(layout.starts[:-1], sizes)] = True
    return out


def suffix_rows(batches):
    """Blocks of suffixes of small groups, and single suffixes of large ones (n = 0), combined."""
    schema, first = pa.schema([("run", pa.int64()), ("rest", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("before", pa.int32()), ("words", pa.binary())]), {}

    def combined():
        rows = [(r - (1 << 64) if r >> 63 else r, s - (1 << 64) if s >> 63 else s, *v, 0, 0, None) for (r, s), v in first.items()]
        first.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for part in slices(batch):
            d, h, text, many, few = (part.column(i).to_pylist() for i in range(5))
            chosen = [k for k in range(len(d)) if many[k] or few[k]]
            if not chosen:
                continue
            layout = Layout([text[k] for k in chosen])
            ids, hashes = np.array([d[k] for k in chosen], np.int64), np.array([h[k] for k in chosen], np.int64)
            runs, inside, at = anchors(layout)
            begins = np.flatnonzero(np.diff(at, prepend=-1))
            counts = np.diff(begins, append=len(at))
            lows, run_at = inside[begins], at[begins]
            raw, begin, end = layout.raw, layout.begin, layout.end
            small = np.flatnonzero(marks(layout, [few[k] for k in chosen])[run_at])
            if len(small):
                lo, n, own = lows[small], counts[small], layout.doc[lows[small]]
                words = [raw[x:y] for x, y in zip(begin[lo].tolist(), end[lo + n + WINDOW - 2].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(runs[run_at[small]].view(np.int64)), pa.array(np.zeros(len(small), np.int64)), pa.array(ids[own]), pa.array(hashes[own]), pa.array((lo - layout.starts[own]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((run_at[small] - lo).astype(np.int32)), pa.array(words, pa.binary())], schema=schema)
            large = np.flatnonzero(marks(layout, [many[k] for k in chosen])[run_at])
            for lo, n in zip(lows[large].tolist(), counts[large].tolist()):
                own = int(layout.doc[lo])
                words = raw[begin[lo] : end[lo + n + WINDOW - 2]].split()
                for i in range(n):
                    digest = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + WINDOW]))
                    key, value = (digest >> 64, digest & (1 << 64) - 1), (d[chosen[own]], h[chosen[own]], lo + i - int(layout.starts[own]))
                    if key not in first or value < first[key]:
                        first[key] = value
            if len(first) > COMBINED:
                yield combined()
    if first:
        yield combined()


def nodes(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The subtree's nodes: row k holds each leaf's node at depth k.

    ``words`` has a row a suffix (-1 beyond its end). Sorted suffixes whose common prefixes are k
    words or more, one after the other, are below one node of depth k."""
    depth = words.shape[1]
    order = np.lexsort((*words.T[::-1], group))
    sorted_words = words[order]
    same = np.zeros((len(order), depth), bool)
    same[1:] = (sorted_words[1:] == sorted_words[:-1]) & (sorted_words[1:] >= 0)
    same[1:][group[order][1:] != group[order][:-1]] = False
    common = np.where(same.all(1), depth, same.argmin(1))  # LCP with the suffix before
    alike = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    out = np.empty((depth + 1, len(order)), np.int64)
    for k in range(depth + 1):
        out[k, order] = np.cumsum(alike | (common < k))
    return out


def subtree(group, d, h, start, n, before, words):
    """First leaves of the deep nodes of some whole groups: a bit mask for each block of windows."""
    layout = Layout(words)
    number, at = layout.exact(), layout.starts[:-1] + before
    number = np.append(number, -1)

    def line(steps: np.ndarray, limit: np.ndarray) -> np.ndarray:
        place = at[:, None] + steps
        return number[np.where((place >= layout.starts[:-1, None]) & (place < limit[:, None]), place, -1)]

    right = nodes(line(np.arange(WINDOW), layout.starts[1:]), group)
    left = nodes(line(-1 - np.arange(WINDOW - RUN), layout.starts[1:]), group)
    block = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
    ahead = before[block] - offset  # words of the window before its suffix
    inner, outer, place = right[WINDOW - ahead, block], left[ahead, block], start[block] + offset
    order = np.lexsort((place, h[block], d[block], outer, inner, ahead))
    key = np.stack([ahead, inner, outer])[:, order]
    chosen = order[np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])]
    mask = np.zeros(len(n), np.int64)
    np.bitwise_or.at(mask, block[chosen], np.int64(1) << offset[chosen])
    return mask


def first_rows(batches):
    """(d, h, start, mask) of windows that are the first of their words; rows come sorted by run."""
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("mask", pa.int64())])

    def rows(table):
        cols = [table.column(i) for i in range(8)]
        run, rest, d, h, start, n, before = (c.to_numpy() for c in cols[:7])
        single = n == 0
        if single.any():
            order = np.lexsort((start, h, d, rest, run))
            order = order[single[order]]
            new = np.concatenate([[True], (np.diff(run[order]) != 0) | (np.diff(rest[order]) != 0)])
            at = order[new]
            yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(h[at]), pa.array(start[at]), pa.array(np.ones(len(at), np.int64))], schema=schema)
        blocks = np.flatnonzero(~single)
        if len(blocks):
            own = (x[blocks].astype(np.int64) for x in (run, d, h, start, n, before))
            mask = subtree(*own, cols[7].take(pa.array(blocks)).to_pylist())
            at = blocks[mask != 0]
            yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(h[at]), pa.array(start[at]), pa.array(mask[mask != 0])], schema=schema)

    held, size = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            held.append(part)
            size += int(np.maximum(part.column(5).to_numpy(zero_copy_only=False), 1).sum())
            if size >= CHUNK_SUFFIXES:
                table = pa.Table.from_batches(held).combine_chunks()
                run = table.column(0).to_numpy()
                done = int(np.searchsorted(run, run[-1]))  # the last group may go on
                if done:
                    yield from rows(table.slice(0, done))
                    rest = table.slice(done)
                    held, size = rest.to_batches(), int(np.maximum(rest.column(5).to_numpy(), 1).sum())
    if held:
        yield from rows(pa.Table.from_batches(held))


class Remove:
    """Removes the words that repeated windows cover."""

    def start(self):
        def work(d, h, text, many, few, firsts):
            layout = Layout(text)
            _, inside, at = anchors(layout)
            total = len(layout.number)
            repeated = np.zeros(total + 64, bool)
            repeated[inside[(marks(layout, many) | marks(layout, few))[at]]] = True
            sizes = [len(f) if f else 0 for f in firsts]
            if any(sizes):
                found = [x for f in firsts if f for x in f]
                begin = np.array([x["start"] for x in found], np.int64) + np.repeat(layout.starts[:-1], sizes)
                mask = np.array([x["mask"] for x in found], np.int64)
                for k in range(WINDOW - RUN + 1):
                    repeated[begin[(mask >> k) & 1 == 1] + k] = False
            hit = np.flatnonzero(repeated[:total])
            edges = np.zeros(total + WINDOW + 1, np.int32)
            edges[hit] += 1
            edges[hit + WINDOW] -= 1
            kept = np.cumsum(edges)[:total] <= 0
            lost = np.diff(np.concatenate([[0], np.cumsum(~kept)])[layout.starts])
            texts, spans = [], []
            for k in range(len(d)):
                words, cuts = layout.joined(k), []
                if lost[k]:
                    split, own = words.split(), kept[layout.starts[k] : layout.starts[k + 1]]
                    words = b" ".join([split[i] for i in np.flatnonzero(own).tolist()])
                    edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=1, append=1)).tolist()
                    cuts = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])]
                texts.append(words)
                spans.append(cuts)
            return {"doc_id": [None if x == NO_ID else x for x in d], "n_words": np.diff(layout.starts), "n_removed": lost, "kept": texts, "spans": spans}

        return work


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and spans (the
    words removed, as word numbers, end exclusive) of every document."""
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(0x7FFFFFFF)).alias("h"), F.col("text").cast("string").alias("text"))
    runs = map_rows(plain, Runs(), "run long, d long, h long, pos int")
    # Runs are made twice rather than kept: reading the texts again is cheap, a table of all runs
    # is not. The repeated ones are a table of their own, so that both sides of the join are dealt
    # anew and a hot run can be split.
    repeated = written(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # sets, not lists: rows of one id and text repeat their places
    places = runs.join(repeated, "run").groupBy("d", "h").agg(
        F.collect_set(F.when(F.col("n") > GROUP, F.col("pos"))).alias("many"),
        F.collect_set(F.when(F.col("n") <= GROUP, F.col("pos"))).alias("few"),
    )
    marked = plain.join(places, ["d", "h"], "left")
    suffixes = marked.select("d", "h", "text", "many", "few").mapInArrow(suffix_rows, SUFFIXES)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = suffixes.repartition(parts, "run").sortWithinPartitions("run").mapInArrow(first_rows, "d long, h long, start int, mask long")
    firsts = leaves.groupBy("d", "h").agg(F.collect_set(F.struct("start", "mask")).alias("firsts"))
    return map_rows(marked.join(firsts, ["d", "h"], "left").select("d", "h", "text", "many", "few", "firsts"), Remove(), RESULT)
