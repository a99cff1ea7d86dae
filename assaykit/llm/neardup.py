"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the counts of set bits in 32 segments of two bits. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints. Candidates are
held against that lower bound first, and only what it lets through is compared bit by bit.

The range join is a grid join: the segments form six blocks, and within a Manhattan distance of
three at least three blocks agree in every count. Each distinct fingerprint therefore goes to 20
cells (a choice of three blocks with their counts), and linked fingerprints meet in one of them.
Equal fingerprints are grouped before, so a group of copies of any size is one row here. A cell's
rows are 16 bytes each; a task compares them in slices and hands on a spanning forest of their
links, never all pairs. A crowded cell is first split on exact bits (linked fingerprints that meet
in it agree on four of seven bit groups), which keeps the comparisons few.

Defined cases: texts without words (null, blank) have fingerprint zero and link like any other;
texts and words of any length are read whole, in stretches; rows with equal ids each get a row, and
are linked if their fingerprints are; a null id counts as the smallest long and comes back as null;
ties do not arise (a component is named by its smallest id); an empty table gives no rows; columns
other than those named are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, map_rows, written
from .components import components
from .words import mix

DISTANCE = 3
SHINGLE = 3
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCKS = [range(0, 6), range(6, 12), range(12, 17), range(17, 22), range(22, 27), range(27, 32)]  # of segments
CELLS = list(combinations(range(6), 3))
CROWDED, COMPARED = 1024, 512
NO_ID = -(2**63)


class Fingerprint:
    def __init__(self, shingle: int = SHINGLE):
        self.shingle = shingle

    def start(self):
        k, digest = self.shingle, xxhash.xxh64_intdigest

        def one(text) -> int:
            words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
            if not words:
                return 0
            runs = [b" ".join(words)] if len(words) < k else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
            total, n = np.zeros(64, np.int64), len(runs)
            for at in range(0, n, 65536):
                h = np.fromiter((digest(r, 42) for r in runs[at : at + 65536]), np.uint64, min(65536, n - at))
                total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            return int(np.packbits((total * 2 > n).astype(np.uint8), bitorder="little").view(np.int64)[0])

        return lambda doc_id, text: {"doc_id": doc_id, "fp": [one(t) for t in text]}


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    return map_rows(columns(docs, doc_id="long", text="string"), Fingerprint(shingle), "doc_id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Counts of set bits in 32 segments of two bits, one row a fingerprint."""
    two = fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return ((two[:, None] >> (np.arange(32, dtype=np.uint64) * np.uint64(2))) & np.uint64(3)).astype(np.uint8)


PAIRS_OF_BITS = np.uint64(0x5555555555555555)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of two embeddings: each differing bit counts, but a segment in which
    one bit is set and the other unset keeps its count."""
    x = a ^ b
    even = x & (x >> np.uint64(1)) & (a ^ (a >> np.uint64(1))) & PAIRS_OF_BITS
    return np.bitwise_count(x).astype(np.int16) - 2 * np.bitwise_count(even).astype(np.int16)


def near_pairs(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Positions (i, j) with a[i] and b[j] within ``distance`` bits: the bound first, then all bits."""
    i, j = np.nonzero(manhattan(a[:, None], b[None, :]) <= distance)
    exact = np.bitwise_count(a[i] ^ b[j]) <= distance
    return np.stack([i[exact], j[exact]], axis=1)


def cell_rows(batches):
    """The 20 cells of each fingerprint."""
    powers = [np.uint64(3) ** np.arange(len(b), dtype=np.uint64) for b in BLOCKS]
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = embed(fp.view(np.uint64)).astype(np.uint64)
        blocks = [(counts[:, list(b)] * p).sum(1, dtype=np.uint64) for b, p in zip(BLOCKS, powers)]
        for c, (i, j, k) in enumerate(CELLS):
            # a block has at most 3^6 = 729 values, so three take 30 bits
            cell = ((np.uint64(c) << np.uint64(30)) | (blocks[i] << np.uint64(20)) | (blocks[j] << np.uint64(10)) | blocks[k]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp)], names=["cell", "fp"])


def forest(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Spanning links (as positions) of all pairs within ``distance`` among distinct fingerprints."""
    parent = np.arange(len(fp))
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def compare(at: np.ndarray) -> None:
        own = fp[at]
        for a in range(0, len(at), COMPARED):
            for b in range(a, len(at), COMPARED):
                for i, j in near_pairs(own[a : a + COMPARED], own[b : b + COMPARED], distance).tolist():
                    p, q = a + i, b + j
                    if p < q:
                        x, y = root(int(at[p])), root(int(at[q]))
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            out.append((int(at[p]), int(at[q])))

    if len(fp) <= CROWDED:
        compare(np.arange(len(fp)))
        return out
    # crowded: within three bits, four of seven groups of bits agree exactly
    cuts = np.linspace(0, 64, 8).astype(int)
    masks = [np.uint64(sum(1 << int(b) for b in range(a, z))) for a, z in zip(cuts, cuts[1:])]
    for four in combinations(range(7), 4):
        mask = np.uint64(0)
        for g in four:
            mask |= masks[g]
        key = fp & mask
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        for group in np.split(order, edges):
            if len(group) > 1:
                compare(group)
    return out


def cell_links(batches):
    """Spanning links of each cell; rows come sorted by cell."""
    left = [np.empty(0, np.int64), np.empty(0, np.int64)]

    def links(cell, fp):
        us, vs = [], []
        for group in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1) if len(cell) else []:
            if len(group) > 1:
                own = fp[group]
                for i, j in forest(own.view(np.uint64)):
                    us.append(own[i])
                    vs.append(own[j])
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["a", "b"])

    for batch in batches:
        cell, fp = (np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(left))
        done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        left = [cell[done:], fp[done:]]
        if done:
            yield links(cell[:done], fp[:done])
    if len(left[0]):
        yield links(*left)


def link_table(prints: DataFrame) -> DataFrame:
    """(a, b) links between different fingerprints of a table with distinct ``fp``: a spanning
    forest of every cell, so components are those of all links."""
    cells = prints.select("fp").mapInArrow(cell_rows, "cell long, fp long")
    dealt = cells.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(cell_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable by links of three bits or fewer)."""
    rows = cut(fingerprints(docs, shingle).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "fp"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    links = link_table(classes)
    named = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # fingerprints stand for nodes; the smallest document id of a component names it
    # tables of their own: both sides of each join are dealt anew, so a component or a fingerprint
    # that a third of all rows have can be split
    placed = written(classes.join(named.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component")))
    low = written(placed.groupBy("component").agg(F.min("low").alias("component_id")))
    every = written(placed.join(low, "component").select("fp", "component_id"))
    out = rows.join(every, "fp")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(null("doc_id"), "fp", null("component_id"))


# --- Near copies at larger distances -----------------------------------------------------------
#
# An edit that leaves 0.8 of the 5-word shingles moves some 15 % of the bits, so three bits of 64
# miss most near copies. The wide mode only takes its candidates from fingerprints: 256 bits, the
# same embedding and bound for a larger distance, and many grids instead of a pigeonhole. A grid's
# segments have one bit each, drawn by a fixed seed; two texts that differ in a share d of their
# bits meet in a grid of b segments with probability (1 - d)^b. The segments grow with the number
# of texts, so that cells stay small, and the grids with the segments, so that texts which differ in
# WIDE_SHARE of their bits meet in one of them but for a share of WIDE_MISSED. Within components of
# candidates the shingle sets of the texts are compared, and only pairs whose sets reach LIKENESS
# are linked; no component is held by one task (see verified_groups).

WIDE_SHARE, WIDE_MISSED, WIDE_DISTANCE = 0.18, 0.01, 64
LEAST_BITS, CELL_TEXTS = 13, 256
WIDE_SHINGLE, LIKENESS = 5, (8, 10)
WORDS_64 = 4
SMALL_CELL = 512
#: Tasks whose forests one task joins.
FEWER = 16
#: Shares of a group that meet its centre's fingerprint apart.
SHARES = 16
PRINT = [f"fp{i}" for i in range(WORDS_64)]
WIDE = "node long, " + ", ".join(f"{c} long" for c in PRINT) + ", n long"


def grid_bits(texts: int = 0) -> np.ndarray:
    """The bits of each grid, for so many distinct texts."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, texts) / CELL_TEXTS)))
    grids = math.ceil(math.log(WIDE_MISSED) / math.log1p(-((1 - WIDE_SHARE) ** bits)))
    order = np.random.Generator(np.random.PCG64(6))
    return np.array([np.sort(order.permutation(64 * WORDS_64)[:bits]) for _ in range(grids)], np.uint64)


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


class WidePrint:
    """A text's node (a digest of its words), 256 fingerprint bits of its 3-word shingles (XXH64,
    and mixes of it), and the number of its distinct 5-word shingles; other columns pass through."""

    def start(self):
        k, digest = SHINGLE, xxhash.xxh64_intdigest

        def half(h: np.ndarray) -> np.ndarray:
            return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)

        def one(words: list[bytes]) -> list[int]:
            if not words:
                return [0] * WORDS_64
            runs = [b" ".join(words)] if len(words) < k else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
            totals, n = [np.zeros(64, np.int64) for _ in range(WORDS_64)], len(runs)
            for at in range(0, n, 65536):
                h = np.fromiter((digest(r, 42) for r in runs[at : at + 65536]), np.uint64, min(65536, n - at))
                for total in totals:
                    total += half(h)
                    h = mix(h)
            return [int(np.packbits((t * 2 > n).astype(np.uint8), bitorder="little").view(np.int64)[0]) for t in totals]

        def work(text, **cols):
            words = [plain_words(t) for t in text]
            prints = [one(w) for w in words]
            nodes = np.array([digest(b" ".join(w), 7) for w in words], np.uint64).view(np.int64).tolist()
            sizes = [len(set(zip(*(w[i:] for i in range(WIDE_SHINGLE))))) or min(1, len(w)) for w in words]
            return cols | {"node": nodes, "n": sizes} | {c: [p[i] for p in prints] for i, c in enumerate(PRINT)}

        return work


def shingle_set(text: str | None) -> bytes:
    """The distinct 5-word shingles of a text, as sorted 64-bit hashes; a shorter text is one."""
    words = plain_words(text)
    runs = {b" ".join(words[i : i + WIDE_SHINGLE]) for i in range(len(words) - WIDE_SHINGLE + 1)} or {b" ".join(words)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r) for r in runs), np.uint64, len(runs))).tobytes()


def alike_in_size(a, b):
    """Whether sets of these sizes can reach LIKENESS at all."""
    return np.minimum(a, b) * LIKENESS[1] >= np.maximum(a, b) * LIKENESS[0]


class WideCells:
    """The cells of each text, one a grid."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, batches):
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(WORDS_64 + 2)]
            fps = [c.view(np.uint64) for c in cols[1 : 1 + WORDS_64]]
            for g, own in enumerate(self.bits):
                cell = np.full(len(cols[0]), g << len(own), np.int64)
                for place, bit in enumerate(own.tolist()):
                    cell |= ((fps[bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)).astype(np.int64) << place
                yield pa.RecordBatch.from_arrays([pa.array(cell), *map(pa.array, cols)], names=["cell", "node", *PRINT, "n"])


def spanning(batches):
    """Of a task's links (u, v) those that join what the links before didn't: at most a link for each
    node but one, however many ways a crowd is linked in. Components stay the same."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        kept = []
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append((u, v))
        if kept:
            pairs = np.array(kept, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def wide_links_spanned(batches):
    return spanning(wide_links(batches))


def wide_near(fps, n, i, j) -> np.ndarray:
    """Which of some pairs are candidates: sizes and the bound first, then all bits."""
    out = alike_in_size(n[i], n[j]) & (sum(manhattan(f[i], f[j]) for f in fps) <= WIDE_DISTANCE)
    at = np.flatnonzero(out)
    if len(at):
        a, b = (np.broadcast_to(x, out.shape)[at] for x in (i, j))
        out[at] = sum(np.bitwise_count(f[a] ^ f[b]).astype(np.int16) for f in fps) <= WIDE_DISTANCE
    return out


def wide_links(batches):
    """Links inside each cell, rows sorted by cell; their components are those of all pairs in the
    cell. In cells of up to SMALL_CELL rows all pairs are compared, for all cells at once, but for
    those that links connect already. In larger ones a row takes all rows near it from the rest,
    and each of these then takes from what is left, until none is near: a crowd of copies costs a
    few passes, and every row was compared with all that no other row had taken."""

    def links(cols):
        cell, node, fps, n = cols[0], cols[1], [c.view(np.uint64) for c in cols[2 : 2 + WORDS_64]], cols[-1]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        sizes = np.diff(edges)
        us, vs = [], []
        # rows after each row in its cell; large cells apart
        after = np.where(np.repeat(sizes <= SMALL_CELL, sizes), np.repeat(edges[1:], sizes) - np.arange(len(cell)) - 1, 0)
        group, at = np.arange(len(cell)), np.arange(len(cell))
        for shift in range(1, SMALL_CELL):
            at = at[after[at] >= shift]
            if not len(at):
                break
            own = at[group[at] != group[at + shift]]
            own = own[wide_near(fps, n, own, own + shift)]
            us.append(node[own])
            vs.append(node[own + shift])
            np.minimum.at(group, own + shift, group[own])  # what links connect has one number, at least in part
        for k in np.flatnonzero(sizes > SMALL_CELL).tolist():
            a, b = int(edges[k]), int(edges[k + 1])
            rest = np.arange(a, b)
            while len(rest):
                line, rest = [int(rest[0])], rest[1:]
                while line and len(rest):
                    i = line.pop()
                    taken = wide_near(fps, n, i, rest)
                    if taken.any():
                        j, rest = rest[taken], rest[~taken]
                        us.append(np.full(len(j), node[i]))
                        vs.append(node[j])
                        line += j.tolist()
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
        pairs = np.unique(np.stack([u, v], axis=1), axis=0) if len(u) else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    left = None
    for batch in batches:
        own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        cols = own if left is None else [np.concatenate(x) for x in zip(left, own)]
        done = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        left = [c[done:] for c in cols]
        if done:
            yield links([c[:done] for c in cols])
    if left is not None and len(left[0]):
        yield links(left)


def alike(own: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets of distinct sorted numbers share LIKENESS of their union."""
    common = len(np.intersect1d(own, other, assume_unique=True))
    return common * LIKENESS[1] >= (len(own) + len(other) - common) * LIKENESS[0]


def linked(fp: tuple, own: np.ndarray, fps: list[np.ndarray], n: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Positions of the held texts that a text is linked with: candidates by fingerprint, then sets."""
    mine = [np.array([x], np.int64).view(np.uint64) for x in fp]
    near = wide_near([np.concatenate([f, m]) for f, m in zip(fps, mine)], np.append(n, len(own)), np.full(len(n), len(n)), np.arange(len(n)))
    return [k for k in np.flatnonzero(near).tolist() if alike(own, sets[k])]


def bit_sums(batches):
    """(candidates, texts, sums): how many texts of a group have each bit set, summed by task."""
    held: dict[int, np.ndarray] = {}

    def out():
        keys = list(held)
        arrays = [pa.array(keys, pa.int64()), pa.array([held[k].tobytes() for k in keys], pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["candidates", "sums"])

    for batch in batches:
        group = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(group):
            continue
        words = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(WORDS_64)], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[order], prepend=group[order][0] - 1))
        sums = np.add.reduceat(bits[order].astype(np.int64), edges, axis=0)
        sums = np.concatenate([sums, np.diff(np.append(edges, len(order)))[:, None]], axis=1)
        for k, own in zip(group[order][edges].tolist(), sums):
            held[k] = held[k] + own if k in held else own
        if len(held) > 20_000:
            yield out()
    if held:
        yield out()


def centre_prints(batches):
    """(candidates, c0 ... c3): the majority of each bit; sums come sorted by group."""
    names = ["candidates", *[f"c{i}" for i in range(WORDS_64)]]

    def out(groups, sums):
        bits = (np.array([s[:-1] * 2 > s[-1] for s in sums])).astype(np.uint8)
        words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), *[pa.array(words[:, i].copy()) for i in range(WORDS_64)]], names=names)

    groups, sums = [], []
    for batch in batches:
        for group, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not groups or groups[-1] != group:
                if len(groups) >= 4096:
                    yield out(groups, sums)
                    groups, sums = [], []
                groups.append(group)
                sums.append(np.frombuffer(own, np.int64))
            else:
                sums[-1] = sums[-1] + np.frombuffer(own, np.int64)
    if groups:
        yield out(groups, sums)


def against_centre(batches):
    """Whether each text is linked with its group's centre: (candidates, node, centre, ok)."""
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        ok = []
        for row in zip(*cols):
            fp, own, centre, other = row[2 : 2 + WORDS_64], np.frombuffer(row[2 + WORDS_64], np.uint64), row[4 + WORDS_64 : 4 + 2 * WORDS_64], np.frombuffer(row[-1], np.uint64)
            held = [np.array([x], np.int64).view(np.uint64) for x in centre]
            ok.append(row[1] == row[3 + WORDS_64] or bool(linked(fp, own, held, np.array([len(other)]), [other])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3 + WORDS_64), pa.array(ok)], names=["candidates", "node", "centre", "ok"])


def across(batches):
    """Links (u, v) of the texts that no centre took, with all texts of their group: rows
    (candidates, salt, kind, node, name, fingerprints, own) come sorted; those of kind 0 are held,
    those of kind 1 pass by one after the other, each under the ``name`` it already has."""
    now, held, table = None, [], None
    found: set[tuple[int, int]] = set()
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for group, salt, kind, node, name, *fp, own in zip(*cols):
            if (group, salt) != now:
                now, held, table = (group, salt), [], None
            own = np.frombuffer(own, np.uint64)
            if kind == 0:
                held.append((node, fp, own))
                continue
            if table is None:
                table = ([np.array([h[1][i] for h in held], np.int64).view(np.uint64) for i in range(WORDS_64)], np.array([len(h[2]) for h in held], np.int64), [h[2] for h in held])
            found |= {(name, held[k][0]) for k in linked(fp, own, *table) if held[k][0] != name}
        if found:
            pairs = np.array(sorted(found), np.int64)
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


#: Texts of a group that pass by the held ones in one task.
PASSING = 128


def verified_groups(sets: DataFrame) -> DataFrame:
    """(node, component) of candidates (candidates, node, fingerprints, own) by all pairs of a group
    that are linked, for nodes that aren't alone.

    1. A group's centre is the text nearest to the majority of its texts' bits. Every text is held
       against it, which splits over tasks however large the group is.
    2. What no centre took, few texts in a group of near copies, is dealt to each of the group's
       shares of PASSING texts, which pass by it. So every pair of texts is tried but those of
       which a centre links both already.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = sets.select("candidates", *PRINT).mapInArrow(bit_sums, "candidates long, sums binary")
    centres = sums.repartition(parts, "candidates").sortWithinPartitions("candidates").mapInArrow(centre_prints, "candidates long, " + ", ".join(f"c{i} long" for i in range(WORDS_64)))
    away = reduce(lambda a, b: a + b, [F.bit_count(F.col(f).bitwiseXOR(F.col(f"c{i}"))) for i, f in enumerate(PRINT)])
    # tables of their own, so that both sides of a join are dealt anew and a large group can be split
    share = F.pmod(F.xxhash64("node"), F.lit(SHARES)).cast("int")
    spread = written(centres.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))))
    nearest = sets.select("candidates", "node", *PRINT, share.alias("share")).join(spread, ["candidates", "share"]).groupBy("candidates").agg(F.min(F.struct(away.alias("away"), "node")).alias("best"))
    chosen = nearest.select("candidates", F.col("best.node").alias("node"))
    centre = written(sets.join(chosen, ["candidates", "node"]).select("candidates", F.col("node").alias("centre"), *[F.col(f).alias(f"m{i}") for i, f in enumerate(PRINT)], F.col("own").alias("other")))
    stars = cut(sets.join(centre, "candidates").select("candidates", "node", *PRINT, "own", "centre", *[f"m{i}" for i in range(WORDS_64)], "other").mapInArrow(against_centre, "candidates long, node long, centre long, ok boolean"))

    groups = stars.groupBy("candidates").agg(F.count(F.lit(1)).alias("texts"), F.count_if(~F.col("ok")).alias("rest")).where("rest > 0")
    shares = groups.select("candidates", F.ceil(F.col("texts") / PASSING).cast("int").alias("shares"))
    open_ = written(stars.join(shares, "candidates").select("candidates", "node", "ok", "shares", F.when(F.col("ok"), F.col("centre")).otherwise(F.col("node")).alias("name")))
    rows = sets.join(open_, ["candidates", "node"])
    last = ["node", "name", *PRINT, "own"]
    passing = rows.select("candidates", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("salt"), F.lit(1).alias("kind"), *last)
    held = rows.where("NOT ok").select("candidates", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("kind"), *last)
    links = passing.unionByName(held).repartition(parts, "candidates", "salt").sortWithinPartitions("candidates", "salt", "kind").mapInArrow(across, "u long, v long").distinct()
    joined = components(links).withColumnRenamed("node", "name").withColumnRenamed("component", "root")
    named = stars.select("node", F.when(F.col("ok"), F.col("centre")).otherwise(F.col("node")).alias("name")).join(joined, "name", "left")
    return named.select("node", F.coalesce("root", "name").alias("component"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, row, component for every row of ``docs`` (doc_id, text, row); ``row`` tells rows of
    different contents apart and a component is named by one of its texts' digests."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = columns(docs, doc_id="long", text="string", row="string")
    rows = cut(map_rows(plain, WidePrint(), "doc_id long, row string, " + WIDE))
    classes = rows.groupBy("node").agg(*[F.min(c).alias(c) for c in (*PRINT, "n", "row")])
    texts = classes.where("n > 0").select("node", *PRINT, "n")
    cells = texts.mapInArrow(WideCells(grid_bits(rows.select("node").distinct().count())), "cell long, " + WIDE)
    # links shrink to spanning forests twice, in each task and in each of fewer ones, so that a crowd
    # which meets in many cells comes to the components as little more than its texts
    links = cells.repartition(parts, "cell").sortWithinPartitions("cell", "node").mapInArrow(wide_links_spanned, "u long, v long")
    links = links.repartition(max(1, parts // FEWER)).mapInArrow(spanning, "u long, v long")
    candidates = classes.join(components(links).withColumnRenamed("component", "candidates"), "node").select("row", "candidates", "node", *PRINT)
    # rows that are alike in all columns share a digest, so a text may come more than once
    texts = plain.select("row", "text").join(candidates, "row").select("candidates", "node", *PRINT, "text").dropDuplicates(["node"])
    sets = written(map_rows(texts, with_set, "candidates long, " + ", ".join(f"{c} long" for c in ("node", *PRINT)) + ", own binary"))
    named = verified_groups(sets)
    return rows.select("doc_id", "row", "node").join(cut(named.where("node != component")), "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))


def with_set(text, **cols):
    return cols | {"own": [shingle_set(t) for t in text]}


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest id of the component) by pairs that share 0.8 of their
    5-word shingles: exact copies always, others where their fingerprints made them candidates,
    with a recall that tests measure."""
    plain = columns(docs, doc_id="long", text="string")
    found = near_groups(plain.withColumn("row", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"))))
    found = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "component")
    low = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.join(low, "component").select(null("doc_id"), null("component_id"))
