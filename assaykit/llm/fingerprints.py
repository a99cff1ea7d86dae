"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text is a set of digests, one for each piece of a paragraph (``PIECE`` words, counted from the
paragraph's start, so an edit changes the pieces after it in its own paragraph only). A digest
goes into one cell of each of three subtables; a cell holds a count and the XOR of its digests.
The cells of two versions subtract, and what is left is peeled: a cell of count 1 or -1 whose
digest passes its own check gives a digest of one side, which is taken out of its other cells, and
so on until nothing is left, or until peeling is stuck: then more cells for what they hold are tried.

``recover`` does so with two texts: rows whose peeling is stuck are tried again with twice the cells.
A ``fingerprint`` holds every digest of its text, so its size grows with the text: digests are dealt
by the first bits of their check to parts of ``LOAD`` or fewer on average, and each part has a sketch
that peels by itself; the digests it would be stuck at stand beside it (``stash``). Two fingerprints
of as many parts are subtracted part by part, and a part whose difference is stuck is peeled on
either side; of unequal numbers of parts, all are (what peeling gives is kept, so that no fingerprint
is peeled twice). So the number of differing digests is exact, and
with the set sizes it gives the likeness (Jaccard).

The next document is found without sorting the table into one task: rows fall into ranges of
(id, hash of the text) by the quantiles of a seeded sample, each range gets a copy of the first row
of the range after it, and a window runs over every range. An id that repeats with many texts is
parted like any other rows.

Defined cases: a null text counts as empty; two empty texts are alike (1); texts of any length are
read whole; after the last document comes the first (a single row follows itself); a null id counts
as the smallest; rows with equal ids stand in the order of a hash of their texts, rows with equal
texts too follow each other in any order, which changes no result; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HASHES

PIECE = 8
SUBTABLES, CELLS = 3, 16
#: Cells a subtable of a fingerprint's part, and digests that a part holds on average at most.
PART_CELLS, LOAD = 8, 12
#: Bits of a digest's check, by which it is dealt to a part.
CHECK_BITS = 24
ROUNDS = 10
RANGE_ROWS, MOST_RANGES, SAMPLED = 500, 100_000, 20
NO_ID = -(2**63)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (and not copied, as ``transform`` would)."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, body)


def digests(text: Column) -> Column:
    """The distinct digests of a text: 40 bits of a hash, and 24 bits of a check of them."""

    def piece_hashes(paragraph: Column) -> Column:
        words = F.filter(F.split(paragraph, "[ \\t\\x0B-\\r]+"), lambda w: w != "")
        return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(PIECE)), lambda i: F.xxhash64(F.slice(w, i + 1, PIECE)))))

    hashes = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), piece_hashes))
    low = F.array_distinct(F.transform(hashes, lambda h: h.bitwiseAND(F.lit((1 << 40) - 1))))
    return F.transform(low, checked)


def checked(low: Column) -> Column:
    return low.bitwiseOR(F.shiftleft(F.xxhash64(low).bitwiseAND(F.lit((1 << 24) - 1)), 40))


def passes(key: Column) -> Column:
    return checked(key.bitwiseAND(F.lit((1 << 40) - 1))) == key


def part(key: Column, table: int, cells: int) -> Column:
    """The cell of a digest within a subtable."""
    number = lambda most: F.shiftright(key, 13 * table).bitwiseAND(F.lit(most).cast("bigint"))
    if cells & (cells - 1) == 0:
        return number(min(0x1FFF, cells - 1)).cast("int")
    return F.pmod(number(0x1FFF), F.lit(cells).cast("bigint")).cast("int")


def with_places(pairs: Column, cells: int) -> Column:
    """(key, sign) pairs with their cell in each subtable."""
    return F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["sign"].alias("sign"), *[part(p["key"], t, cells).alias(f"at{t}") for t in range(SUBTABLES)]))


def taken_out(cell: Column, placed: Column, t: int, c: Column) -> Column:
    """A cell, number c of subtable t, without the placed pairs that belong to it."""
    less = lambda a, p: F.struct((a["n"] - p["sign"]).alias("n"), a["key"].bitwiseXOR(p["key"]).alias("key"))
    return F.aggregate(placed, cell, lambda a, p: F.when(p[f"at{t}"] == c, less(a, p)).otherwise(a))


def sketch(keys: Column, cells: int = CELLS) -> Column:
    """Cells (count, key) of a set of digests."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"))
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(-1).alias("sign")))
    table = lambda t, placed: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: taken_out(none, placed, t, c))
    return let(with_places(pairs, cells), lambda placed: F.concat(*[table(t, placed) for t in range(SUBTABLES)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key")))


FOUND = "array<struct<n:int,key:bigint>>"


def peel(cells_left: Column, cells: int = CELLS, rounds: int = ROUNDS) -> Column:
    """(cells, found): what is left, and the digests recovered with their side (n is 1 or -1).

    A round takes one subtable after the other: its pure cells hold different digests, so nothing
    is found twice, and only the other subtables have cells to take them out of."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"))

    def alone(c: Column, t: int, i: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (part(c["key"], t, cells) == i)

    def cleared(table: Column, t: int, keys: Column) -> Column:
        return F.transform(table, lambda c, i: F.when(alone(c, t, i) & F.array_contains(keys, c["key"]), none).otherwise(c))

    def without(table: Column, t: int, found: Column) -> Column:
        less = lambda a, p: F.struct((a["n"] - p["n"]).alias("n"), a["key"].bitwiseXOR(p["key"]).alias("key"))
        taken = lambda cell, i: F.aggregate(found, cell, lambda a, p: F.when(part(p["key"], t, cells) == i, less(a, p)).otherwise(a))
        touched = F.transform(found, lambda p: part(p["key"], t, cells))
        return let(touched, lambda at: F.transform(table, lambda cell, i: F.when(F.array_contains(at, i), taken(cell, i)).otherwise(cell)))

    def of_table(state: Column, t: int) -> Column:
        def on(found: Column) -> Column:
            tables = [cleared(state[f"t{u}"], u, keys_of(found)) if u == t else without(state[f"t{u}"], u, found) for u in range(SUBTABLES)]
            return F.struct(*[x.alias(f"t{u}") for u, x in enumerate(tables)], F.concat(state["found"], found).alias("found"))

        pure = F.filter(state[f"t{t}"], lambda c, i: alone(c, t, i) & passes(c["key"]))
        return let(pure, lambda found: F.when(F.size(found) > 0, on(found)).otherwise(state))

    def step(state: Column, _: Column) -> Column:
        turn = lambda t: lambda now: of_table(now, t)
        after = state["now"]
        for t in range(SUBTABLES):
            after = let(after, turn(t))
        on = let(after, lambda now: F.struct(now.alias("now"), (F.size(now["found"]) > F.size(state["now"]["found"])).alias("live")))
        return F.when(state["live"], on).otherwise(state)

    tables = [F.slice(cells_left, t * cells + 1, cells).alias(f"t{t}") for t in range(SUBTABLES)]
    start = F.struct(F.struct(*tables, F.array().cast(FOUND).alias("found")).alias("now"), F.lit(True).alias("live"))
    ended = lambda state: F.struct(F.concat(*[state["now"][f"t{t}"] for t in range(SUBTABLES)]).alias("cells"), state["now"]["found"].alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, ended)


def empty(cells_left: Column) -> Column:
    return F.forall(cells_left, lambda c: (c["n"] == 0) & (c["key"] == 0))


def keys_of(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["key"])


def dealt(keys: Column, bits: Column) -> Column:
    """Digests by the first ``bits`` bits of their check: 2^bits arrays, empty ones included."""
    shift = lambda name, k, by: F.call_function(name, k, by)
    number = lambda k: shift("shiftrightunsigned", F.shiftrightunsigned(k, 40), F.lit(CHECK_BITS) - bits)
    pair = lambda p, k: F.struct(p.alias("part"), k.alias("key"))
    heads = F.transform(F.sequence(F.lit(0).cast("bigint"), shift("shiftleft", F.lit(1).cast("bigint"), bits) - 1), lambda p: pair(p, F.lit(None).cast("bigint")))

    def cut(line: Column) -> Column:  # the null key of a part stands before its digests
        starts = F.filter(F.sequence(F.lit(1), F.size(line)), lambda i: F.element_at(line, i)["key"].isNull())
        return let(starts, lambda at: F.transform(at, lambda i, j: keys_of(F.slice(line, i + 1, F.coalesce(F.get(at, j + 1), F.size(line) + 1) - i - 1))))

    return let(F.sort_array(F.concat(F.transform(keys, lambda k: pair(number(k), k)), heads)), cut)


def fingerprint(text: Column) -> Column:
    """(n, bits, parts) of a text: set size, and 2^bits parts (cells, stash, found) of its digests.
    ``found`` is what peeling the cells gives, kept so that no fingerprint is peeled twice."""

    def of_part(keys: Column) -> Column:
        # what peeling leaves in the cells is what the stuck digests put there
        own = lambda all_in, left, found: F.struct(subtract(all_in, left).alias("cells"), F.array_except(keys, found).alias("stash"), found.alias("found"))
        peeled = lambda all_in: let(peel(all_in, PART_CELLS), lambda s: let(keys_of(s["found"]), lambda found: own(all_in, s["cells"], found)))
        return let(sketch(keys, PART_CELLS), peeled)

    def of_set(keys: Column) -> Column:
        bits = F.least(F.lit(CHECK_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(keys), F.lit(1)) / LOAD)))).cast("int")
        return let(bits, lambda b: F.struct(F.size(keys).alias("n"), b.alias("bits"), F.transform(dealt(keys, b), of_part).alias("parts")))

    return let(digests(text), of_set)


def as_text(fp: Column) -> Column:
    """A fingerprint as base64 text: size and bits, then for each part the number of stashed digests,
    these, and 9 bytes a cell."""
    digits = lambda value, n: F.lpad(F.hex(value), n, "0")
    cell = lambda c: F.when((c["n"] == 0) & (c["key"] == 0), F.lit("0" * 18)).otherwise(F.concat(digits(c["n"].bitwiseAND(F.lit(255)), 2), digits(c["key"], 16)))
    of_part = lambda p: F.concat(digits(F.size(p["stash"]), 8), F.array_join(F.transform(p["stash"], lambda k: digits(k, 16)), ""), F.array_join(F.transform(p["cells"], cell), ""))
    return F.base64(F.unhex(F.concat(digits(fp["n"], 8), digits(fp["bits"], 2), F.array_join(F.transform(fp["parts"], of_part), ""))))


def listed(p: Column) -> Column:
    """All digests of a fingerprint's part, as peeling gave them."""
    return F.concat(p["found"], p["stash"])


def apart(a: Column, b: Column) -> Column:
    """How many elements only one of two sets has."""
    return let(a, lambda x: let(b, lambda y: F.size(x) + F.size(y) - 2 * F.size(F.array_intersect(x, y))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints."""
    whole = (a["n"] + b["n"]).cast("double")

    def differing(x: Column, y: Column) -> Column:
        # a digest may be stashed on one side and in the cells of the other
        stashed = F.concat(F.array_except(x["stash"], y["stash"]), F.array_except(y["stash"], x["stash"]))
        return let(peel(subtract(x["cells"], y["cells"]), PART_CELLS), lambda s: F.when(empty(s["cells"]), apart(keys_of(s["found"]), stashed)).otherwise(apart(listed(x), listed(y))))

    by_part = F.aggregate(F.zip_with(a["parts"], b["parts"], differing), F.lit(0), lambda total, n: total + n)
    every = lambda fp: F.flatten(F.transform(fp["parts"], listed))
    d = F.when(a["bits"] == b["bits"], by_part).otherwise(apart(every(a), every(b)))
    return F.when(whole == 0, F.lit(1.0)).otherwise(let(d, lambda n: (whole - n) / (whole + n)))


def split_points(rows: DataFrame, count: int, ranges: int) -> list[tuple[int, int]]:
    """Ordered (d, h) that part the rows into about ``ranges`` ranges, by a seeded sample of
    ``SAMPLED`` different pairs a range."""
    order, share = F.xxhash64(F.lit("ranges"), "d", "h"), SAMPLED * ranges / count
    near = rows.select("d", "h").where(order < F.lit(int(share * HASHES - HASHES / 2))) if share < 1 else rows.select("d", "h")
    pairs = sorted((r.d, r.h) for r in near.distinct().collect())  # SAMPLED pairs a range
    return sorted({pairs[len(pairs) * k // ranges] for k in range(1, ranges)}) if pairs else []


def range_of(points: list[tuple[int, int]]) -> Column:
    """How many of the points (d, h) are not beyond a row's: first among every so many of them, then
    among the few after the last of these."""
    kind, key = "array<struct<d:bigint,h:bigint>>", F.struct("d", "h")
    step = max(1, math.isqrt(len(points)))
    constant = lambda rows: F.from_json(F.lit(json.dumps([{"d": d, "h": h} for d, h in rows])), kind)
    below = lambda array: F.size(F.filter(array, lambda x: x <= key))
    heads, every = constant(points[::step]), constant(points)
    return F.when(F.lit(not points), 0).otherwise(let(below(heads), lambda i: F.when(i == 0, 0).otherwise((i - 1) * step + below(F.slice(every, (i - 1) * step + 1, step)))))


def with_next(rows: DataFrame) -> DataFrame:
    """Adds (range, copy): every row in the range of its (d, h), and copies of range starts."""
    count = rows.count()
    ranges = min(MOST_RANGES, max(1, count // RANGE_ROWS))
    ranged = rows.withColumn("range", range_of(split_points(rows, count, ranges) if ranges > 1 else []))
    first = ranged.groupBy("range").agg(F.max(F.struct("d", "h")).alias("top"))  # MOST_RANGES rows at most
    order = Window.orderBy(F.col("range").desc())
    above = F.coalesce(F.lag("range").over(order), F.min("range").over(Window.partitionBy(F.lit(1))))
    edges = first.select(F.col("top.d").alias("d"), F.col("top.h").alias("h"), above.alias("target"))
    marked = ranged.join(F.broadcast(edges), ["d", "h"], "left")
    here = F.struct(F.col("range"), F.lit(False).alias("copy"))
    there = F.struct(F.col("target").alias("range"), F.lit(True).alias("copy"))
    both = F.explode(F.when(F.col("target").isNull(), F.array(here)).otherwise(F.array(here, there)))
    return marked.select("d", "h", "text", both.alias("at")).select("d", "h", "text", "at.range", "at.copy")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and both likenesses."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("range").orderBy("copy", F.col("d").desc(), F.col("h").desc())
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    texts = with_next(rows).withColumn("next", F.lead("text").over(order))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    texts = texts.withColumns({"n_chars": n.cast("long"), "edited": edited})
    prints = texts.select("range", "copy", "d", "h", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), F.when(~F.col("copy"), fingerprint(F.col("edited"))).alias("edited_fp"))
    paired = prints.withColumn("next_fp", F.lead("fp").over(order)).where(~F.col("copy"))
    return paired.select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def recover(versions: DataFrame, cells: int = CELLS, most: int = 8) -> DataFrame:
    """(key, removed, added, cells) for each row (key, old, new): the digests of pieces that only
    one version has. Rows whose peeling is stuck go on to sketches of twice the cells, ``most``
    times at most (a cell's number has 13 bits); what is stuck even then is compared digest by
    digest, and has null ``cells``."""
    left = versions.select("key", digests(F.col("old")).alias("a"), digests(F.col("new")).alias("b"))
    out = None
    for k in range(most + 1):
        size = cells << k
        tried = left.withColumn("state", peel(subtract(sketch(F.col("a"), size), sketch(F.col("b"), size)), size, 2 * ROUNDS))
        tried = tried.withColumn("done", empty(F.col("state.cells")))
        side = lambda sign: F.transform(F.filter(F.col("state.found"), lambda p: p["n"] == sign), lambda p: p["key"])
        last = k == most
        done = tried if last else tried.where("done")
        found = lambda sign, a, b: F.when(F.col("done"), side(sign)).otherwise(F.array_except(a, b))
        rows = done.select("key", found(1, "a", "b").alias("removed"), found(-1, "b", "a").alias("added"), F.when(F.col("done"), F.lit(SUBTABLES * size)).alias("cells"))
        out = rows if out is None else out.unionByName(rows)
        left = tried.where(~F.col("done")).select("key", "a", "b")
        if not last and left.isEmpty():
            break
    return out
