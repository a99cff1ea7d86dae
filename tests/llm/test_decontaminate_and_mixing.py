import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pandas as pd

from assaykit.llm import decontaminate, mixing
from assaykit.llm.sql import OP8

from .cases import frames

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, t in items:
            b = words(t)
            k = min(10, len(b))
            windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add(str(item_id))
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def planted(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice(['Ab', 'cé', '7x', 'ö'])}{i}" for i in range(60)]
    items = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(vocabulary, k=n))) for i, n in enumerate([25, 12, 10, 9, 4, 1, 0, 30, 11])]
    docs = []
    for d in range(80):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        if rng.random() < 0.6:
            t = words(rng.choice(items)[1])
            parts.append(" . ".join(t[rng.randint(0, 3) : len(t) - rng.randint(0, 3)]).upper())
        docs.append((d, "\n".join(parts)))
    return docs, items


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(9)
    item = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    docs = [(k, " ".join(["x"] * 3 + item[k * 17 : k * 17 + 9 + k % 4] + ["y"])) for k in range(40)] + [(99, " ".join(item))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("long", " ".join(item)), ("long", " ".join(item)), ("copy", " ".join(item)), ("short", "x y")], "item_id string, text string")
    whole = sorted(decontaminate.decontaminate(frame, bench).collect())
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 23)
    assert sorted(decontaminate.decontaminate(frame, bench, max_bytes=2000).collect()) == whole
    assert {r.doc_id for r in whole if r.n_items == 2} == {k for k in range(40) if k % 4} | {99}


def test_decontamination_matches_brute_force(spark):
    docs, items = planted()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for blocks in (decontaminate.MAX_BYTES, 300):  # one broadcast, and several
        got = decontaminate.decontaminate(frame, bench, max_bytes=blocks).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want
    clean = {r.doc_id for r in decontaminate.keep_clean(frame, bench).collect()}
    assert clean == {d for d, w in want.items() if not w[4]}


def test_decontamination_awkward_rows(spark):
    docs, none = frames(spark)
    bench = spark.createDataFrame([(1, "the plain text of a document it has two sentences"), (None, "one"), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert len(got) == docs.count() and decontaminate.decontaminate(none, bench).count() == 0
    assert {r.doc_id for r in got if r.contaminated} >= {3, 5}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.keep_clean(docs, bench).columns == docs.columns


def mixed_rows(n=3000, seed=5):
    rng = random.Random(seed)
    names = ["a"] * 60 + ["b"] * 20 + ["c"] * 5 + ["d", "é", None, "Z"]
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300, 2000 if i % 97 == 0 else 20])), rng.choice(names)) for i in range(n)]


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_targets(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(mixing.mix(docs.repartition(9)).collect(), key=str) == sorted(got, key=str)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = expected_targets(sizes)
    for s, t in target.items():
        assert abs(t - want[s]) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= max(8 * mixing.BLOCK_WORDS, 0.01 * t), (s, t, taken[s])


def test_mix_agrees_with_plain_sql(spark):
    rows = mixed_rows(900, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = {r[0]: (r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({OP8})").fetchall()}
    got = {r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect()}
    assert got == want


def sainte_lague(votes, seats):
    held = {k: 0 for k in votes}
    for _ in range(seats):
        best = max(votes, key=lambda k: (votes[k] / (2 * held[k] + 1), -k))
        held[best] += 1
    return held


def test_apportionment_is_by_highest_quotients(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows, want = [], {}
    for g in range(12):
        votes = {k: float(rng.choice([1, 3, 10, 50, 1000]) * rng.randint(1, 9)) for k in range(rng.randint(1, 30))}
        seats = rng.randint(0, 120)
        rows += [(g, k, v, seats, 10_000) for k, v in votes.items()]
        want |= {(g, k): s for k, s in sainte_lague(votes, seats).items()}
    frame = spark.createDataFrame(rows, "g int, k int, votes double, seats long, most long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(frame, ["g"], [F.col("k")], "votes", "seats", "most").collect()}
    assert got == want


def test_mix_awkward_rows(spark):
    docs, none = frames(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and mixing.mix(none).count() == 0
    assert all(r.taken == 0 for r in got if r.size == 0)


def test_many_shards_are_dealt_in_groups(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "a", "a", "b", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 7)
    got = mixing.mix(docs, shard_docs=50).collect()
    assert len(got) == 3000 and all(0 <= r.taken <= 3 * r.size for r in got)
    for name in ("a", "b", None):
        own = [r for r in got if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target
    again = mixing.mix(docs.repartition(5), shard_docs=50).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_an_id_that_repeats_spreads_over_shards(spark):
    docs = spark.createDataFrame([(7, f"text {i} " * 9, "a") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_docs=100).collect()
    assert len(got) == 4000 and abs(sum(r.taken for r in got) - got[0].target) <= 0.02 * got[0].target


def test_the_mix_has_no_python(spark):
    rows = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(rows)._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas"))
