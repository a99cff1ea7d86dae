import bisect
import hashlib
import random

from pyspark.sql import functions as F

from assaykit.llm import fingerprints

from .cases import frames


def pieces(text):
    return {tuple(w[i : i + 8]) for p in (text or "").split("\n") for w in [p.split()] for i in range(0, len(w), 8)}


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 30)))) for i in range(n)]


def test_sets_are_recovered_exactly(spark):
    rng = random.Random(3)
    rows = []
    for i, old in texts(40, 1):
        lines = old.split("\n")
        new = [x if rng.random() < 0.8 else f"changed {i} {k}" for k, x in enumerate(lines)]
        rows.append((i, old, "\n".join(new)))
    rows += [(100, None, "a b"), (101, "", ""), (102, "x\n" * 5, "x")]
    got = {r.key: r for r in fingerprints.recover(spark.createDataFrame(rows, "key long, old string, new string"), cells=4).collect()}
    assert len(got) == len(rows) and len({r.cells for r in got.values()}) > 1  # some needed larger sketches
    for key, old, new in rows:
        a, b = pieces(old), pieces(new)
        assert (len(got[key].removed), len(got[key].added)) == (len(a - b), len(b - a)), key


def next_of(rows):
    down = sorted(rows, key=lambda r: -r[0])
    return {d[0]: down[(k + 1) % len(down)] for k, d in enumerate(down)}


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)  # several ranges
    rows = texts(60, 5) + [(1000 + i, t) for i, t in ((0, "same text"), (1, "same text"), (2, ""), (3, None), (4, "é😀x"))]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    after = next_of(rows)
    errors = []
    for i, t in rows:
        t, n = t or "", after[i][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        a, b = pieces(t), pieces(edited)
        errors.append(abs(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert sum(errors) / len(errors) < 0.06
    assert got[1000].fingerprint == got[1001].fingerprint and got[1001].near_next == 1.0
    assert got[1003].near_next == 1.0  # two empty texts


def test_ranges_part_an_id_that_repeats(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 9)
    rng = random.Random(2)
    rows = [(7 if rng.random() < 0.6 else rng.randint(-50, 50), f"text {i} of {rng.random()}") for i in range(400)]
    frame = spark.createDataFrame(rows, "d long, text string").withColumn("h", F.xxhash64("text"))
    points = fingerprints.split_points(frame, 400, 40)
    ranged = frame.withColumn("range", fingerprints.range_of(points)).collect()
    assert len(points) > 25 and all(r.range == bisect.bisect_right(points, (r.d, r.h)) for r in ranged)
    assert len({r.range for r in ranged if r.d == 7}) > 10
    got = {r.edited_sha256 for r in fingerprints.fingerprint_edits(frame.withColumnRenamed("d", "doc_id")).collect()}
    line = sorted(((r.d, r.h, r.text) for r in ranged), reverse=True)
    want = set()
    for k, (_, _, text) in enumerate(line):
        half = len(text) // 2
        want.add(hashlib.sha256((text[: len(text) - half] + line[(k + 1) % len(line)][2][:half]).encode()).hexdigest())
    assert got == want


def test_equal_texts_and_small_edits(spark):
    rows = texts(30, 9)
    frame = spark.createDataFrame([(i, t, t, t + "\none more line") for i, t in rows], "i long, a string, b string, c string")
    fp = fingerprints.fingerprint
    got = frame.select(fp(F.col("a")).alias("a"), fp(F.col("b")).alias("b"), fp(F.col("c")).alias("c")).select(fingerprints.likeness(F.col("a"), F.col("b")).alias("same"), fingerprints.likeness(F.col("a"), F.col("c")).alias("near"))
    assert all(r.same == 1.0 and 0.6 < r.near <= 1.0 for r in got.collect())


def test_one_row_and_awkward_rows(spark):
    one = spark.createDataFrame([(7, "a b c\nd")], "doc_id long, text string")
    r = fingerprints.fingerprint_edits(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    docs, none = frames(spark)
    assert fingerprints.fingerprint_edits(docs).count() == docs.count() and fingerprints.fingerprint_edits(none).count() == 0


def test_main_path_has_no_python(spark):
    docs, _ = frames(spark)
    plan = fingerprints.fingerprint_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
