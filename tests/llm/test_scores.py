import itertools
import random

import numpy as np

from assaykit.llm import quality, toxicity

from .cases import frames, labels


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("ten", "sol", "vim") for c in ("a", "e", "os", "ul", "ing")]
    rows = []
    for i in range(n):
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(["jerkface", "dumbo", f"zork{rng.choice('abcdefghk')}{rng.choice(words)}"]))
        if bad:
            text = [w + rng.choice(["###", "%%%", "&&&"]) for w in text]
        rows.append((i, " ".join(text), int(not bad), int(toxic)))
    return rows


def made(spark, n=900):
    rows = corpus(n)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    return docs, labels(spark, [(i, q, x) for i, _, q, x in rows if i % 3]), rows


def test_toxicity_on_held_out_rows(spark):
    docs, known, rows = made(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    held = [(i, x) for i, _, _, x in rows if got[i].held_out]
    assert 100 < len(held) < 260
    assert np.mean([got[i].predicted == x for i, x in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_clauses_decide_not_words():
    reader = toxicity.Reader(toxicity.Grammar(words={"moron": 1.0, "worthless": 1.0}))
    score = lambda text: reader.read(text)[0]
    alone, aimed = score("what a moron"), score("you are a moron")
    assert 0.5 < alone < aimed
    for text in ("you are not a moron", "she said he is a moron", "you are not a worthless moron", "he wrote: x. they claims that you are worthless"):
        assert score(text) < 0.5 and any(w in text for w in ("moron", "worthless")), text
    assert score("she said he is a moron. you are a moron") > 0.5  # another clause counts on its own
    assert score("they will kill you") > 0.5 and score("kill the process") < 0.5 and score("we will not kill you") < 0.5
    assert score("they will kill the engine. nothing") > 0.5 and score("the engine kill. you") < 0.5
    assert score("x " * 50_000 + ". you moron") > 0.5  # however long the text


def test_signs_hold_whatever_the_labels_say():
    rng = random.Random(5)
    some = lambda: " ".join(f"word{rng.choice('abcdefghijklmnop')}{rng.choice('abcdefgh')}" for _ in range(12))
    sample = [(f"{some()} {rng.choice(['not', 'said'])} moron{k % 7}x {some()}", 1) for k in range(60)] + [(some(), 0) for _ in range(60)]
    w = toxicity.fit(sample + [(f"{some()} idiot {some()}", 1) for _ in range(30)]).weights
    assert w[0] < 0 and (w[1:4] >= 0).all() and max(w[1] + w[2], w[3]) + max(w[4], w[5]) <= 1e-9


def test_copies_are_one_witness():
    rng = random.Random(6)
    some = lambda: " ".join(f"word{rng.choice('abcdefghijklmnop')}{rng.choice('abcdefgh')}" for _ in range(25))
    base = some() + " strangeword " + some()
    sample = [(base + f" idiot n{i}", 1) for i in range(20)] + [(some() + " idiot " + some(), 1) for _ in range(15)] + [(some(), 0) for _ in range(30)]
    words, _ = toxicity.learn_lexicon(sample)
    assert "idiot" in words and "strangeword" not in words


def test_quality_on_held_out_rows(spark):
    docs, known, rows = made(spark)
    got = {r.doc_id: r for r in quality.quality(docs, known).collect()}
    held = [(i, q) for i, _, q, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == q for i, q in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert (1, 0) in [(a, b) for a, b, _ in model.pairs]


def test_awkward_rows_and_missing_labels(spark):
    docs, none = frames(spark)
    for known in (labels(spark), labels(spark, [(3, 1, 0)]), labels(spark, [(3, 1, 0), (4, 0, 1), (None, None, None), (6, 1, None)])):
        for f in (toxicity.toxicity, quality.quality):
            got = f(docs, known).collect()
            assert f(docs, known).columns[:4] == ["doc_id", "held_out", "score", "predicted"]
            assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
            assert f(none, known).count() == 0
    kept = quality.keep_good(docs, quality.Tables(base=35.0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_samples_are_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from assaykit.llm.common import first_by_hash

    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    whole = ids.orderBy(F.xxhash64(F.lit("s"), "doc_id"), "doc_id").limit(200)
    assert sorted(first_by_hash(ids, "s", 200, 5000).collect()) == sorted(whole.collect())
    assert first_by_hash(ids, "s", 9000, 5000).count() == 5000 and first_by_hash(ids.limit(0), "s", 5, 0).count() == 0


def plain_reading(string, w):
    """What the five rules say of a clause, read off its string directly."""
    total, near = 0.0, lambda i: any(string[j] == toxicity.TARGET for j in range(max(0, i - 4), min(len(string), i + 5)))
    denied = [False] * len(string)
    for i, c in enumerate(string):
        if c in toxicity.MATCHES:
            back = [j for j in range(max(0, i - 3), i) if string[j] == toxicity.NEGATION]
            fresh = back and not any(x in toxicity.MATCHES for x in string[back[-1] + 1 : i])
            denied[i] = bool(fresh) or (i > 0 and string[i - 1] in toxicity.MATCHES and denied[i - 1])
            total += w[1 + toxicity.DENIED] * denied[i] + w[1 + toxicity.REPORTED] * (toxicity.REPORT in string[:i])
        total += (c == toxicity.INSULT) * (w[1] + w[2] * near(i)) + (c == toxicity.THREAT) * w[3] * near(i)
    return max(0.0, total)


def test_composed_weights_equal_the_rules():
    rng = random.Random(8)
    weights = np.array([-4.0, 7.0, 1.25, 6.0, -9.0, -9.5])
    grammar = toxicity.Grammar(words={"i": 1.0}, weights=weights)
    reader = toxicity.Reader(grammar)
    strings = [bytes(s) for n in (1, 2, 3, 4) for s in itertools.product(toxicity.SYMBOLS, repeat=n)] + [bytes(rng.choices(toxicity.SYMBOLS, k=rng.randint(5, 14))) for _ in range(4000)]
    for string in strings:
        assert abs(reader.clause(string, ["i"] * len(string)) - plain_reading(string, weights)) < 1e-9, string


def test_sample_is_bounded_by_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from assaykit.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(5000)] + [(2, "b" * 1000), (3, "c"), (4, "both"), (5, "d")], "doc_id long, text string")
    known = labels(spark, [(1, 1, 1), (2, 1, 0), (3, 1, 0), (4, 1, 0), (4, 1, 1), (5, 1, 1), (6, 1, 1), (None, 1, 1)])
    got = labelled_sample(docs, known, "toxic", F.lit(True), 4)
    assert len(got) <= 4 and len({i for _, _, i in got}) == len(got) and 4 not in {i for _, _, i in got}
    assert got == labelled_sample(docs.repartition(3), known, "toxic", F.lit(True), 4)
    assert len(labelled_sample(docs, known, "toxic", F.lit(True), 100)) == 4  # 1, 2, 3, 5
    assert sum(len(t) for t, _, _ in labelled_sample(docs, known, "toxic", F.lit(True), 100, 900)) <= 1000


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from assaykit.llm import common

    texts = ["x" * 3_000_000, None, "y" * 3_000_000, "z", "", "w" * 9_000_000] + ["k"] * 600
    parts = list(common.slices(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["a", "b"])))
    assert [v for p in parts for v in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(v or "") for v in p.column(1).to_pylist()) <= common.SLICE_BYTES for p in parts)
    assert max(p.num_rows for p in parts) <= common.SLICE_ROWS


def test_written_tables_can_be_dropped(spark):
    import os

    from assaykit.llm import common

    common.drop_written(spark)
    table = common.written(spark.range(5))
    (path,) = common.WRITTEN
    assert table.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    common.drop_written(spark)
    assert not common.WRITTEN and not os.path.isdir(path.removeprefix("file:"))
