import random
from collections import Counter

import corpus_pipeline
from assaykit.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_without_own_ids():
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    texts = [text(rng.randint(40, 300)) for _ in range(60)]
    ids = [None] * 12 + [7] * 12 + list(range(100, 136))
    return [(i, t, "en", f"src{k % 4}", len(t)) for k, (i, t) in enumerate(zip(ids, texts))]


def test_rows_with_null_and_repeated_ids_stay_in_dedup(spark):
    rows = rows_without_own_ids()
    copies = [rows[0], (500, rows[1][1], "en", "src0", 1), rows[13], (None, rows[40][1], "de", None, None)]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows + copies, SCHEMA), "").collect()
    # the copy without an id comes before its original with one
    want = [r for k, r in enumerate(rows) if k != 40] + [copies[3]]
    assert Counter(map(tuple, got)) == Counter(want)


def test_rows_with_null_and_repeated_ids_stay_in_the_mix(spark):
    rows = rows_without_own_ids()
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = [r for r in mixing.mix(docs).collect() if r.taken > 0]
    got = corpus_pipeline.mixed(spark, docs, "").collect()
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == Counter((r.doc_id, r.source, r.size, r.taken) for r in plan)
    assert any(r.doc_id is None for r in got) and sum(r.doc_id == 7 for r in got) <= 12


def test_mixed_texts_hold_the_words_taken(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = [f"d{i}w{k}" for k in range(rng.randint(1, 120))]
        text = "".join(w + rng.choice([" ", "\n", "\t ", " "]) for w in words)
        rows.append((i, text if i % 3 else " " + text.strip(), "en", "hot" if rng.random() < 0.9 else f"rare{i % 3}", len(text)))
    rows += [(900, None, "en", "hot", None), (901, " \n", "en", "rare1", 2)]
    got = corpus_pipeline.mixed(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    whole, sums, targets = {r[0]: r[1].split() for r in rows if r[1]}, Counter(), {}
    for r in got:
        words, own = Counter(r.text.split()), whole[r.doc_id]
        assert sum(words.values()) == r.taken and set(words) <= set(own) and r.n_chars == len(r.text), r.doc_id
        if r.taken == r.size and set(words.values()) == {1}:
            assert r.text == rows[r.doc_id][1].strip()
        sums[r.source] += len(r.text.split())
        targets[r.source] = r.target
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    print({s: (sizes[s], round(targets[s]), sums[s]) for s in sorted(targets)})
    for s, t in targets.items():
        assert abs(sums[s] - t) <= 8 * mixing.BLOCK_WORDS, (s, t, sums[s])
    assert sums["hot"] < 0.9 * sizes["hot"] and any(sums[s] > 1.5 * sizes[s] for s in targets)
