import hashlib
import random

from assaykit.llm import substrings
from assaykit.llm.words import Layout, rolling, sliding_min

from .cases import frames


def brute(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                covered[i : i + 20] = [True] * 20
            seen.add(key)
        kept = [w for w, c in zip(words, covered) if not c]
        out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def planted(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(18, 70))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(parts)))
    rows += [(n + i, "loop " * 50) for i in range(3)] + [(n + 3 + i, rows[0][1]) for i in range(4)]
    return rows


def test_layout_agrees_with_split():
    texts = ["a  bb\n\tccc ", None, "", " x", "é ü\x0b😀\x0cend", "\xa0nbsp stays"]
    layout = Layout(texts)
    for d, t in enumerate(texts):
        want = (t or "").encode().split()
        got = [layout.raw[b:e] for b, e in zip(layout.begin[layout.starts[d] : layout.starts[d + 1]], layout.end[layout.starts[d] : layout.starts[d + 1]])]
        assert got == want and layout.joined(d) == b" ".join(want)
    again = Layout(["ccc", "a bb"])
    assert again.number[0] == layout.number[2] and again.number[1] == layout.number[0]


def test_sliding_min_is_leftmost():
    import numpy as np

    values = np.array([5, 3, 3, 9, 1, 1, 7, 2], np.uint64)
    for width in (1, 2, 3, 5):
        want = [i + int(values[i : i + width].argmin()) for i in range(len(values) - width + 1)]
        assert sliding_min(values, width).tolist() == want
    assert len(rolling(values, 9)) == 0


def compare(spark, rows, group):
    old, substrings.GROUP = substrings.GROUP, group
    try:
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        substrings.GROUP = old
    assert sorted((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in got) == sorted(brute(rows))
    texts = {i: (t or "").split() for i, t in rows}
    for r in got:  # spans say the same as the kept text
        cut = {k for s in r.spans for k in range(s.start, s.end)}
        assert [w for k, w in enumerate(texts[r.doc_id]) if k not in cut] == r.kept.split() and len(cut) == r.n_removed


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_repeats_match_brute_force(spark):
    compare(spark, planted(), 256)


def test_large_groups_are_split_with_equal_results(spark):
    compare(spark, planted(), 2)


def test_order_of_rows_does_not_matter(spark):
    rows = planted(60, 9)
    a = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    b = substrings.remove_repeats(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7))
    assert sorted(a.collect()) == sorted(b.collect())


def test_awkward_rows(spark):
    docs, none = frames(spark)
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == docs.count() and substrings.remove_repeats(none).count() == 0
    assert [r.n_words for r in got if r.doc_id == 0] == [0]
    assert len({(r.n_words, r.n_removed) for r in got if r.doc_id == 5}) == 1  # repeated rows agree


def test_long_words_are_told_apart(spark):
    words = [f"w{i}" for i in range(30)]
    odd = ["a" + "x" * 4095 + "b", "b" + "x" * 4095 + "a", "a" + "x" * 9000, "x" * 4096 + "a" + "x" * 4904, "é" * 5000]
    rows = [(k, " ".join([*words[:19], w, *words[19:]])) for k, w in enumerate(odd)] + [(10 + k, " ".join([*words[:19], w, *words[19:]])) for k, w in enumerate(odd)]
    for group in (256, 2):
        compare(spark, rows, group)


def test_words_with_one_hash_are_compared(spark, monkeypatch):
    # every hash of a word is one of 64: groups mix, words don't
    init = Layout.__init__

    def weak(self, texts):
        init(self, texts)
        self.number = self.number & 63

    monkeypatch.setattr(Layout, "__init__", weak)
    layout = Layout(["aa bb cc aa dd " + " ".join(f"u{i}" for i in range(200)) + " aa u7"])
    exact, words = layout.exact(), layout.raw.split()
    assert all((exact[i] == exact[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(i))
    rows = planted(40, 5)
    one = [(0, 0, 0, 0, 20, 3, t.encode()) for _, t in rows if len(t.split()) >= 40][:12]
    cols = [[x[k] for x in one] for k in range(7)]
    import numpy as np

    for n in (1, 3):
        mask = substrings.subtree(np.zeros(len(one), np.int64), np.arange(len(one)), np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.full(len(one), n), np.full(len(one), 3), cols[6])
        seen, want = set(), []
        for x in cols[6]:
            keys = [tuple(x.split()[k : k + 20]) for k in range(n)]
            want.append(sum(1 << k for k, key in enumerate(keys) if (k, key) not in seen))
            seen |= set(enumerate(keys))
        assert mask.tolist() == want


def test_ten_thousand_repeated_rows(spark):
    text = " ".join(f"w{i % 37}" for i in range(60))
    rows = [(7, text)] * 10_000 + [(8, text), (3, "x " + text[:200])]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {r[0]: r[1:3] for r in brute([(3, "x " + text[:200]), (7, text), (8, text)])}
    assert got.count() == 10_002
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got.select("doc_id", "n_words", "n_removed").distinct().collect()} == {(i, *v) for i, v in want.items()}
