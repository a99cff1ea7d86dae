import random

import pytest

from assaykit.llm import neardup

KINDS = ("block", "appended", "scattered")


def edit(words, kind, share, rng):
    n, new = int(len(words) * share), lambda k: [f"n{rng.randint(0, 10**6)}" for _ in range(k)]
    if kind == "block":
        at = rng.randint(0, len(words) - n)
        return words[:at] + new(n) + words[at + n :]
    if kind == "appended":
        return words + new(n)
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = new(1)[0]
    return out


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def pairs(count, lengths, seed=3):
    """doc_id, text rows in pairs 2k, 2k + 1, and (kind, likeness) of every pair."""
    rng, rows, truth = random.Random(seed), [], []
    shares = {"block": (0.06, 0.25), "appended": (0.1, 0.5), "scattered": (0.01, 0.08)}
    for k in range(count):
        kind = KINDS[k % 3]
        words = [f"t{rng.randint(0, 10**6)}" for _ in range(rng.randint(*lengths))]
        other = edit(words, kind, rng.uniform(*shares[kind]), rng)
        a, b = shingles(words), shingles(other)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        truth.append((kind, len(a & b) / len(a | b)))
    return rows, truth


@pytest.mark.parametrize("lengths", [(150, 600), (20, 60)])
def test_pairs_are_linked_at_the_threshold_and_not_below(spark, lengths):
    rows, truth = pairs(900, lengths)
    got = {r.doc_id: r.component_id for r in neardup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [got[2 * k] == got[2 * k + 1] for k in range(len(truth))]
    for kind in KINDS:
        of = {name: [x for x, (own, j) in zip(linked, truth) if own == kind and low <= j < high] for name, low, high in (("0.6-0.8", 0.6, 0.8), ("0.8-0.9", 0.8, 0.9))}
        print(lengths, kind, {name: f"{sum(x)} of {len(x)}" for name, x in of.items()})
    assert all(got[2 * k] == 2 * k for k in range(len(truth)))
    assert not any(x for x, (_, j) in zip(linked, truth) if j < 0.8)
    for kind in KINDS:
        of = [x for x, (own, j) in zip(linked, truth) if own == kind and 0.8 <= j < 0.9]
        assert len(of) > 5 and sum(of) >= 0.97 * len(of), kind


@pytest.mark.parametrize("passing", [7, 128])
def test_a_crowd_has_the_components_of_all_its_pairs(spark, monkeypatch, passing):
    monkeypatch.setattr(neardup, "PASSING", passing)
    rng = random.Random(11)
    base = [f"t{rng.randint(0, 900)}" for _ in range(300)]
    rows = []
    for i in range(150):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 999)) if rng.random() < 0.01 else w for w in base]
        rows.append((i, words))
    sets, want = [shingles(w) for _, w in rows], list(range(150))
    changed = True
    while changed:
        changed = False
        for i in range(150):
            for j in range(150):
                if want[i] < want[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    want[j], changed = want[i], True
    docs = [(i, " ".join(w)) for i, w in rows]
    found = neardup.near_copies(spark.createDataFrame(docs + docs[:9], "doc_id long, text string"))  # some rows twice
    assert found.count() == 159
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert [got[i] for i in range(150)] == want
