import random

import numpy as np
import xxhash

from assaykit.llm import neardup
from assaykit.llm.components import components

from .cases import frames


def brute_print(text):
    words = (text or "").encode().translate(neardup.LOWER).split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (doc_id, fp); the smallest id reachable."""
    low = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for d, f in prints:
            for e, g in prints:
                if (f ^ g).bit_count() <= 3 and low[e] < low[d]:
                    low[d], changed = low[e], True
    return low


def test_fingerprints_match_brute_force(spark):
    docs, none = frames(spark)
    got = {(r.doc_id, r.fp & (1 << 64) - 1) for r in neardup.fingerprints(docs).collect()}
    assert got == {(r.doc_id, brute_print(r.text)) for r in docs.collect()}
    assert neardup.near_duplicates(none).count() == 0 and neardup.near_copies(none).count() == 0


def test_lower_bound_holds():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    distance = np.abs(neardup.embed(a).astype(int) - neardup.embed(b).astype(int)).sum(1)
    assert (distance <= np.bitwise_count(a ^ b)).all() and (neardup.manhattan(a, b) == distance).all()


def test_bound_comes_first(monkeypatch):
    prints = np.array(sorted(set(clustered(700, 21, 5))), np.uint64)
    whole = [(i, j) for i in range(len(prints)) for j in range(len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= 3]
    assert sorted(map(tuple, neardup.near_pairs(prints, prints, 3).tolist())) == whole
    # what the bound rejects is never compared bit by bit, so a bound that rejects all loses all
    assert (neardup.manhattan(prints[:, None], prints[None, :]) <= 3).sum() < 3 * len(whole)
    monkeypatch.setattr(neardup, "manhattan", lambda a, b: np.full(np.broadcast_shapes(a.shape, b.shape), 9))
    assert not len(neardup.near_pairs(prints, prints, 3)) and not neardup.forest(prints)


def clustered(n, seed, flips):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            out.append(base)
            for b in rng.sample(range(64), rng.randint(0, flips)):
                base ^= 1 << b
    return out[:n]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_nothing(spark):
    prints = sorted(set(clustered(300, 5, 5)))
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    rows = neardup.link_table(frame).selectExpr("a as u", "b as v")
    named = {r.node: r.component for r in components(rows).collect()}
    want = brute_components([(signed(p), p) for p in prints])
    groups = lambda of: sorted(sorted(k for k in of if of[k] == c) for c in set(of.values()))
    assert groups({signed(p): named.get(signed(p), signed(p)) for p in prints}) == groups(want)


def test_crowded_cells_keep_components():
    prints = np.array(sorted(set(clustered(1500, 8, 3))), np.uint64)

    def roots(links):
        parent = list(range(len(prints)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in links:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
        return [root(i) for i in range(len(prints))]

    old = neardup.CROWDED
    try:
        neardup.CROWDED = 10**9
        whole = roots(neardup.forest(prints))
        neardup.CROWDED = 64
        assert roots(neardup.forest(prints)) == whole
    finally:
        neardup.CROWDED = old


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200 and 7 in got


def edited(words, rng, share):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


def test_query_and_near_copies(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for g in range(40):
        words = [f"t{rng.randint(0, 900)}" for _ in range(rng.randint(80, 400))]
        for k in range(3):
            rows.append((g * 10 + k, " ".join(words if k == 0 else edited(words, rng, 0.012))))
            truth[g * 10 + k] = g
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = neardup.near_duplicates(docs).collect()
    want = brute_components([(d, brute_print(t)) for d, t in rows])
    assert {r.doc_id: r.component_id for r in exact} == want
    wide = {r.doc_id: r.component_id for r in neardup.near_copies(docs).collect()}
    shingles = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    near = [(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert len(near) > 40 and sum(wide[a] == wide[b] for a, b in near) >= 0.95 * len(near)
    assert all(truth[d] == truth[c] for d, c in wide.items())
    again = {r.doc_id: r.component_id for r in neardup.near_copies(docs.repartition(7)).collect()}
    assert again == wide


def test_crowds_of_near_copies_are_joined_alike_in_any_order(spark):
    rng = random.Random(11)
    base = [f"t{rng.randint(0, 900)}" for _ in range(300)]
    rows = [(i, " ".join(edited(base, rng, 0.01))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [{r.doc_id: r.component_id for r in neardup.near_copies(d).collect()} for d in (docs, docs.repartition(9, "text"))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    near = [[j for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    low, was = list(range(len(rows))), None
    while low != was:  # components of all pairs that share 0.8
        was, low = low, [min(low[j] for j in own) for own in near]
    assert runs[0] == runs[1] == dict(enumerate(low))


def test_awkward_rows(spark):
    docs, _ = frames(spark)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    low = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert low[9] == 8 and low[2] in (0, None)  # blank texts share the fingerprint zero
    assert len(neardup.near_copies(docs).collect()) == docs.count()
