"""Fingerprints hold every digest: likenesses are those of the whole sets, whatever the sizes."""

import random

import pytest
from pyspark.sql import functions as F

from assaykit.llm import fingerprints

from .test_fingerprints import next_of, pieces


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def long_text(rng, n):
    return "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(8)) for _ in range(n))


def test_likenesses_are_exact_for_long_and_unequal_texts(spark):
    rng = random.Random(4)
    rows = [(i, long_text(rng, n)) for i, n in enumerate((0, 1, 12, 13, 700, 30, 300, 24, 200, 200, 97))]
    rows += [(100, rows[4][1]), (101, rows[4][1] + "\nlast words"), (102, None)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    after = next_of(rows)
    for i, t in rows:
        t, n = t or "", after[i][1] or ""
        half = len(t) // 2
        assert got[i].near_edited == pytest.approx(jaccard(pieces(t), pieces(t[: len(t) - half] + n[:half])), abs=1e-12), i
        assert got[i].near_next == pytest.approx(jaccard(pieces(t), pieces(n)), abs=1e-12), i
    assert got[100].fingerprint == got[4].fingerprint != got[101].fingerprint
    assert 0.99 < got[101].near_next < 1  # one piece of 701


@pytest.mark.parametrize("load", [4, 20, 60])
def test_crowded_parts_lose_no_digest(spark, monkeypatch, load):
    monkeypatch.setattr(fingerprints, "LOAD", load)
    rng = random.Random(load)
    rows = [(i, t, "\n".join(t.split("\n")[k:] + [f"line {i}"])) for i, n, k in ((0, 55, 1), (1, 150, 75), (2, 240, 200), (3, 3, 3)) for t in [long_text(rng, n)]]
    frame = spark.createDataFrame(rows, "i long, a string, b string").withColumns({c + "_fp": fingerprints.fingerprint(F.col(c)) for c in "ab"})
    every = F.flatten(F.transform("a_fp.parts", fingerprints.listed))
    got = frame.select("i", F.sort_array(every).alias("listed"), F.sort_array(fingerprints.digests(F.col("a"))).alias("keys"), F.size(F.flatten("a_fp.parts.stash")).alias("stashed"), fingerprints.likeness(F.col("a_fp"), F.col("b_fp")).alias("near")).collect()
    assert all(r.listed == r["keys"] for r in got)
    assert load < 60 or any(r.stashed for r in got)
    for r in got:
        _, a, b = rows[r.i]
        assert r.near == pytest.approx(jaccard(pieces(a), pieces(b)), abs=1e-12), r.i
