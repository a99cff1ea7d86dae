"""What a fingerprint costs: its sketch is peeled once, and only differences are peeled besides."""

from pyspark.sql import functions as F

from assaykit.llm import fingerprints

from .cases import frames
from .test_fingerprints import texts


def test_no_fingerprint_is_peeled_twice(spark, monkeypatch):
    peeled, peel = [], fingerprints.peel
    monkeypatch.setattr(fingerprints, "peel", lambda *args: peeled.append(1) or peel(*args))
    fingerprints.fingerprint_edits(frames(spark)[0])
    assert len(peeled) == 4  # two fingerprints and two differences; 12 when likenesses peeled them again


def test_kept_digests_are_those_that_the_cells_give(spark):
    frame = spark.createDataFrame(texts(25, 8), "i long, text string").select(F.explode(fingerprints.fingerprint(F.col("text"))["parts"]).alias("p"))
    again = fingerprints.peel(F.col("p.cells"), fingerprints.PART_CELLS)
    got = frame.select(F.sort_array("p.found").alias("kept"), F.sort_array(fingerprints.keys_of(again["found"])).alias("given"), fingerprints.empty(again["cells"]).alias("whole")).collect()
    assert len(got) > 50 and all(r.kept == r.given and r.whole for r in got)
