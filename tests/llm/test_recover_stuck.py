from assaykit.llm import fingerprints

from .test_fingerprints import pieces


def test_rows_that_never_peel_are_compared_exactly(spark):
    old, new = (" ".join(f"{side}{i}" for i in range(8 * 60)) + "\nshared line" for side in "ab")
    rows = [(1, old, new), (2, old, old + "\nmore")]
    got = {r.key: r for r in fingerprints.recover(spark.createDataFrame(rows, "key long, old string, new string"), cells=4, most=1).collect()}
    for key, a, b in rows:
        assert (len(got[key].removed), len(got[key].added)) == (len(pieces(a) - pieces(b)), len(pieces(b) - pieces(a)))
    assert got[1].cells is None and got[2].cells == 12
