import pytest
from pyspark.sql import functions as F

from assaykit.functions import numeric as N
from assaykit.functions import text as X


def one(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in frame.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_norm_and_titles(spark):
    assert one(spark, ["NO₂ ", "10⁻³", None], X.norm) == ["NO2", "10-3", None]
    assert one(spark, ["A  Title: (x)!", None], X.title_key) == ["a title x", ""]


def test_doi_variants(spark):
    raw = ["https://doi.org/10.1000/AB.", "doi: 10.1000/x;", "http://dx.doi.org/10.1000%2Fy", "not one", None]
    assert one(spark, raw, X.doi_harvest)[:2] == ["10.1000/ab", "10.1000/x"]
    assert one(spark, raw, X.doi_screening)[0] == "10.1000/ab."
    assert one(spark, raw, X.doi_canonical) == ["10.1000/ab", "10.1000/x", "10.1000/y", "", ""]
    assert one(spark, ["see 10.1000/a, 10.1000/b. and 10.1000/a"], X.doi_all) == [["10.1000/a", "10.1000/b"]]
    with pytest.raises(Exception, match="not a DOI"):
        one(spark, ["nonsense"], X.doi_strict)


@pytest.mark.parametrize(
    ("raw", "unit", "target", "value", "issue"),
    [
        ("473.15", "K", "degC", 200.0, None), ("1000", "μmol/g", "mmol/g", 1.0, None), (">95", "%", "%", None, "non_scalar_or_missing"), ("90-100", "%", "%", None, "non_scalar_or_missing"),
        ("95 ± 2", "%", "%", None, "non_scalar_or_missing"), ("", "%", "%", None, "non_scalar_or_missing"), ("NaN", "%", "%", None, "non_scalar_or_missing"), ("=A2*2", "%", "%", None, "non_scalar_or_missing"),
        ("101", "%", "%", None, "out_of_range"), ("5", "", "nm", None, "unknown_unit"), ("1.88(7)", "Å", "Å", 1.88, None), ("30,000", "h-1", "h^-1", 30000.0, None), ("1e400", "nm", "nm", None, "non_finite"),
        ("90", "min", "h", 1.5, None), ("-1", "nm", "nm", None, "out_of_range"), (None, "nm", "nm", None, "non_scalar_or_missing"),
    ],
)
def test_quantity(spark, raw, unit, target, value, issue):
    row = spark.createDataFrame([(raw, unit, target)], "r string, u string, t string").select(N.quantity(F.col("r"), F.col("u"), F.col("t")).alias("q")).first().q
    assert row.issue == issue and (row.value is None if value is None else abs(row.value - value) < 1e-9)


def test_headers(spark):
    got = [(a, b) for a, b in zip(one(spark, ["CNª", "R b(Å)", "NO Conversion (%)"], lambda c: X.header_parts(c)[0]), one(spark, ["CNª", "R b(Å)", "NO Conversion (%)"], lambda c: X.header_parts(c)[1]))]
    assert got == [("cn", ""), ("r", "å"), ("no conversion", "%")]


def test_calibration_and_targets(spark):
    rows = spark.createDataFrame([(250.0, 400.0, 100.0, 0.0, 100.0, False), (50.0, 0.0, 100.0, 1.0, 100.0, True), (5.0, 3.0, 3.0, 0.0, 1.0, False), (5.0, 0.0, 10.0, 0.0, 10.0, True)], "p double, a double, b double, v double, w double, l boolean")
    got = [r.x for r in rows.select(N.calibrate(*[F.col(c) for c in "pabvwl"]).alias("x")).collect()]
    assert abs(got[0] - 50) < 1e-9 and abs(got[1] - 10) < 1e-9 and got[2:] == [None, None]
    y = spark.createDataFrame([(80.0, "%", False), (0.8, "fraction", False), (-96.4853321233100184, "kJ/mol", True), (101.0, "%", False), (-1.0, "s^-1", False)], "v double, u string, e boolean").select(N.standard_target(F.col("v"), F.col("u"), F.col("e")).alias("s")).collect()
    assert [r.s.y for r in y] == [0.8, 0.8, -1.0, None, None]


def test_text_helpers(spark):
    assert one(spark, ["A b. C d? e! f。g"], X.sentences) == [["A b.", "C d?", "e!", "f。", "g"]]
    assert one(spark, ["=1+1", " -x", "plain", "\tx"], X.csv_guard) == ["'=1+1", "' -x", "plain", "'\tx"]
    assert one(spark, ["http://a.example.com/x", "http://user@b.example.com", "ftp://c.example.com", "http://localhost/", "nothing"], X.url_valid) == [True, False, False, False, False]
    assert one(spark, ["key=secret&x=1"], X.safe_error) == ["key=[redacted]&x=1"]
    assert one(spark, ["<b>a &amp; b</b>—c"], X.plain_text) == ["a & b -c"]
    assert one(spark, ["in 1998 or 2004", "none"], N.year) == [1998, None]
    assert one(spark, ["three", "2.5", "x"], N.spoken_number) == [3.0, 2.5, None]


def test_inverted_index(spark):
    frame = spark.createDataFrame([(1, "a b a c"), (2, "x")], "k int, t string")
    index = X.inverted(frame, ["k"], "t")
    assert {r.k: r.t for r in index.select("k", X.revert_strict(F.col("index")).alias("t")).collect()} == {1: "a b a c", 2: "x"}
    odd = spark.createDataFrame([(1, {"a": [0], "b": [2]}), (2, {"a": [0], "b": [0]})], "k int, m map<string,array<int>>")
    assert [r.x for r in odd.orderBy("k").select(X.revert_strict(F.col("m")).alias("x")).collect()] == [None, None]
    assert odd.where("k = 1").select(X.revert(F.col("m"))).first()[0] == "a b"


def test_spans(spark):
    rows = spark.createDataFrame([("a😀bc", 1, 3, "😀b"), ("abc", 1, 9, "bc"), ("abc", 2, 2, ""), ("abc", None, 1, "a")], "t string, a int, b int, q string")
    assert [r.x for r in rows.select(X.span_ok(*[F.col(c) for c in "tabq"]).alias("x")).collect()] == [True, False, False, False]
