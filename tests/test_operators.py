from pyspark.sql import functions as F

from assaykit.operators import dedup, encode, extract, geometry, merge, review, score, screening


def test_merge_bridge_is_one_way(spark):
    rows = [(1, None, "T one", 2020), (2, "10.1/a", "T one", 2020), (3, None, "T one", 2020), (4, "10.1/b", "T two", 2020), (5, None, "T two", 2020), (6, "10.1/c", "T one", 2020)]
    keyed = merge.bridged_key(spark.createDataFrame(rows, "ord int, doi string, title string, year int"), "doi", "title", "year", "ord")
    key = {r.ord: r.merge_key for r in keyed.collect()}
    assert key[1] == key[2] == key[3]  # the first record with a DOI joins the earlier one without
    assert key[4] != key[5] and key[6] not in (key[1], key[4])


def test_merges_take_the_first_filled(spark):
    rows = [(2, "k", "", ["b", "a"], {"x": "2"}), (1, "k", None, ["a"], {"x": "1", "y": "1"}), (3, "k", "v", None, None)]
    out = merge.merge_first(spark.createDataFrame(rows, "ord int, k string, s string, l array<string>, m map<string,string>"), ["k"], "ord", ["s"], ["l"], ["m"]).first()
    assert (out.s, out.l, out.m, out.n_merged) == ("v", ["a", "b"], {"x": "2", "y": "1"}, 3)
    longest = merge.merge_longest(spark.createDataFrame([(1, "k", "aa"), (2, "k", "bb"), (3, "k", "c")], "ord int, k string, t string"), ["k"], "ord", "t", []).first()
    assert (longest.t, longest.t_from) == ("aa", 1)


def test_input_order_does_not_matter(spark):
    rows = [(i, f"k{i % 7}", f"v{i}" if i % 3 else "", [f"t{i % 5}"]) for i in range(200)]
    frame = spark.createDataFrame(rows, "ord int, k string, s string, l array<string>")
    a = merge.merge_first(frame, ["k"], "ord", ["s"], ["l"])
    b = merge.merge_first(frame.orderBy(F.rand(3)).repartition(5), ["k"], "ord", ["s"], ["l"])
    assert sorted(a.collect()) == sorted(b.collect())


def test_screening_decisions(spark):
    groups = {"a": "alpha", "b": "beta"}
    frame = spark.createDataFrame([("alpha beta", "x"), ("alpha", "x"), ("none", "x"), ("none", "")], "t string, abstract string")
    out = screening.concept_groups(frame, "t", groups, F.col("abstract")).collect()
    assert [r.decision for r in out] == ["target", "review", "non_target", "review"] and out[1].missing == ["b"] and out[1].coverage == 0.5


def test_priority_does_not_change_decisions(spark):
    frame = spark.createDataFrame([("alpha beta",), ("beta",)], "t string")
    for weights in ({"a": 1, "b": 1}, {"a": 9, "b": 1}):
        got = frame.withColumns(screening.priority_score([F.col("t")], {"a": "alpha", "b": "beta"}, weights)).collect()
        assert got[0].priority_score == 100.0 and got[1].priority_score == round(100 * weights["b"] / sum(weights.values()), 2)


def test_claims(spark):
    text = "Conversion increased by 12 % compared with Cu. It may improve. It did not improve. The rate was three times higher than before."
    none = screening.ClaimProfile(report="zzz", amounts=(), kinds=(), against="zzz()")
    assert screening.claims(spark.createDataFrame([(text,)], "t string"), "t", none).count() == 0
    got = {r.sentence_no: r for r in screening.claims(spark.createDataFrame([(text,)], "t string"), "t").collect()}
    assert [got[k].statement_type for k in range(4)] == ["reported_comparison", "prospective_claim", "negated_statement", "reported_comparison"]
    assert (got[0].amount, got[0].amount_unit, got[0].comparator) == (12.0, "%", "Cu") and (got[3].amount, got[3].amount_unit) == (3.0, "fold")


def test_feature_pivot_ignores_rejected_values(spark):
    rows = [("p", "c", "cu", 0.48, "approved"), ("p", "c", "cu", 0.9, "rejected"), ("p", "c", "al", 1.0, "approved"), ("p", "c", "al", 2.0, "pending"), ("q", "c", "cu", 1.0, "pending")]
    out = {(r.paper, r.cat): r for r in encode.feature_pivot(spark.createDataFrame(rows, "paper string, cat string, prop string, value double, status string"), ["paper", "cat"], "prop", "value", "status", F.lit(True), ["cu", "al"]).collect()}
    assert out[("p", "c")].feature_cu == 0.48 and out[("p", "c")].feature_al is None and out[("p", "c")].ambiguous == ["al"] and out[("q", "c")].ambiguous == ["cu"]


def test_training_gate(spark):
    row = spark.createDataFrame([("performance", "no_conversion", "approved", 1.0, "c", None), ("performance", "t50", "approved", 1.0, "c", None)], "category string, prop string, status string, value double, subject string, temperature double")
    gate = review.training_gate(F.col("category"), F.col("prop"), F.col("status"), F.array().cast("array<string>"), F.col("value"), F.col("subject"), F.col("temperature"))
    assert [r.g for r in row.select(gate.alias("g")).collect()] == ["missing_temperature", "ml"]


def test_split_and_folds(spark):
    frame = spark.createDataFrame([(f"g{i % 13}", i) for i in range(200)], "g string, i int")
    split = encode.group_split(frame, "g", 0.25, 5)
    assert split.where("split = 'test'").count() == 4 and encode.leaks(frame.join(split, "g"), "g").count() == 0
    assert {r.split for r in encode.group_split(frame, "g", 0.25, 50).collect()} == {"preview"}
    folds = encode.balanced_folds(frame, "g").collect()
    sizes = {}
    for r in folds:
        sizes[r.fold] = sizes.get(r.fold, 0) + r.n_rows
    assert len(folds) == 13 and len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 16
    assert encode.balanced_folds(frame.where("g IN ('g1', 'g2')"), "g").count() == 0


def test_fold_statistics_see_training_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    stats = encode.fold_statistics(train, ["x"])
    r = stats.first()
    assert (r.x_median, r.x_mean) == (2.0, 2.0) and abs(r.x_scale - (2 / 3) ** 0.5) < 1e-12
    out = encode.transform(spark.createDataFrame([(None,), (100.0,)], "x double"), stats, ["x"]).collect()
    assert out[0].x == 0.0 and out[0]["x__missing"] == 1 and out[1].x > 100
    flat = encode.fold_statistics(spark.createDataFrame([(5.0,), (5.0,)], "x double"), ["x"]).first()
    assert flat.x_scale == 1.0


def test_encodings(spark):
    frame = spark.createDataFrame([(1, "a", ["x", "q"]), (2, None, None), (3, "z", [])], "id int, c string, l array<string>")
    long = {(r.id, r.column): r.value for r in encode.encode_long(frame, "id", "c", ["a", "b"]).collect()}
    assert long[(1, "c=a")] == 1 and long[(2, "c__missing")] == 1 and long[(3, "c__unknown")] == 1 and long[(2, "c__unknown")] == 0
    wide = {r.id: r for r in encode.encode_wide(frame, "l", ["x"]).collect()}
    assert wide[1]["l=x"] == 1 and wide[1]["l__unknown"] == 1 and wide[3]["l__missing"] == 0 and wide[2]["l__missing"] == 1


def test_aligned_index_is_dense(spark):
    frame = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "k int")
    got = encode.aligned_index(frame, ["k"], 5).collect()
    assert all(r.k == r.row_index for r in got)


def test_overlaps_and_nearest(spark):
    a = spark.createDataFrame([("d", "a1", 0, 100), ("d", "a2", 1190, 2500), ("e", "a3", 0, 10)], "doc string, id string, start int, end int")
    b = spark.createDataFrame([("d", 50, 60), ("d", 1100, 1300), ("d", 2499, 2600), ("e", 10, 20)], "doc string, b_start int, b_end int")
    assert sorted((r.id, r.b_start) for r in dedup.overlaps(a, b, ["doc"]).collect()) == [("a1", 50), ("a2", 1100), ("a2", 2499)]
    runs = dedup.islands(spark.createDataFrame([("k", d) for d in (1, 2, 4, 8, 9)], "k string, d int"), ["k"], "d", 1).collect()
    assert sorted((r.run_start, r.run_end, r.n_places) for r in runs) == [(1, 4, 3), (8, 9, 2)]


def test_observation_codes(spark):
    rows = [("s1", "p", "o1", "x", "e1", 1.0, "v1"), ("s1", "p", "o1", "x", "e1", 1.0, "v1"), ("s2", "p", "o2", "x", "e2", 1.0, "v2"), ("s2", "p", "o3", "x", "e2", 2.0, "v3"), ("s3", "p", "o4", "x", "e4", 1.0, "v4"), ("s3", "q", "o5", "x", "e5", 1.0, "v5"), ("s4", "p", "o6", "x", "e6", 1.0, "v6"), ("s4", "p", "o7", "x", "e7", 1.0, "v6"), ("s5", "p", "o8", "x", "e8", 1.0, "v8"), ("s5", "p", "o8", "y", "e8", 1.0, "v8")]
    frame = spark.createDataFrame(rows, "source string, paper string, observation string, content string, experiment string, y double, evidence string")
    codes = [(r.observation, r.codes) for r in dedup.observation_codes(frame, "source", "paper", "observation", "content", ["experiment"], "y", "evidence").collect()]
    assert ("o1", []) in codes and ("o1", ["repeated_record"]) in codes
    by = dict(codes)
    assert by["o2"] == by["o3"] == ["conflicting_experiment"] and by["o4"] == by["o5"] == ["conflicting_source_doi"]
    assert by["o6"] == by["o7"] == ["reused_value_evidence"] and by["o8"] == ["conflicting_record_copy"]


def test_geometry_and_scores(spark):
    ticks = spark.createDataFrame([("lin", float(i), 2.0 * i + 1) for i in range(4)] + [("log", float(i), 10.0**i) for i in range(4)] + [("few", 0.0, 1.0), ("few", 1.0, 2.0)], "k string, p double, v double")
    assert {r.k: r.scale for r in geometry.tick_fit(ticks, ["k"], "p", "v").collect()} == {"lin": "linear", "log": "log", "few": "none"}
    yes, no = F.lit(True), F.lit(False)
    q = spark.range(1).select(score.completeness({"a": [(yes, yes), (no, yes)], "b": [(no, no)]}, {"a": 3, "b": 1})["quality_score"]).first()[0]
    assert q == 37.5


def test_state_and_breaker(spark):
    events = spark.createDataFrame([("u", 1, "a"), ("u", 3, "c"), ("u", 2, "error"), ("v", 1, "b")], "k string, at int, what string")
    assert {(r.k, r.what, r.n_events) for r in review.latest(events, ["k"], ["at"], ["what"]).collect()} == {("u", "c", 3), ("v", "b", 1)}
    assert {(r.k, r["at"]) for r in review.breaker(events, ["k"], ["at"], F.col("what") == "error").where("deferred").collect()} == {("u", 3)}


def test_carry_over(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "id int, x string")
    old = spark.createDataFrame([(1, "a", "reviewed"), (2, "z", "reviewed"), (3, "c", "reviewed"), (4, None, "draft")], "id int, x string, review_status string")
    assert {r.id: r.review_status for r in merge.carry_over(new, old, "id", ["x"]).collect()} == {1: "reviewed", 2: "unreviewed", 3: "stale", 4: "draft"}


def test_numeric_facts_and_relations(spark):
    text = "The NO conversion exceeded 95 % at 250 °C. In previous work the BET surface area was 450-500 m2/g. Fig. 3 shows 12.5 ± 0.5 nm particles.\nReferences\nSmith, 40 % yield."
    facts = extract.numeric_facts(text)
    assert [(f["operator"], f["value"], f["value_high"], f["unit"]) for f in facts] == [("gt", 95.0, None, "%"), ("eq", 250.0, None, "°C"), ("range", 450.0, 500.0, "m²/g"), ("eq", 12.5, None, "nm")]
    assert all(text[f["start"] : f["end"]] == f["quote"] for f in facts) and facts[2]["scope"] == "prior_work" and facts[3]["uncertainty"] == 0.5
    story = "Conversion increased by 12 % after aging. Activity was 3 times higher than that of Cu. The rate rose by 2 fold. This is attributed to dispersion. It did not lead to loss."
    found = extract.relations(story)
    kinds = [r["kind"] for r in found]
    assert {"relative_change", "ratio", "ambiguous_fold_change", "causal"} <= set(kinds)
    assert all(story[r["start"] : r["end"]] == r["quote"] for r in found)
    rows = extract.fact_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t")
    assert rows.count() == len(facts)


def test_views_keep_offsets():
    text = "cata-\nlyst with ﬁne  grains"
    view = extract.View(text)
    assert view.text == "catalyst with fine grains"
    a, b = view.span(0, 8)
    assert text[a:b] == "cata-\nlyst"
    assert extract.glossary_matches("SCR and NH3-SCR", {"SCR": "scr", "NH3-SCR": "nh3"}) == [(0, 3, "scr"), (8, 15, "nh3")]


def test_pluggable_model_quotes_are_checked(spark):
    def model(texts):
        return [[{"start": 0, "end": 3, "quote": t[:3], "label": "good"}, {"start": 0, "end": 3, "quote": "zzz", "label": "made up"}] for t in texts]

    got = extract.model_rows(spark.createDataFrame([(1, "abcdef")], "k int, t string"), "k", "t", model).collect()
    assert [(r.quote, r.label) for r in got] == [("abc", "good")]


def test_further_scanners(spark):
    docs = spark.createDataFrame([(1, "Intro.\nTable 2. Results\nA 1\nB 2\n\nThe BET surface area of Cu-CHA was 510 m2/g."), (2, None)], "k int, t string")
    assert [r.quote for r in extract.passage_rows(docs, "k", "t").collect()] == ["Table 2. Results\nA 1\nB 2"]
    r = extract.statement_rows(docs, "k", "t", {"bet_surface_area": r"surface area of (?P<sample>[\w-]+) was (?P<value>\d+) (?P<unit>m2/g)"}).first()
    assert (r.property, r["sample"], r.value, r.unit) == ("bet_surface_area", "Cu-CHA", 510.0, "m²/g")
    assert [r.entry for r in extract.glossary_rows(docs, "k", "t", {"BET": "bet", "BET surface area": "area"}).collect()] == ["area"]
    titles = spark.createDataFrame([("A Title!", "a title"), ("A title", "other words"), (None, "x")], "a string, b string")
    got = [r.x for r in titles.select(extract.title_likeness_column(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == 1.0 and got[1] < 0.6 and got[2] == 0.0


def test_table_functions(spark):
    extract.register_table_functions(spark)
    docs = spark.createDataFrame([(1, "One here. Two is 5 nm. ")], "k int, t string")
    docs.createOrReplaceTempView("scanned_docs")
    assert spark.sql("SELECT k, s.start FROM scanned_docs, LATERAL sentence_spans(t) s").count() == 2
    assert spark.sql("SELECT f.value FROM scanned_docs, LATERAL numeric_facts(t) f").first().value == 5.0


def test_nearest_points(spark):
    points = spark.createDataFrame([("k", 1, 10), ("k", 2, 30), ("k", 3, 30), ("k", 4, 50), ("m", 5, 0)], "k string, id int, x int")
    targets = spark.createDataFrame([("k", 20), ("k", 30), ("k", 99), ("m", 7), ("z", 1)], "k string, target int")
    got = {(r.k, r.target): r.near_id for r in dedup.nearest(points, targets, ["k"], "x", "target", "id", []).collect()}
    assert got == {("k", 20): 1, ("k", 30): 2, ("k", 99): 4, ("m", 7): 5}


def test_null_keys_are_groups(spark):
    rows = spark.createDataFrame([("a", "target", 1.0), (None, "review", 5.0), (None, "target", 2.0)], "source string, decision string, v double")
    got = {r.source: (r.n_target, r.n_review, r.top) for r in screening.decision_counts(rows, ["source"], more={"top": F.max("v")}).collect()}
    assert got == {"a": (1, 0, 1.0), None: (1, 1, 5.0)}


def test_decisions_on_one_key_do_not_multiply_records(spark):
    records = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "id string")
    made = spark.createDataFrame([("r1", "target"), ("r1", "target"), ("r2", "target"), ("r2", "review"), (None, "target")], "id string, decision string")
    assert {r.id: r.manual_decision for r in review.apply_decisions(records, made, ["id"]).collect()} == {"r1": "target", "r2": None, "r3": None}
    assert review.apply_decisions(records, made, ["id"]).count() == 3


def test_folds_of_many_groups_are_dealt_in_a_stream(spark):
    rows = spark.range(20_000).selectExpr("id % 7001 as g")
    got = encode.balanced_folds(rows, "g").groupBy("fold").agg(F.sum("n_rows").alias("n")).collect()
    assert len(got) == 5 and max(r.n for r in got) - min(r.n for r in got) <= 3
    assert encode.balanced_folds(spark.range(9).selectExpr("id % 2 as g"), "g").count() == 0


def test_long_texts_are_scanned_whole(spark):
    from assaykit.operators import extract

    text = "Nothing is said here. " * 110_000 + "The conversion reached 93 % at 250 °C."
    found = extract.fact_rows(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()
    assert {(r.value, r.unit) for r in found} == {(93.0, "%"), (250.0, "°C")} and all(text[r.start : r.end] == r.quote for r in found)


def test_views_join_what_a_line_break_parts():
    from assaykit.operators.extract import View

    text = "over SAPO-\n34 and a conver-\nsion of 5 ◦C, ﬁne"
    view = View(text)
    assert view.text == "over SAPO-34 and a conversion of 5 °C, fine"
    a = view.text.index("conversion")
    assert text[slice(*view.span(a, a + 10))] == "conver-\nsion"


def test_clauses_part_only_between_two_metrics():
    from assaykit.operators import semantics as S

    cut = lambda t: [t[a:b] for a, b in S.clauses(t, S.PLAIN)]
    assert cut("conversion was 80 %, and the selectivity fell") == ["conversion was 80 %", "the selectivity fell"]
    assert cut("conversion and selectivity were high") == ["conversion and selectivity were high"]
    assert cut("not only the conversion but the yield rose") == ["not only the conversion but the yield rose"]
    assert cut("the conversion rose whereas the yield fell") == ["the conversion rose", "the yield fell"]
    assert cut("cooled, dried and the yield was 5 %") == ["cooled, dried and the yield was 5 %"]


def test_numbers_that_say_none():
    from assaykit.operators.extract import numeric_facts

    found = lambda t: [(f["value"], f["value_high"], f["issues"]) for f in numeric_facts(t)]
    assert found("it was 5 × 10 % then") == [(None, None, ["power_of_ten"])]
    assert found("it was 3 h / min then") == [(None, None, ["compound_unit"])]
    assert found("from 10 °C to 20 % then")[1:] == [(None, None, ["mixed_units"])]
    assert found("10, 20 and 30 % then") == [(None, None, ["part_of_a_list"])]
    assert found("between 10 and 30 % then") == [(10.0, 30.0, [])]
