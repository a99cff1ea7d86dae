import pytest
from pyspark.sql import functions as F

from assaykit.functions import abstracts
from assaykit.operators import links, preparation, workflow
from assaykit.sources import bundles


def records(spark):
    rows = [(f"r{i:02d}", f"p{i % 9}", float(i % 7), f"m{i % 3}" if i % 5 else None, float(i) if i % 4 else None, f"s{i}") for i in range(40)]
    rows += [("x1", "p1", 1.0, "m9", 2.0, "s1"), ("x2", "p2", 9.0, "m1", 2.0, "s2"), ("x3", "p0", 1.0, "m1", 2.0, "bad")]
    return spark.createDataFrame(rows, "id string, paper string, y double, metal string, t double, sample string")


TASK = preparation.Task("id", "paper", "y", ("paper", "sample"), ("t",), ("metal",), 0.2, 5)


def test_encoding_accounts_for_every_record(spark):
    made = preparation.build_encoding(records(spark), TASK, F.when(F.col("sample") == "bad", "has_issues"))
    reasons = {r.id: r.reason for r in made.excluded.collect()}
    assert reasons["x3"] == "has_issues" and reasons["x2"] == reasons["r02"] == "conflicting_values" and reasons["x1"] == "repeated_observation"
    assert made.rows.count() + len(reasons) == 43 and made.summary.first().n_usable == made.rows.count()
    # a token that only test groups have has no column
    train = {r.metal for r in made.rows.where("split <> 'test'").select("metal").distinct().collect()} - {None}
    assert {c[6:] for c in made.rows.columns if c.startswith("metal=")} == train
    groups = {s: {r.paper for r in made.rows.where(F.col("split") == s).collect()} for s in ("train", "test")}
    assert not groups["train"] & groups["test"] and groups["test"]


def test_bundles_are_checked(spark, tmp_path):
    made = preparation.build_encoding(records(spark), TASK, F.lit(None).cast("string"))
    bundles.write_encoding(spark, str(tmp_path / "e"), made, TASK)
    back = bundles.load_bundle(spark, str(tmp_path / "e"), "encoding")
    joined = back["mapping"].join(back["X"].drop("split"), "row_index").join(back["y"].drop("split"), "row_index")
    want = {(r.id, r.t, r.y) for r in made.rows.collect()}
    assert {(r.id, r.t, r.y) for r in joined.collect()} == want and back["excluded"].count() == made.excluded.count()
    with pytest.raises(ValueError, match="not a bundle"):
        bundles.load_bundle(spark, str(tmp_path / "e"), "fold")
    back["y"].withColumn("y", F.col("y") + 1).write.mode("overwrite").parquet(str(tmp_path / "z"))
    spark.read.parquet(str(tmp_path / "z")).write.mode("overwrite").parquet(str(tmp_path / "e/y"))
    with pytest.raises(ValueError, match="changed"):
        bundles.load_bundle(spark, str(tmp_path / "e"), "encoding")
    with pytest.raises(ValueError, match="lacks"):
        bundles.write_bundle(spark, str(tmp_path / "f"), "run", {"records": records(spark)})


def test_folds_use_their_training_part_alone(spark, tmp_path):
    made = preparation.build_encoding(records(spark), TASK, F.lit(None).cast("string"))
    from assaykit.operators import encode

    folds = encode.balanced_folds(made.rows.where("split = 'train'"), "paper", 3)
    bundles.write_fold(spark, str(tmp_path / "fold"), made.rows, folds, 1, TASK)
    back = bundles.load_bundle(spark, str(tmp_path / "fold"), "fold")
    papers = lambda part: {r.paper for r in back[f"{part}/mapping"].collect()}
    test = {r.paper for r in made.rows.where("split = 'test'").collect()}
    assert papers("train") and papers("validation") and not papers("train") & papers("validation") and not test & (papers("train") | papers("validation"))
    assert abs(back["train/X"].agg(F.avg("t")).first()[0]) < 1e-9


def test_other_bundles(spark, tmp_path):
    found = spark.createDataFrame([("r1", "T", "10.1/a", "target", 3.0), ("r2", "U", "", "review", 1.0)], "record_id string, title string, doi string, decision string, priority_score double")
    bundles.write_run(spark, str(tmp_path / "run"), found)
    bundles.write_screening(spark, str(tmp_path / "screening"), found)
    assert bundles.load_bundle(spark, str(tmp_path / "run"), "run")["dois"].count() == 1
    assert bundles.load_bundle(spark, str(tmp_path / "screening"), "screening")["review_template"].count() == 2
    exports = spark.createDataFrame([("s", "e1", 1), ("s", "e2", 2), ("t", "e3", 1)], "session string, export string, at int")
    points = spark.createDataFrame([("s", "e1", 1.0), ("s", "e2", 2.0), ("t", "e3", 3.0)], "session string, export string, y double")
    bundles.write_readings(spark, str(tmp_path / "readings"), exports, points)
    back = bundles.load_bundle(spark, str(tmp_path / "readings"), "readings")
    assert {r.y for r in back["points"].collect()} == {2.0, 3.0} and [r.export for r in back["skipped"].collect()] == ["e1"]
    goal = preparation.Goal("target_range", 0.0, 10.0, 4.0, 6.0)
    rows = spark.createDataFrame([("a", 5.0, "c", "p", "s"), ("b", None, "c", "p", "s"), ("d", 1.0, None, "q", "s")], "id string, v double, ctx string, paper string, sample string")
    scores = preparation.score_encoding(rows, "id", "v", ["ctx"], "paper", "sample", goal, {"v": [(F.col("v").isNotNull(), F.lit(True))]}, {"v": 1.0})
    bundles.write_scores(spark, str(tmp_path / "scores"), scores, "id")
    back = bundles.load_bundle(spark, str(tmp_path / "scores"), "scores")
    assert {r.id: r.reason for r in back["excluded"].collect()} == {"b": "no_value", "d": "incomplete_context"} and back["performance"].first().performance == 100.0
    done = workflow.handoff(spark.createDataFrame([("a", "", "s1", "reviewed", []), ("b", "10.1/x", "s2", "draft", ["no_unit"]), ("c", None, "s3", "excluded", [])], "id string, doi string, sha string, review_status string, issues array<string>"), "doi", "sha")
    bundles.write_handoff(spark, str(tmp_path / "handoff"), done, spark.createDataFrame([("e", "ratio")], "evidence string, kind string"))
    back = bundles.load_bundle(spark, str(tmp_path / "handoff"), "handoff")
    assert [r.split_group for r in back["ready"].collect()] == ["s1"] and [r.id for r in back["waiting"].collect()] == ["b"]
    bundles.write_project(spark, str(tmp_path / "project"), rows, rows, rows)
    assert bundles.load_bundle(spark, str(tmp_path / "project"), "project")["claims"].count() == 3


def test_revisions_go_up_once(spark):
    current = spark.createDataFrame([("a", 3), ("b", 0)], "key string, revision int")
    updates = spark.createDataFrame([("a", 3, 2), ("a", 3, 1), ("a", 2, 0), ("b", 1, 1), ("z", 0, 1)], "key string, base_revision int, at int")
    judged = workflow.apply_revisions(current, updates, "key", ["at"])
    assert {(r.key, r["at"]): r.outcome for r in judged.collect()} == {("a", 2): "conflict_raced", ("a", 1): "accepted", ("a", 0): "conflict_stale", ("b", 1): "conflict_stale", ("z", 1): "unknown_key"}
    assert {r.key: r.revision for r in workflow.next_revisions(current, judged, "key").collect()} == {"a": 4, "b": 0}


def test_repeated_points_keep_their_rows(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)] * 3 + [(1, 50.0, 0.0), (1, None, 1.0)], "page int, x double, y double")
    labels = spark.createDataFrame([(1, 3.0, 4.0, "near", 2), (1, -3.0, -4.0, "tie", 1), (2, 0.0, 0.0, "other page", 0)], "page int, x double, y double, name string, tie int")
    got = links.nearest_label(points, labels, ["page"], 10.0, "name", "tie").collect()
    assert sorted((r.label or "", r.distance or 0.0) for r in got) == [("", 0.0), ("", 0.0), ("tie", 5.0), ("tie", 5.0), ("tie", 5.0)]


def test_identity_and_abstracts(spark):
    page = "<meta property='citation_title' content='A Study of X'><section class=\"abstract\"><h2>Abstract</h2><p>" + "word " * 30 + "</p></section>"
    rows = spark.createDataFrame([(page, "10.1/a", "a study of x"), (page, "10.1/a", "another"), (page.replace("word </p>", "word…</p>"), "", "a study of x"), (None, None, None)], "html string, doi string, title string")
    got = [r[0] for r in rows.select(abstracts.publisher_abstract(F.col("html"), F.col("doi"), F.col("title"))).collect()]
    assert got[0] == " ".join(["word"] * 30) and got[1:] == [None, None, None]


def test_pdf_scans_take_a_reader_of_pages(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1.4 Low temperature reduction of oxides\nAbstract: It works well.\n\nIntroduction doi 10.1234/AB.1")
    (tmp_path / "in/b.pdf").write_bytes(b"<html>login</html>")
    (tmp_path / "in/deep/c.PDF").write_bytes(b"%PDF-1.4 One two three four 10.1234/x 10.1234/y")
    (tmp_path / "in/d.pdf").write_bytes((tmp_path / "in/a.pdf").read_bytes())
    pages = lambda content, most: [content[9:].decode()][:most]
    got = {r.source.rsplit("/", 1)[1]: r for r in bundles.screen_pdfs(spark, str(tmp_path / "in"), pages).collect()}
    assert (got["a.pdf"].doi, got["a.pdf"].title, got["a.pdf"].abstract) == ("10.1234/ab.1", "Low temperature reduction of oxides", "It works well.")
    assert "not a PDF" in got["b.pdf"].error and got["c.PDF"].doi == "10.1234/x"
    assert {r.source.rsplit("/", 1)[1] for r in bundles.local_pdf_run(spark, str(tmp_path / "in"), pages).collect()} == {"a.pdf", "b.pdf", "d.pdf"}
    intake = {r.path.rsplit("/", 1)[1]: r for r in bundles.pdf_intake(spark, str(tmp_path / "in"), True).collect()}
    assert intake["b.pdf"].state == "not_a_pdf" and (intake["a.pdf"].repeat, intake["d.pdf"].repeat) == (False, True) and intake["a.pdf"].n_copies == 2
