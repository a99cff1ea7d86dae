from pyspark.sql import functions as F

from assaykit.operators import records


def test_table_records_share_conditions_and_list_issues(spark):
    blocks = spark.createDataFrame([(1, "Cu-CHA", {"Conv": "95", "T": "473.15", "Note": "x"}), (2, None, {"Conv": ">95", "T": "bad"})], "id int, cat string, row map<string,string>")
    specs = spark.createDataFrame([("Conv", "nox_conversion", "%"), ("T", "temperature", "K")], "header string, property string, unit string")
    got = {r.id: r for r in records.table_records(blocks, specs, ["id"], "row", "cat").collect()}
    assert got[1].value == 95.0 and got[1].conditions["temperature"].value == 200.0 and got[1].issues == []
    assert got[2].value is None and got[2].issues == ["non_scalar_or_missing", "missing_catalyst", "condition_temperature_non_scalar_or_missing"]
    assert got[1].record_id != got[2].record_id and got[1].category == "performance"


def test_rows_never_share_conditions(spark):
    blocks = spark.createDataFrame([(1, "A", {"Conv": "1", "T": "473.15"}), (2, "B", {"Conv": "2", "T": "573.15"})], "id int, cat string, row map<string,string>")
    specs = spark.createDataFrame([("Conv", "nox_conversion", "%"), ("T", "temperature", "K")], "header string, property string, unit string")
    got = records.table_records(blocks, specs, ["id"], "row", "cat").collect()
    assert sorted((r.catalyst, round(r.conditions["temperature"].value)) for r in got) == [("A", 200), ("B", 300)]


def test_roles_and_merging(spark):
    rows = spark.createDataFrame([("k", ["e1"], {"e1": "context"}), ("k", ["e1", "e2"], {"e1": "value"})], "k string, ids array<string>, roles map<string,string>")
    r = records.merge_equal(rows, ["k"], "ids", "roles").first()
    assert r.ids == ["e1", "e2"] and r.roles == {"e1": "value", "e2": "value"} and r.n_merged == 2


def test_links_and_context(spark):
    owners = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["z"])], "id int, ids array<string>")
    evidence = spark.createDataFrame([("a", "reviewed"), ("b", "draft")], "evidence_id string, state string")
    got = {r.id: r.issues for r in records.linked_evidence(owners, evidence, "id", "ids", "evidence_id", "state").collect()}
    assert got == {1: ["evidence_not_reviewed"], 2: ["no_evidence"], 3: ["evidence_missing"]}


def test_near_places(spark):
    rows = [("k", 1, 0.0, 0.0), ("k", 2, 3.0, 0.0), ("k", 3, 10.0, 0.0), ("k", 4, 13.9, 0.5), ("m", 5, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "k string, ord int, x double, y double")
    assert sorted(r.ord for r in records.near_places(frame, ["k"], "ord", "x", "y", 4.0).collect()) == [1, 3, 5]


def test_plans_and_prompts(spark):
    frame = spark.createDataFrame([(1, "target"), (2, "target"), (3, "review"), (4, "non_target")], "id int, decision string")
    got = {r.id: r.eligibility for r in records.download_plan(frame, "id", "decision", [F.col("id")], 1).collect()}
    assert got == {1: "download", 2: "over_limit", 3: "awaiting_review", 4: "screened_out"}
    prompts = spark.range(1).select(records.review_prompts(F.array(F.lit("outlook"), F.lit("negation")))).first()[0]
    assert prompts == [records.PROMPTS["negation"], records.PROMPTS["outlook"]]
