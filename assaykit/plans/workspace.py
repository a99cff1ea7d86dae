"""Queries of measurement records, evidence links and reviews, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import records, screening
from .screening import table

SPECS = [("qty", "no_conversion", "%"), ("disc", "loading", "wt%"), ("temp", "temperature", "K"), ("line", "unknown_property", "")]


def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 7 != 0, F.col("l_returnflag")).alias("cat"), F.create_map(F.lit("qty"), (F.col("l_quantity") * 3).cast("int").cast("string"), F.lit("disc"), F.when(F.col("l_tax") > 0.05, F.lit(">5")).otherwise(F.lit("7")), F.lit("temp"), (F.col("l_linenumber") * 100).cast("string"), F.lit("line"), F.lit("x")).alias("row"))
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("cat").alias("cat"), F.min_by("row", F.col("row")["qty"].cast("int") * 10 + F.length(F.col("row")["disc"])).alias("row"))
    specs = spark.createDataFrame(SPECS, "header string, property string, unit string")
    out = records.table_records(rows, specs, ["l_orderkey", "l_linenumber"], "row", "cat")
    return out.select("l_orderkey", "l_linenumber", "property", "category", "raw_value", "value", N.round_half_up(F.col("conditions")["temperature"]["value"], 2).alias("temperature"), F.array_join("issues", ",").alias("issues"))


_RECORDS = """
WITH r AS (SELECT l_orderkey, l_linenumber, min(CASE WHEN l_suppkey % 7 <> 0 THEN l_returnflag END) AS cat,
  min_by(struct_pack(q := CAST(CAST(l_quantity * 3 AS INTEGER) AS VARCHAR), d := CASE WHEN l_tax > 0.05 THEN '>5' ELSE '7' END), CAST(l_quantity * 3 AS INTEGER) * 10 + CASE WHEN l_tax > 0.05 THEN 2 ELSE 1 END) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (SELECT l_orderkey, l_linenumber, cat, 'no_conversion' AS property, 'performance' AS category, s.q AS raw_value, CASE WHEN CAST(s.q AS INTEGER) > 100 THEN NULL ELSE CAST(s.q AS DOUBLE) END AS value, CASE WHEN CAST(s.q AS INTEGER) > 100 THEN 'out_of_range' END AS issue FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, cat, 'loading', 'composition', s.d, TRY_CAST(s.d AS DOUBLE), CASE WHEN s.d = '>5' THEN 'non_scalar_or_missing' END FROM r)
SELECT l_orderkey, l_linenumber, property, category, raw_value, value, floor((l_linenumber * 100 - 273.15) * 100 + 0.5) / 100 AS temperature,
  concat_ws(',', issue, CASE WHEN coalesce(cat, '') = '' THEN 'missing_catalyst' END) AS issues FROM c
"""


def linked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") + F.when(F.col("o_orderkey") % 13 == 0, 10_000_000).otherwise(0)).alias("ids"))
    evidence = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.when(F.col("o_orderstatus") == "O", "reviewed").otherwise("draft").alias("state"))
    out = records.linked_evidence(owners, evidence, "o_custkey", "ids", "evidence_id", "state")
    return out.withColumn("issues", F.array_join("issues", ","))


_LINKED = """
WITH l AS (SELECT DISTINCT o_custkey, o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 10000000 ELSE 0 END AS e FROM orders),
g AS (SELECT l.o_custkey, count(*) AS n_evidence, count(o.o_orderkey) AS n_found, count(*) FILTER (o.o_orderstatus = 'O') AS n_reviewed FROM l LEFT JOIN orders o ON o.o_orderkey = l.e GROUP BY l.o_custkey)
SELECT *, concat_ws(',', CASE WHEN n_found < n_evidence THEN 'evidence_missing' END, CASE WHEN n_reviewed < n_found THEN 'evidence_not_reviewed' END) AS issues FROM g
"""


def packet_versus_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = docs.where("lang <> 'de'").select("doc_id", "lang", "source")
    right = docs.where("n_chars >= 300").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"))
    return records.same_rows(left, right, ["doc_id"], ["lang", "source"])


_PACKET = """
SELECT doc_id, CASE WHEN lang = 'de' THEN 'only_right' WHEN n_chars < 300 THEN 'only_left' WHEN doc_id % 5 = 0 AND source IS NOT NULL THEN 'changed' ELSE 'equal' END AS state FROM documents WHERE lang <> 'de' OR n_chars >= 300
"""


def rebind_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit("A").alias("l_returnflag"))
    points = table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    return records.rebind_unique(drafts, points, ["l_partkey", "l_returnflag"], "l_orderkey").select("l_partkey", "n_matches", "l_orderkey")


_REBIND = """
SELECT p_partkey AS l_partkey, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN o END AS l_orderkey FROM part LEFT JOIN
  (SELECT l_partkey, count(*) AS n, min(l_orderkey) AS o FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'A' GROUP BY l_partkey) ON p_partkey = l_partkey
"""


def merge_equal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.array(F.col("l_suppkey").cast("string")).alias("ids"), F.create_map(F.col("l_suppkey").cast("string"), F.when(F.col("l_returnflag") == "A", "value").otherwise("context")).alias("roles"))
    out = records.merge_equal(rows, ["l_partkey", "l_quantity"], "ids", "roles").where("n_merged > 1")
    return out.select("l_partkey", "l_quantity", "n_merged", F.array_join("ids", ",").alias("ids"), F.array_join(F.transform("ids", lambda i: F.element_at(F.col("roles"), i)), ",").alias("roles"))


_EQUAL = """
WITH r AS (SELECT l_partkey, l_quantity, CAST(l_suppkey AS VARCHAR) AS s, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS v, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_quantity, CAST(sum(n) AS BIGINT) AS n_merged, string_agg(s, ',' ORDER BY s) AS ids, string_agg(CASE WHEN v = 1 THEN 'value' ELSE 'context' END, ',' ORDER BY s) AS roles FROM r GROUP BY l_partkey, l_quantity HAVING sum(n) > 1
"""


def ordinal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("labels"), F.array_sort(F.collect_set("turn")).alias("values"))
    return records.ordinal_pairs(turns, ["conv_id"], "labels", "values")


_ORDINAL = """
WITH g AS (SELECT conv_id, list(role ORDER BY turn, role) AS labels, list_sort(list(DISTINCT turn)) AS v FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(i - 1 AS INTEGER) AS ord, labels[i] AS label, v[i] AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM g WHERE len(labels) = len(v))
"""


def caption_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    caption = F.element_at(F.array(F.lit("Figure 3. x"), F.lit("Fig. S2 y"), F.lit("a picture"), F.lit(" "), F.lit("Scheme 1")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_brand", records.caption_status(caption).alias("status")).groupBy("p_brand", "status").count().withColumnRenamed("count", "n_rows")


_CAPTION = "SELECT p_brand, (['numbered', 'supplementary', 'unnumbered', 'missing', 'numbered'])[p_partkey % 5 + 1] AS status, count(*) AS n_rows FROM part GROUP BY ALL"


def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "target").when(F.col("o_orderstatus") == "F", "non_target").otherwise("review").alias("decision"), "o_totalprice")
    return records.download_plan(rows, "o_orderkey", "decision", [F.desc("o_totalprice"), F.col("o_orderkey")], 100).select("o_orderkey", "eligibility")


_DOWNLOAD = """
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_orderkey, CASE WHEN s = 'O' AND k <= 100 THEN 'download' WHEN s = 'F' THEN 'screened_out' WHEN s <> 'O' THEN 'awaiting_review' ELSE 'over_limit' END AS eligibility FROM o
"""


def expert_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("value"))
    decisions = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 40, "--").otherwise(F.col("p_size").cast("string")).alias("chosen"))
    return records.resolve(rows, decisions, ["l_partkey"], "value").groupBy("review_status").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total"))


_EXPERT = """
SELECT CASE WHEN p_partkey IS NULL OR p_size <= 10 THEN 'pending' WHEN p_size > 40 THEN 'rejected' WHEN CAST(l_quantity AS INTEGER) = p_size THEN 'approved' ELSE 'rejected' END AS review_status,
  count(*) AS n_rows, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1
"""


def numeric_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey", F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("value"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit("A").alias("unit"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_retailprice")).alias("value"))
    return records.attach_context(facts, rows, ["l_partkey"], "unit")


_CONTEXT = """
WITH f AS (SELECT l_partkey, count(*) AS n, min(struct_pack(u := l_returnflag, v := l_quantity)) AS f FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice END AS value, n, f, CASE WHEN p_partkey % 4 = 0 THEN 'kept' WHEN n IS NULL THEN 'no_fact' WHEN n > 1 THEN 'ambiguous' WHEN f.u <> 'A' THEN 'unit_differs' ELSE 'attached' END AS reason FROM part LEFT JOIN f ON l_partkey = p_partkey)
SELECT p_partkey AS l_partkey, 'A' AS unit, CASE WHEN reason = 'attached' THEN f.v ELSE value END AS value, reason FROM r
"""


def snapshot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = N.calibrate(F.col("l_quantity"), F.lit(0.0), F.lit(50.0), F.lit(0.0), F.lit(500.0), F.lit(False))
    stored = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") * 10 + 1).otherwise(F.col("l_quantity") * 10)
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count_if(records.snapshot_ok(stored, value)).alias("n_ok"), F.count(F.lit(1)).alias("n_rows"))


def role_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"first": "tionti", "second": "ndhe", "third": "eron"}
    docs = table(spark, sf_dir, "documents").select(screening.roles(F.col("text"), rules).alias("items"), F.when(F.col("doc_id") % 2 == 0, "reviewed").otherwise("draft").alias("review_status"))
    return records.inventory(docs, "items")


_INVENTORY = """
SELECT item, count(*) AS n_rows, count(*) FILTER (doc_id % 2 <> 0) AS n_pending FROM (SELECT doc_id, 'first' AS item FROM documents WHERE regexp_matches(text, 'tionti')
  UNION ALL SELECT doc_id, 'second' FROM documents WHERE regexp_matches(text, 'ndhe') UNION ALL SELECT doc_id, 'third' FROM documents WHERE regexp_matches(text, 'eron')) GROUP BY item
"""


def superseded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest_versions(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderdate").groupBy("o_orderstatus").agg(F.count_if("superseded").alias("n_superseded"), F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (
    table_records, linked_evidence, packet_versus_project, rebind_unique, merge_equal_records, ordinal_pairs, caption_statuses, download_plan, expert_resolution, numeric_context,
    snapshot_check, role_inventory, superseded_sessions,
)}
ORACLES = {
    "table_records": _RECORDS,
    "linked_evidence": _LINKED,
    "packet_versus_project": _PACKET,
    "rebind_unique": _REBIND,
    "merge_equal_records": _EQUAL,
    "ordinal_pairs": _ORDINAL,
    "caption_statuses": _CAPTION,
    "download_plan": _DOWNLOAD,
    "expert_resolution": _EXPERT,
    "numeric_context": _CONTEXT,
    "snapshot_check": "SELECT l_linenumber, count(*) FILTER (l_linenumber % 3 <> 0) AS n_ok, count(*) AS n_rows FROM lineitem GROUP BY l_linenumber",
    "role_inventory": _INVENTORY,
    "superseded_sessions": "SELECT o_orderstatus, count(*) FILTER (s) AS n_superseded, count(*) AS n_rows FROM (SELECT o_orderstatus, o_orderdate < max(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus) AS s FROM orders) GROUP BY o_orderstatus",
}
