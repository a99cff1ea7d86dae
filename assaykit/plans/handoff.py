"""Queries of encodings, links, revisions and abstracts over the given tables, and their SQL.

Where a query needs two snapshots, decisions or attachments, they are made from the given tables by
fixed rules, over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import abstracts
from ..operators import encode, links, preparation, workflow
from .screening import table
from .tables import _FOLDS

ORDERS = preparation.Task("o_orderkey", "o_custkey", "o_totalprice", ("o_custkey", "o_orderdate", "o_orderpriority"), ("o_year",), ("o_orderpriority",), 0.2, 10)


def _orders(spark: SparkSession, sf_dir: str) -> preparation.Encoding:
    rows = table(spark, sf_dir, "orders").withColumn("o_year", F.when(F.col("o_orderkey") % 4 > 0, F.year("o_orderdate")))
    reason = F.when(F.col("o_orderstatus") == "P", "not_approved").when(F.col("o_orderkey") % 11 == 0, "has_issues")
    return preparation.build_encoding(rows, ORDERS, reason)


_JUDGED = """
WITH own AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'not_approved' WHEN o_orderkey % 11 = 0 THEN 'has_issues' END AS own FROM orders),
seen AS (SELECT o_custkey AS c, o_orderdate AS d, o_orderpriority AS p, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderkey) AS first FROM own WHERE own IS NULL GROUP BY ALL),
judged AS (SELECT own.*, coalesce(own, CASE WHEN low <> high THEN 'conflicting_values' WHEN o_orderkey <> first THEN 'repeated_observation' END) AS reason
  FROM own LEFT JOIN seen ON o_custkey = c AND o_orderdate = d AND o_orderpriority = p),
usable AS (SELECT * FROM judged WHERE reason IS NULL),
g AS (SELECT DISTINCT o_custkey FROM usable),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('fixed-group-split-v1|' || o_custkey), o_custkey) AS k, count(*) OVER () AS n FROM g),
split AS (SELECT o_custkey, CASE WHEN n < 10 THEN 'preview' WHEN k <= greatest(1, least(n - 1, ceil(n * 0.2))) THEN 'test' ELSE 'train' END AS split FROM r)
"""


def encoded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).rows
    shown = {f"p{k}": F.coalesce(*[F.col(f"`{c}`") for c in rows.columns if c.startswith(f"o_orderpriority={k}")], F.lit(0)) for k in range(1, 6)}
    return rows.select("o_orderkey", "split", F.col("o_year__missing").alias("no_year"), F.col("o_orderpriority__missing").alias("no_priority"), F.col("o_orderpriority__unknown").alias("other_priority"), *[c.alias(n) for n, c in shown.items()])


_ENCODED = _JUDGED + """
SELECT o_orderkey, split, CAST(o_orderkey % 4 = 0 AS INTEGER) AS no_year, CAST(o_orderpriority IS NULL AS INTEGER) AS no_priority,
  CAST(o_orderpriority IS NOT NULL AND o_orderpriority NOT IN (SELECT o_orderpriority FROM usable JOIN split USING (o_custkey) WHERE split <> 'test') AS INTEGER) AS other_priority,
  """ + ", ".join(f"CAST(o_orderpriority LIKE '{k}%' AS INTEGER) AS p{k}" for k in range(1, 6)) + " FROM usable JOIN split USING (o_custkey)"


def encoding_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).excluded


def development_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = table(spark, sf_dir, "orders").join(nations, "o_custkey").withColumn("split", F.lit("train"))
    return preparation.fold_plan(rows, preparation.Task("o_orderkey", "c_nationkey", "o_totalprice", ("o_orderkey",)))


_PLAN = f"""
WITH f AS ({_FOLDS.strip()}), v AS (SELECT fold, o_totalprice AS y, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN f USING (c_nationkey))
SELECT fold, count(*) AS n_validation, count(DISTINCT c_nationkey) AS n_groups, CASE WHEN count(*) < 2 THEN 'undefined_single_observation'
  WHEN min(y) = max(y) THEN 'undefined_constant_targets' ELSE 'defined_if_model_predictions_exist' END AS r2_applicability FROM v GROUP BY fold
"""


def field_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("measured"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("designed"), (F.col("event_id") % 2 == 0).alias("before"))
    return preparation.availability(rows, ["measured", "designed"], {"measured": F.col("before")})


_AVAILABLE = """
WITH e AS (SELECT CASE WHEN event_id % 3 > 0 THEN value END AS measured, CASE WHEN event_id % 5 > 0 THEN event_type END AS designed, event_id % 2 = 0 AS before FROM events)
SELECT 'measured' AS field, count(measured) AS reported, count(*) - count(measured) AS missing, count(measured) FILTER (before) AS before_prediction, count(measured) - count(measured) FILTER (before) AS reported_but_unavailable FROM e
UNION ALL SELECT 'designed', count(designed), count(*) - count(designed), count(designed), 0 FROM e
"""


def snapshot_revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    stored = encode.checksum(lines)
    same = preparation.revalidate(stored, lines.repartition(5, "l_suppkey")).withColumn("case", F.lit("dealt anew"))
    changed = preparation.revalidate(stored, lines.withColumn("l_tax", F.when(F.col("l_orderkey") == 1, F.col("l_tax") + 1).otherwise(F.col("l_tax")))).withColumn("case", F.lit("one order changed"))
    return same.unionByName(changed)


def scored_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).cards.select("l_orderkey", "l_linenumber", "quality_score", "performance")


def _scores(spark: SparkSession, sf_dir: str) -> preparation.Scores:
    rows = table(spark, sf_dir, "lineitem").withColumns({"mode": F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")), "value": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")), "id": F.concat_ws(":", "l_orderkey", "l_linenumber")})
    known = lambda c: F.col(c).isNotNull()
    checks = {"value": [(known("value"), F.lit(True)), (known("mode"), F.lit(True))], "context": [(F.col("l_discount") > 0.05, F.col("l_discount") > 0)]}
    notes = rows.where("l_linenumber = 1").select(F.when(F.col("l_orderkey") % 7 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"))
    return preparation.score_encoding(rows, "id", "value", ["mode", "l_linestatus"], "l_orderkey", "l_partkey", preparation.Goal("higher", 10.0, 40.0), checks, {"value": 2.0, "context": 1.0}, notes)


_CARDS = """
WITH l AS (SELECT *, CASE WHEN l_tax > 0.02 THEN l_returnflag END AS mode, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS v FROM lineitem),
q AS (SELECT *, (CAST(v IS NOT NULL AS INTEGER) + CAST(mode IS NOT NULL AS INTEGER)) / 2.0 AS a, CASE WHEN l_discount > 0 THEN CAST(l_discount > 0.05 AS INTEGER) ELSE 0 END AS b FROM l)
SELECT l_orderkey, l_linenumber, floor((a * (200.0 / 3) + b * (100.0 / 3)) * 100 + 0.5) / 100 AS quality_score,
  CASE WHEN v IS NOT NULL AND mode IS NOT NULL AND l_linestatus IS NOT NULL THEN floor(least(greatest((CAST(v AS DOUBLE) - 10) / 30, 0), 1) * 100 * 100 + 0.5) / 100 END AS performance FROM q
"""


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scores(spark, sf_dir)
    return found.report.crossJoin(F.broadcast(found.unused.agg(F.count(F.lit(1)).alias("unused_annotations"))))  # one row


_REPORT = """
WITH l AS (SELECT *, CASE WHEN l_tax > 0.02 THEN l_returnflag END AS mode, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS v FROM lineitem),
g AS (SELECT mode, l_linestatus, count(DISTINCT (l_orderkey, l_partkey)) AS n FROM l WHERE v IS NOT NULL AND mode IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL)
SELECT (SELECT count(*) FROM l) AS quality_scored, (SELECT count(*) FROM l WHERE v IS NOT NULL AND mode IS NOT NULL AND l_linestatus IS NOT NULL) AS performance_scored,
  (SELECT count(*) FROM g) AS comparison_groups, (SELECT count(*) FROM g WHERE n > 1) AS groups_with_multiple_samples, (SELECT count(*) FROM l WHERE l_linenumber = 1 AND l_orderkey % 7 = 0) AS unused_annotations
"""


def annotation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumns({"kind": F.element_at(F.array(F.lit("text"), F.lit("number"), F.lit("integer")), (F.col("turn") % 3 + 1).cast("int")), "value": F.element_at(F.array(F.lit("unknown"), F.lit("2.5"), F.lit("3"), F.lit("-1"), F.lit("n/a"), F.col("role")), (F.col("conv_id") % 6 + 1).cast("int"))})
    problem = preparation.annotation_problem(F.col("kind"), F.col("value"), F.col("conv_id") % 13 != 0, F.when(F.col("conv_id") % 17 != 0, F.col("role")))
    return rows.select("conv_id", "turn", problem.alias("problem"))


_ANNOTATION = """
WITH c AS (SELECT conv_id, turn, role, (['text', 'number', 'integer'])[turn % 3 + 1] AS kind, (['unknown', '2.5', '3', '-1', 'n/a', role])[conv_id % 6 + 1] AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 17 = 0 THEN 'no_reviewer' WHEN conv_id % 13 = 0 THEN 'evidence_not_linked' WHEN kind = 'text' THEN CASE WHEN v IN ('unknown', 'n/a') THEN 'says_nothing' END
  WHEN try_cast(v AS DOUBLE) IS NULL OR try_cast(v AS DOUBLE) < 0 THEN 'not_a_number' WHEN kind = 'integer' AND (try_cast(v AS DOUBLE) < 2 OR try_cast(v AS DOUBLE) <> floor(try_cast(v AS DOUBLE))) THEN 'not_a_repeat_count' END AS problem FROM c
"""


def quotes_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    evidence = turns.select("conv_id", "turn", F.substring("text", 1, 24).alias("quote")).withColumn("named", F.when(F.col("turn") % 3 == 0, F.col("turn") + 1).otherwise(F.col("turn")))
    pages = turns.select("conv_id", F.col("turn").alias("named"), "text")
    return links.on_page(evidence, pages, ["conv_id", "named"], "quote", "text").select("conv_id", "turn", "located")


_ON_PAGE = """
WITH p AS (SELECT conv_id, turn, arg_max(text, length(text)) AS text FROM conversations GROUP BY ALL)
SELECT c.conv_id, c.turn, CASE WHEN p.conv_id IS NULL THEN 'no_page' WHEN contains(p.text, substr(c.text, 1, 24)) THEN 'quote_found' ELSE 'quote_missing' END AS located
FROM conversations c LEFT JOIN p ON p.conv_id = c.conv_id AND p.turn = CASE WHEN c.turn % 3 = 0 THEN c.turn + 1 ELSE c.turn END
"""


def attached_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("unknown"), F.lit("review"), F.lit("supplementary_information")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), kind.alias("document_type"), F.lit(False).alias("training_eligible"), F.array(F.lit("unclassified_document"), "lang").alias("issues"))
    files = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.when(F.col("toxic") == 0, "supplement").otherwise("primary").alias("role"))
    return links.with_supplements(docs, files, "path").select(F.col("path").alias("doc_id"), "document_type", "training_eligible", F.array_join("issues", ",").alias("issues"))


_SUPPLEMENT = """
WITH d AS (SELECT doc_id, lang, (['unknown', 'review', 'supplementary_information'])[doc_id % 3 + 1] AS t FROM documents),
s AS (SELECT d.*, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND t <> 'review' AS y FROM d)
SELECT doc_id, CASE WHEN y THEN 'supplementary_information' ELSE t END AS document_type, y AS training_eligible, CASE WHEN y THEN coalesce(lang, '') ELSE concat_ws(',', 'unclassified_document', lang) END AS issues FROM s
"""


def labels_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 2000).cast("double").alias("y"))
    labels = rows.where("l_linenumber <= 2").select("l_orderkey", "x", "y", F.col("l_linenumber").alias("label"))
    found = links.nearest_label(rows.where("l_linenumber > 2"), labels, ["l_orderkey"], 15.0, "label", "label")
    return found.select("l_orderkey", "l_linenumber", "label")


_LABELS = """
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice / 2000 AS DOUBLE) AS y FROM lineitem),
d AS (SELECT p.l_orderkey, p.x, p.y, l.l_linenumber AS label, sqrt((p.x - l.x) ** 2 + (p.y - l.y) ** 2) AS d FROM (SELECT DISTINCT l_orderkey, x, y FROM r WHERE l_linenumber > 2) p JOIN r l ON p.l_orderkey = l.l_orderkey AND l.l_linenumber <= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, x, y ORDER BY d, label) AS k FROM d WHERE d <= 15)
SELECT r.l_orderkey, r.l_linenumber, n.label FROM r LEFT JOIN n ON n.l_orderkey = r.l_orderkey AND n.x = r.x AND n.y = r.y AND n.k = 1 WHERE r.l_linenumber > 2
"""


def curated_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select(F.concat(F.lit("block:"), F.col("doc_id")).alias("locator"), "n_chars")
    notes = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("block:"), F.when(F.col("quality") == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id"))).alias("locator"))
    return links.annotated(notes, blocks, "locator", ["n_chars"]).select("doc_id", "status", "block_n_chars")


_NOTES = """
SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'no_block' ELSE 'attached' END AS status, d.n_chars AS block_n_chars
FROM labels l LEFT JOIN documents d ON d.doc_id = CASE WHEN l.quality = 0 THEN l.doc_id + 1000000000 ELSE l.doc_id END
"""

FLAGS = ("A", "N", "R", "Z")


def gold_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.curve_coverage({m: (F.col("l_returnflag") == m) & (F.col("l_quantity") > 10) for m in FLAGS}, table(spark, sf_dir, "lineitem"))


def ticks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("v"))
    return links.tick_order(ticks, ["l_orderkey"], "l_linenumber", "v", 12.0)


_ORDER = """
WITH s AS (SELECT l_orderkey, l_linenumber AS p, CAST(l_quantity AS DOUBLE) - lag(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS d FROM lineitem)
SELECT l_orderkey, count(*) AS n_ticks, CASE WHEN count(*) < 3 THEN 'too_few_ticks' WHEN NOT (min(d) > 0 OR max(d) < 0) THEN 'printed_ticks_not_monotonic'
  WHEN max(p) - min(p) < 12.0 * 0.4 THEN 'printed_ticks_span_too_small' ELSE 'usable' END AS state FROM s GROUP BY l_orderkey
"""


def bands_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("place"))
    return links.bands(places, ["l_orderkey"], "place", 6.0).select("l_orderkey", "low", "high", "n_places")


_BANDS = """
WITH p AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS place FROM lineitem),
n AS (SELECT *, CASE WHEN place - lag(place) OVER w <= 6 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY place)),
b AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS band FROM n)
SELECT l_orderkey, min(place) AS low, max(place) AS high, count(*) AS n_places FROM b GROUP BY l_orderkey, band HAVING count(*) >= 3
"""


def evidence_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    image = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    spoken = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role")
    rows = links.union_of({"text": text, "image": image, "semantic": spoken})
    return rows.groupBy("branch").agg(F.count(F.lit(1)).alias("n_rows"), F.count("lang").alias("n_lang"), F.count("url").alias("n_url"), F.count("role").alias("n_role"), F.max("id").alias("last_id"))


_BRANCHES = """
SELECT 'text' AS branch, count(*) AS n_rows, count(lang) AS n_lang, CAST(0 AS BIGINT) AS n_url, CAST(0 AS BIGINT) AS n_role, max(doc_id) AS last_id FROM documents
UNION ALL SELECT 'image', count(*), 0, count(url), 0, max(page_id) FROM pages UNION ALL SELECT 'semantic', count(*), 0, 0, count(role), max(conv_id) FROM conversations
"""


def revision_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("key"), F.lit(0).alias("revision"))
    updates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("base_revision"))
    judged = workflow.apply_revisions(current, updates, "key", ["o_orderkey"])
    return judged.select("o_orderkey", "outcome")


_REVISIONS = """
WITH u AS (SELECT o_orderkey, o_custkey AS k, o_orderstatus <> 'F' AND o_custkey % 9 <> 0 AS fits FROM orders), f AS (SELECT k, min(o_orderkey) AS first FROM u WHERE fits GROUP BY k)
SELECT o_orderkey, CASE WHEN u.k % 9 = 0 THEN 'unknown_key' WHEN NOT fits THEN 'conflict_stale' WHEN o_orderkey = first THEN 'accepted' ELSE 'conflict_raced' END AS outcome FROM u LEFT JOIN f ON u.k = f.k
"""


def reviewed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 7 == 0).alias("stale"), F.when(F.col("doc_id") % 5 == 0, "image").otherwise("text").alias("branch"), (F.col("toxic") == 1).alias("dropped"))
    decision = F.element_at(F.array(F.lit("reviewed"), F.lit("excluded"), F.lit("unreviewed"), F.lit("maybe")), (F.col("event_id") % 4 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 997).alias("doc_id"), "event_id", "ts", decision.alias("decision"), F.when(F.col("event_id") % 6 > 0, F.col("event_type")).otherwise(" ").alias("reviewer"))
    return workflow.reviewed_items(items, events, "doc_id", ["ts", "event_id"]).select("doc_id", "review_status", "reviewer", "n_events")


_REVIEWED = """
WITH i AS (SELECT doc_id, toxic = 1 AS dropped FROM labels),
e AS (SELECT event_id % 997 AS doc_id, event_id, ts, (['reviewed', 'excluded', 'unreviewed', 'maybe'])[event_id % 4 + 1] AS decision, event_type AS reviewer FROM events WHERE event_id % 6 > 0),
v AS (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY e.doc_id) AS n FROM e JOIN i ON e.doc_id = i.doc_id
  WHERE decision <> 'maybe' AND e.doc_id % 7 <> 0 AND e.doc_id % 5 <> 0 AND NOT (dropped AND decision <> 'excluded'))
SELECT i.doc_id, coalesce(v.decision, 'unreviewed') AS review_status, v.reviewer, coalesce(v.n, 0) AS n_events FROM i LEFT JOIN v ON v.doc_id = i.doc_id AND v.k = 1
"""


def handoff_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1/"), F.col("doc_id") % 50)).alias("doi"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.when(F.col("lang") == "es", "excluded").otherwise("reviewed").alias("review_status"), F.when(F.col("n_chars") < 300, F.array(F.lit("too_short"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    return workflow.handoff(docs, "doi", "sha").select("doc_id", "split_group", "stage", "ml_ready")


_HANDOFF = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '10.1/' || (doc_id % 50) ELSE sha256(coalesce(text, '')) END AS split_group, CASE WHEN n_chars < 300 THEN 'needs_review' ELSE 'ready_for_standardization' END AS stage, false AS ml_ready
FROM documents WHERE lang IS DISTINCT FROM 'es'
"""


def team_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "target").when(F.col("o_orderstatus") == "F", "dropped").alias("human_decision"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "N", "primary").otherwise("supplement").alias("role"), F.concat(F.col("l_linenumber"), F.when(F.col("l_linenumber") % 2 == 0, ".PDF").otherwise(".html")).alias("path"))
    return workflow.team_papers(papers, files, "o_orderkey").select("o_orderkey", "decision", "pdf_state", "pdf_path")


_TEAM = """
WITH m AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber || '.PDF') AS p FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber % 2 = 0 GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'target' ELSE 'review' END AS decision, CASE WHEN n IS NULL THEN 'no_primary_pdf' WHEN n = 1 THEN 'bound' ELSE 'several_primary_pdfs' END AS pdf_state, CASE WHEN n = 1 THEN p END AS pdf_path
FROM orders LEFT JOIN m ON o_orderkey = l_orderkey
"""


def api_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" <p>"), F.col("p_name"), F.lit("</p>  of "), F.col("p_brand"))
    plain, nested = F.struct(text.alias("dc:description")), F.struct(F.struct(text.alias("$")).alias("description"))
    shapes = [F.to_json(plain), F.to_json(F.struct(nested.alias("coredata"))), F.to_json(F.struct(F.struct(plain.alias("coredata")).alias("full-text-retrieval-response"))), F.to_json(F.struct(F.col("p_name").alias("title"))), F.lit("no json")]
    return table(spark, sf_dir, "part").select("p_partkey", abstracts.api_abstract(F.element_at(F.array(*shapes), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("abstract"))


def publisher_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[<>\"'&]", " ").alias("body"))
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<meta name="citation_doi" content="10.5555/'), F.col("doc_id") % 4, F.lit('">'))).otherwise(F.concat(F.lit('<meta name="citation_title" content="Study '), F.col("doc_id") % 4, F.lit('">')))
    page = F.concat(F.lit("<html><head>"), head, F.lit('<meta name="citation_abstract" content="'), F.col("body"), F.when(F.col("doc_id") % 5 == 0, "...").otherwise(""), F.lit('"></head></html>'))
    found = abstracts.publisher_abstract(page, F.lit("https://doi.org/10.5555/0"), F.lit("Study 1"))
    return docs.select("doc_id", F.length(found).alias("n_chars"), F.md5(found).alias("abstract_md5"))


_PUBLISHER = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[<>"''&]', ' ', 'g') || CASE WHEN doc_id % 5 = 0 THEN '...' ELSE '' END, '\s+', ' ', 'g')) AS t FROM documents),
a AS (SELECT doc_id, CASE WHEN CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 = 0 ELSE doc_id % 4 = 1 END AND length(t) >= 80 AND NOT regexp_matches(t, '(\.\.\.|…)$') THEN t END AS t FROM d)
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS abstract_md5 FROM a
"""


def document_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    title = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 120)).otherwise("alpha beta gamma delta epsilon zeta")
    pages = F.concat("text", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" doi: 10.5555/ab."), F.col("doc_id"))).otherwise(""))
    state = abstracts.document_identity(F.concat(F.lit("10.5555/AB."), F.col("doc_id")), title, pages)
    return docs.select("doc_id", state.alias("state"))


_IDENTITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 2 = 0 THEN substr(coalesce(text, ''), 1, 120) ELSE 'alpha beta gamma delta epsilon zeta' END AS title FROM documents),
w AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{3,}')), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from', 'into', 'doi', 'www', 'https')) AS words,
  regexp_replace(lower(t || CASE WHEN doc_id % 3 > 0 THEN ' doi: 10.5555/ab.' || doc_id ELSE '' END), '[^a-z0-9]+', '', 'g') AS body FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doi_not_found' WHEN len(words) >= 4 AND len(list_filter(words, lambda x: contains(body, x))) / len(words) < 0.6 THEN 'title_mismatch' ELSE 'verified' END AS state FROM w
"""

QUERIES = {f.__name__: f for f in (
    encoded_orders, encoding_excluded, development_folds, field_availability, snapshot_revalidated, scored_observations, score_report, annotation_checks, quotes_on_pages,
    attached_supplements, labels_of_points, curated_notes, gold_curves, ticks_in_order, bands_of_places, evidence_branches, revision_outcomes, reviewed_evidence, handoff_records,
    team_import, api_abstracts, publisher_abstracts, document_identities,
)}

ORACLES = {
    "encoded_orders": _ENCODED,
    "encoding_excluded": _JUDGED + "SELECT o_orderkey, reason FROM judged WHERE reason IS NOT NULL",
    "development_folds": _PLAN,
    "field_availability": _AVAILABLE,
    "snapshot_revalidated": "SELECT count(*) AS n_rows, count(*) AS rows_now, true AS same, 'dealt anew' AS case FROM lineitem UNION ALL SELECT count(*), count(*), count(*) FILTER (l_orderkey = 1) = 0, 'one order changed' FROM lineitem",
    "scored_observations": _CARDS,
    "score_report": _REPORT,
    "annotation_checks": _ANNOTATION,
    "quotes_on_pages": _ON_PAGE,
    "attached_supplements": _SUPPLEMENT,
    "labels_of_points": _LABELS,
    "curated_notes": _NOTES,
    "gold_curves": " UNION ALL ".join(f"SELECT '{m}' AS field, count(*) AS n_points, count(*) > 0 AS covered FROM lineitem WHERE l_returnflag = '{m}' AND l_quantity > 10" for m in FLAGS),
    "ticks_in_order": _ORDER,
    "bands_of_places": _BANDS,
    "evidence_branches": _BRANCHES,
    "revision_outcomes": _REVISIONS,
    "reviewed_evidence": _REVIEWED,
    "handoff_records": _HANDOFF,
    "team_import": _TEAM,
    "api_abstracts": "SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN p_name || ' of ' || p_brand END AS abstract FROM part",
    "publisher_abstracts": _PUBLISHER,
    "document_identities": _IDENTITY,
}
