"""Queries that scan texts with stateful readers, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, semantics
from ..sources import readers
from ..streaming import state
from .screening import table


def html_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "ord", "kind", "locator", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def numeric_facts_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.fact_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.withColumn("issues", F.array_join("issues", ","))


def relation_candidates_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.relation_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


def stream_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state of each user from the events as a stream (all available input, then stop)."""
    import uuid

    events = table(spark, sf_dir, "events")
    # the shared folder, or the warehouse, which driver and executors share as well
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    base = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    # a stream reads a folder; the glob names the table's own file or folder
    raw = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    now = state.current_state(raw, ["user_id"], ["ts", "event_id"], ["event_type", "value", "event_id"])
    state.to_versions(now, f"{base}/versions", f"{base}/log").awaitTermination()
    return state.latest_version(spark, f"{base}/versions", ["user_id"], ["n_events"], now.schema)


#: Sentences whose candidates are known, as a table.
FIXTURE = (
    "The NO conversion reached 93.5 % at 250 °C and the N2 selectivity was above 98 % over Cu-SSZ-13.",
    "The conversion of Fe/Al2O3 was not improved, but its selectivity was 80 ± 2 %.",
    "The yield of Cu/ZSM-5 was 3 times higher than that of Fe/ZSM-5.",
    "The conversion increased by 3 times.",
    "Conversion between 80 and 95 % is expected in future work.",
    "The surface area of SAPO-\n34 was 512 m2/g.",
    "The selectivity was 5 × 10 % of that.",
    "The conversion should be over 90 %.",
    "Conversion and selectivity of Cu-Y were 90 % and 85 %.",
    "The T50 of Cu-CHA was 210-230 °C.",
    "Nothing is measured here.",
)


def semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the fixture's sentences, and of all documents (whose made-up words name no metric)."""
    known = spark.createDataFrame(list(enumerate(FIXTURE)), "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + len(FIXTURE)).alias("doc_id"), "text")
    rows = semantics.candidate_rows(known.unionByName(docs), "doc_id", "text")
    return rows.select("doc_id", "metric", "kind", "operator", "value", "value_high", "unit", "uncertainty", "sample", "reference", "scope", F.array_join("issues", ",").alias("issues"))


_CANDIDATES = """
SELECT CAST(a AS BIGINT) AS doc_id, b AS metric, c AS kind, d AS operator, CAST(e AS DOUBLE) AS value, CAST(f AS DOUBLE) AS value_high, g AS unit, CAST(h AS DOUBLE) AS uncertainty, i AS sample, j AS reference, k AS scope, l AS issues FROM (VALUES
  (0, 'conversion', 'absolute', 'eq', 93.5, NULL, '%', NULL, NULL, NULL, 'unknown', ''),
  (0, 'selectivity', 'absolute', 'gt', 98, NULL, '%', NULL, 'Cu-SSZ-13', NULL, 'unknown', ''),
  (1, 'conversion', 'negated', NULL, NULL, NULL, NULL, NULL, 'Fe/Al2O3', NULL, 'unknown', ''),
  (1, 'selectivity', 'absolute', 'eq', 80, NULL, '%', 2, NULL, NULL, 'unknown', ''),
  (2, 'yield', 'ratio', NULL, 3, NULL, 'fold', NULL, NULL, 'that of Fe/ZSM-5', 'unknown', 'several_samples'),
  (3, 'conversion', 'ambiguous_fold_change', NULL, 3, NULL, 'fold', NULL, NULL, NULL, 'unknown', 'ambiguous_base'),
  (4, 'conversion', 'absolute', 'range', 80, 95, '%', NULL, NULL, NULL, 'modal', ''),
  (5, 'surface_area', 'absolute', 'eq', 512, NULL, 'm²/g', NULL, 'SAPO-34', NULL, 'unknown', ''),
  (6, 'selectivity', 'absolute', NULL, NULL, NULL, '%', NULL, NULL, NULL, 'unknown', 'power_of_ten'),
  (7, 'conversion', 'absolute', 'gt', 90, NULL, '%', NULL, NULL, NULL, 'requirement', ''),
  (8, 'conversion', 'absolute', 'eq', 90, NULL, '%', NULL, 'Cu-Y', NULL, 'unknown', ''),
  (8, 'selectivity', 'absolute', 'eq', 85, NULL, '%', NULL, 'Cu-Y', NULL, 'unknown', ''),
  (9, 'light_off', 'absolute', 'range', 210, 230, '°C', NULL, 'Cu-CHA', NULL, 'unknown', '')
) t(a, b, c, d, e, f, g, h, i, j, k, l)
"""


QUERIES = {f.__name__: f for f in (html_page_blocks, numeric_facts_udf, relation_candidates_udf, semantic_candidates, stream_current_state)}
ORACLES = {
    "semantic_candidates": _CANDIDATES,
    "stream_current_state": "SELECT user_id, n AS n_events, event_type, value, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
}
