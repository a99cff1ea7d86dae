"""Queries over the business tables that exercise units, gates, conflicts, splits, encodings,
scores and chart readings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import dedup, encode, geometry, review, score
from .screening import table


def rounded(c, digits: int = 4):
    return N.round_half_up(c, digits)


def line_id() -> list:
    return ["l_orderkey", "l_linenumber"]


def unit_quantity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(x) for x in ("K", "°C", "min", "μmol/g", "%", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    target = F.element_at(F.array(*[F.lit(x) for x in ("degC", "degC", "h", "mmol/g", "%", "nm")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    raw = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit(">"), F.col("p_size"))).when(F.col("p_partkey") % 13 == 0, F.lit("90-100")).otherwise((F.col("p_size") * 5).cast("string"))
    part = table(spark, sf_dir, "part").withColumns({"raw": raw, "unit": unit, "target": target})
    q = N.quantity(F.col("raw"), F.col("unit"), F.col("target"))
    return part.withColumn("q", q).select("p_partkey", "raw", "unit", "target", rounded(F.col("q.value")).alias("value"), F.col("q.issue").alias("issue"))


_QUANTITY = """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '>' || p_size WHEN p_partkey % 13 = 0 THEN '90-100' ELSE CAST(p_size * 5 AS VARCHAR) END AS raw,
  (['K', '°C', 'min', 'μmol/g', '%', ''])[p_partkey % 6 + 1] AS unit, (['degC', 'degC', 'h', 'mmol/g', '%', 'nm'])[p_partkey % 6 + 1] AS target FROM part),
v AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS x FROM p),
w AS (SELECT *, CASE unit WHEN 'K' THEN x - 273.15 WHEN '°C' THEN x WHEN 'min' THEN x / 60 WHEN 'μmol/g' THEN x / 1000 WHEN '%' THEN x END AS y FROM v),
i AS (SELECT *, CASE WHEN x IS NULL THEN 'non_scalar_or_missing' WHEN unit = '' THEN 'unknown_unit' WHEN target = '%' AND (y < 0 OR y > 100) THEN 'out_of_range'
  WHEN target <> 'degC' AND y < 0 THEN 'out_of_range' WHEN target = 'degC' AND y < -273.15 THEN 'out_of_range' END AS issue FROM w)
SELECT p_partkey, raw, unit, target, CASE WHEN issue IS NULL THEN floor(y * 10000 + 0.5) / 10000 END AS value, issue FROM i
"""


def target_standardize_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_linenumber") % 3 == 0, "%").when(F.col("l_linenumber") % 3 == 1, "fraction").otherwise("kJ/mol")
    value = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") * 3).otherwise(F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").withColumn("s", N.standard_target(value, unit, F.col("l_linenumber") % 3 == 2))
    return rows.groupBy("s.y_unit", "s.method").agg(F.count(F.lit(1)).alias("n_rows"), F.count("s.y").alias("n_valid"), rounded(F.max("s.y"), 8).alias("y_max"), rounded(F.min("s.y"), 8).alias("y_min"))


_TARGET = """
WITH r AS (SELECT l_linenumber % 3 AS k, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 3 ELSE l_discount END AS v FROM lineitem),
s AS (SELECT CASE WHEN k = 2 THEN 'eV' ELSE 'fraction' END AS y_unit, CASE k WHEN 0 THEN 'percent_to_fraction' WHEN 1 THEN 'identity' ELSE 'kJ_mol_to_eV' END AS method,
  CASE WHEN k = 0 THEN CASE WHEN v BETWEEN 0 AND 100 THEN v * 0.01 END WHEN k = 1 THEN CASE WHEN v BETWEEN 0 AND 1 THEN v END ELSE v / 96.4853321233100184 END AS y FROM r)
SELECT y_unit, method, count(*) AS n_rows, count(y) AS n_valid, floor(max(y) * 100000000 + 0.5) / 100000000 AS y_max, floor(min(y) * 100000000 + 0.5) / 100000000 AS y_min FROM s GROUP BY y_unit, method
"""


def feature_issue_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    issues = review.reasons(
        size_too_large=F.col("p_size") > 40, type_unknown=~F.col("p_type").rlike("(?i)brass|steel|tin|copper|nickel|small|large|standard|medium|promo|economy"),
        composition_over_100=F.col("p_size") + F.col("p_partkey") % 70 > 100 + 1e-9, price_not_finite=N.finite(F.col("p_retailprice")).isNull(),
    )
    return part.select("p_partkey", F.array_join(issues, ",").alias("issues"), F.size(issues).alias("n_issues"))


_ISSUES = """
SELECT p_partkey, concat_ws(',', a, b, c) AS issues, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS INTEGER) AS n_issues
FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'size_too_large' END AS a, CASE WHEN NOT regexp_matches(p_type, '(?i)brass|steel|tin|copper|nickel|small|large|standard|medium|promo|economy') THEN 'type_unknown' END AS b,
  CASE WHEN p_size + p_partkey % 70 > 100 THEN 'composition_over_100' END AS c FROM part)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as measurement records."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_custkey"), "l_orderkey")
    category = F.when(F.col("l_returnflag") == "A", "performance").when(F.col("l_returnflag") == "N", "condition").otherwise("performance")
    prop = F.when(F.col("l_linenumber") == 1, "t50").otherwise("no_conversion")
    status = F.when(F.col("o_orderstatus") == "O", "approved").when(F.col("o_orderstatus") == "F", "pending").otherwise("rejected")
    return rows.select(*line_id(), "o_custkey", "l_partkey", "l_suppkey", "l_quantity", category.alias("category"), prop.alias("property"), status.alias("status"), review.reasons(low=F.col("l_discount") > 0.08).alias("issues"), F.when(F.col("l_tax") > 0.01, F.col("l_quantity")).alias("value"), F.when(F.col("l_suppkey") % 7 != 0, F.lit("cat")).alias("subject"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("temperature"))


_LINES = """
SELECT l_orderkey, l_linenumber, o_custkey, l_partkey, l_suppkey, l_quantity, CASE WHEN l_returnflag = 'N' THEN 'condition' ELSE 'performance' END AS category,
  CASE WHEN l_linenumber = 1 THEN 't50' ELSE 'no_conversion' END AS property, CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'F' THEN 'pending' ELSE 'rejected' END AS status,
  l_discount > 0.08 AS low, CASE WHEN l_tax > 0.01 THEN l_quantity END AS value, CASE WHEN l_suppkey % 7 <> 0 THEN 'cat' END AS subject, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS temperature
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
_GATE_CASE = "CASE WHEN status <> 'approved' THEN 'not_approved' WHEN low THEN 'has_issues' WHEN value IS NULL THEN 'no_value' WHEN coalesce(subject, '') = '' THEN 'no_subject' WHEN category <> 'performance' THEN 'not_performance' WHEN property <> 't50' AND temperature IS NULL THEN 'missing_temperature' ELSE 'ml' END"


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = review.training_gate(F.col("category"), F.col("property"), F.col("status"), F.col("issues"), F.col("value"), F.col("subject"), F.col("temperature"))
    return lines(spark, sf_dir).withColumn("gate", gate)


def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).groupBy("gate").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"))


def withheld_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).where("gate <> 'ml'").select(*line_id(), F.col("gate").alias("reason"))


def partition_ready_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("gate") == "ml", "ready").when(F.col("gate") == "not_approved", "waiting").otherwise("excluded")
    return review.partition_counts(gated(spark, sf_dir), state, ["ready", "waiting", "excluded"])


PROPS = ["p1", "p2", "p3"]


def feature_pivot_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("prop", F.concat(F.lit("p"), F.least(F.col("l_linenumber"), F.lit(3))))
    wide = encode.feature_pivot(rows, ["l_orderkey"], "prop", "value", "status", F.size("issues") == 0, PROPS)
    return wide.select("l_orderkey", *[f"feature_{p}" for p in PROPS], F.array_join("ambiguous", ",").alias("ambiguous"))


_PIVOT = f"""
WITH r AS (SELECT *, 'p' || least(l_linenumber, 3) AS prop FROM ({_LINES}) WHERE status <> 'rejected'),
g AS (SELECT l_orderkey, prop, count(DISTINCT value) AS n, max(value) AS v, count(*) FILTER (status = 'approved' AND NOT low AND value IS NOT NULL) AS u FROM r GROUP BY ALL),
w AS (SELECT *, n = 1 AND u > 0 AS good FROM g)
SELECT l_orderkey, {', '.join(f"max(CASE WHEN prop = '{p}' AND good THEN v END) AS feature_{p}" for p in PROPS)}, coalesce(string_agg(CASE WHEN NOT good THEN prop END, ',' ORDER BY prop), '') AS ambiguous FROM w GROUP BY l_orderkey
"""


def metric_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.conflicts(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_discount", "l_tax"])


def cross_source_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.array_sort(F.collect_set("l_quantity")).alias("values"))
    return rows.where(F.size("values") > 1).select("l_partkey", "l_returnflag", F.size("values").alias("n_values"), F.array_min("values").alias("low"), F.array_max("values").alias("high"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as observations with planted copies and conflicts."""
    base = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3000).alias("source"), F.when(F.col("l_orderkey") % 11 == 0, F.col("l_linenumber").cast("string")).otherwise(F.lit("d")).alias("paper"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("observation"), F.col("l_quantity").alias("y"), F.col("l_partkey").alias("sample"), F.concat_ws("-", "l_partkey", (F.col("l_suppkey") % 3).cast("string")).alias("evidence"))
    again = base.where("source % 9 = 0")
    changed = base.where("source % 14 = 0").withColumn("y", F.col("y") + 1)
    return base.unionByName(again).unionByName(changed).withColumn("content", F.concat_ws("|", "y", "sample"))


def observation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = dedup.observation_codes(copies(spark, sf_dir), "source", "paper", "observation", "content", ["source", "sample"], "y", "evidence")
    return marked.groupBy(F.array_join("codes", ",").alias("codes")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("observation").alias("n_observations"))


_DEDUP = """
WITH b AS (SELECT l_orderkey % 3000 AS source, CASE WHEN l_orderkey % 11 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE 'd' END AS paper, l_orderkey || '-' || l_linenumber AS observation, l_quantity AS y, l_partkey AS sample, l_partkey || '-' || (l_suppkey % 3) AS evidence FROM lineitem),
a AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE source % 9 = 0 UNION ALL SELECT source, paper, observation, y + 1, sample, evidence FROM b WHERE source % 14 = 0),
s AS (SELECT source, count(DISTINCT paper) AS papers FROM a GROUP BY source), c AS (SELECT observation, count(DISTINCT (y, sample)) AS contents FROM a GROUP BY observation),
m AS (SELECT a.*, papers, contents, row_number() OVER (PARTITION BY observation, y, sample) AS k FROM a JOIN s USING (source) JOIN c USING (observation)),
n AS (SELECT *, papers <= 1 AND contents = 1 AND k = 1 AS counted FROM m),
e AS (SELECT source, sample, count(*) AS tries, count(DISTINCT y) AS labels FROM n WHERE counted GROUP BY ALL), u AS (SELECT source, evidence, count(*) AS uses FROM n WHERE counted GROUP BY ALL)
SELECT concat_ws(',', CASE WHEN papers > 1 THEN 'conflicting_source_doi' END, CASE WHEN contents = 1 AND k > 1 THEN 'repeated_record' END, CASE WHEN contents > 1 THEN 'conflicting_record_copy' END,
  CASE WHEN counted AND tries > 1 AND labels = 1 THEN 'duplicate_experiment' END, CASE WHEN counted AND tries > 1 AND labels > 1 THEN 'conflicting_experiment' END, CASE WHEN counted AND uses > 1 THEN 'reused_value_evidence' END) AS codes,
  count(*) AS n_rows, count(DISTINCT observation) AS n_observations FROM n LEFT JOIN e USING (source, sample) LEFT JOIN u USING (source, evidence) GROUP BY 1
"""


def numeric_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = dedup.overview(rows, ["l_partkey", "l_quantity", "l_discount"], "ord", ["l_suppkey"])
    return out.where("n_occurrences > 1").select("l_partkey", "l_quantity", "l_discount", "first_at", "n_occurrences", F.array_join(F.transform("occurrences", lambda o: o["l_suppkey"].cast("string")), ",").alias("suppliers"))


def group_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.group_split(table(spark, sf_dir, "orders"), "o_custkey", 0.2, 10)


def _hash(salt: str, c: str) -> str:
    return f"sha256('{salt}|' || {c})"


_SPLIT = f"""
WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY {_hash(encode.SPLIT_SALT, 'o_custkey')}, o_custkey) AS k, count(*) OVER () AS n FROM g)
SELECT o_custkey, CASE WHEN n < 10 THEN 'preview' WHEN k <= greatest(1, least(n - 1, ceil(n * 0.2))) THEN 'test' ELSE 'train' END AS split FROM r
"""


def group_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    split = encode.group_split(orders, "o_custkey", 0.2, 10)
    rows = orders.join(split, "o_custkey")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_groups")).crossJoin(F.broadcast(encode.leaks(rows, "o_custkey").agg(F.count(F.lit(1)).alias("n_leaks"))))  # one row


def balanced_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return encode.balanced_folds(orders, "c_nationkey")


_FOLDS = f"""
WITH RECURSIVE g AS (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256('{encode.FOLD_SALT}|' || c_nationkey)) AS k FROM g),
deal AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS w, CAST(0 AS BIGINT) AS fold
  UNION ALL
  SELECT r.k, list_transform(w, lambda x, i: CASE WHEN i = list_position(w, list_min(w)) THEN x + r.n ELSE x END), CAST(list_position(w, list_min(w)) AS BIGINT) FROM deal JOIN r ON r.k = deal.k + 1
)
SELECT c_nationkey, n AS n_rows, CAST(fold AS INTEGER) AS fold FROM deal JOIN r USING (k)
"""


def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumns({"k": F.get_json_object("props", "$.k").try_cast("int"), "value": F.when(F.col("event_id") % 4 != 0, F.col("value"))})
    return encode.field_coverage(events, ["event_type", "value", "k"], {"value": F.col("event_type") != "error"})


_COVERAGE = """
WITH e AS (SELECT event_type, CASE WHEN event_id % 4 <> 0 THEN value END AS value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT 'event_type' AS field, count(event_type) AS reported, count(*) - count(event_type) AS missing, count(event_type) AS available FROM e
UNION ALL SELECT 'value', count(value), count(*) - count(value), count(*) FILTER (value IS NOT NULL AND event_type <> 'error') FROM e UNION ALL SELECT 'k', count(k), count(*) - count(k), count(k) FROM e
"""
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE"]


def one_hot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 17 != 0, F.col("c_mktsegment")))
    return encode.encode_long(rows, "c_custkey", "c_mktsegment", SEGMENTS)


_ONEHOT = f"""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS s FROM customer)
{' UNION ALL '.join(f"SELECT c_custkey, 'c_mktsegment={t}' AS column, CAST(coalesce(s = '{t}', false) AS INTEGER) AS value FROM c" for t in SEGMENTS)}
UNION ALL SELECT c_custkey, 'c_mktsegment__missing', CAST(s IS NULL AS INTEGER) FROM c
UNION ALL SELECT c_custkey, 'c_mktsegment__unknown', CAST(coalesce(s NOT IN ({', '.join(f"'{t}'" for t in SEGMENTS)}), false) AS INTEGER) FROM c
"""


def multi_hot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return encode.encode_long(users, "user_id", "types", ["click", "purchase", "view"])


_MULTI = """
WITH u AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY user_id)
SELECT user_id, 'types=' || k AS column, CAST(list_contains(t, k) AS INTEGER) AS value FROM u CROSS JOIN (SELECT unnest(['click', 'purchase', 'view']) AS k)
UNION ALL SELECT user_id, 'types__missing', 0 FROM u
UNION ALL SELECT user_id, 'types__unknown', CAST(len(list_filter(t, lambda x: x NOT IN ('click', 'purchase', 'view'))) > 0 AS INTEGER) FROM u
"""


def vocabulary_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(group_hash_split(spark, sf_dir), "o_custkey").where("split = 'train'")
    return encode.vocabulary(rows, ["o_orderpriority", "o_orderstatus"])


def fold_preprocess_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"q": F.when(F.col("l_linenumber") != 4, F.col("l_quantity")), "t": F.col("l_tax"), "fold": F.col("l_orderkey") % 5})
    stats = encode.fold_statistics(rows.where("fold <> 0"), ["q", "t"])
    out = encode.transform(rows.where("fold = 0"), stats, ["q", "t"])
    return out.groupBy("l_linenumber").agg(rounded(F.max("q"), 6).alias("q_max"), rounded(F.min("q"), 6).alias("q_min"), rounded(F.max("t"), 6).alias("t_max"), F.sum("q__missing").alias("n_missing"))


_ZSCORE = """
WITH r AS (SELECT l_linenumber, CASE WHEN l_linenumber <> 4 THEN l_quantity END AS q, l_tax AS t, l_orderkey % 5 AS fold FROM lineitem),
m AS (SELECT median(q) AS qm, median(t) AS tm FROM r WHERE fold <> 0),
s AS (SELECT any_value(qm) AS qm, avg(coalesce(q, qm)) AS qa, stddev_pop(coalesce(q, qm)) AS qs, avg(coalesce(t, tm)) AS ta, stddev_pop(coalesce(t, tm)) AS ts FROM r, m WHERE fold <> 0)
SELECT l_linenumber, floor(max((coalesce(q, qm) - qa) / qs) * 1000000 + 0.5) / 1000000 AS q_max, floor(min((coalesce(q, qm) - qa) / qs) * 1000000 + 0.5) / 1000000 AS q_min,
  floor(max((t - ta) / ts) * 1000000 + 0.5) / 1000000 AS t_max, CAST(count(*) FILTER (q IS NULL) AS BIGINT) AS n_missing FROM r, s WHERE fold = 0 GROUP BY l_linenumber
"""


def utility_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*[F.lit(m) for m in ("higher", "lower", "target_range", "disabled")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    u = N.utility(F.col("p_size").cast("double"), mode, F.lit(5.0), F.lit(45.0), F.lit(20.0), F.lit(30.0))
    return table(spark, sf_dir, "part").withColumns({"mode": mode, "u": u}).select("p_partkey", "mode", F.col("u.score").alias("score"), F.col("u.clipped").alias("clipped"))


_UTILITY = """
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS y, (['higher', 'lower', 'target_range', 'disabled'])[p_partkey % 4 + 1] AS mode FROM part),
u AS (SELECT *, CASE mode WHEN 'higher' THEN (y - 5) / 40 WHEN 'lower' THEN (45 - y) / 40 WHEN 'target_range' THEN CASE WHEN y < 20 THEN (y - 5) / 15 WHEN y > 30 THEN (45 - y) / 15 ELSE 1 END END AS u FROM p)
SELECT p_partkey, mode, CASE WHEN u IS NOT NULL THEN floor(least(greatest(u, 0), 1) * 100 * 100 + 0.5) / 100 END AS score, NOT (u BETWEEN 0 AND 1) AS clipped FROM u
"""


def quality_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = F.lit(True)
    checks = {
        "traceability": [(F.col("c_name").isNotNull(), yes), (F.col("c_acctbal") > 0, yes)], "identity": [(F.col("c_custkey") % 3 != 0, yes), (F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 2 == 0)],
        "conditions": [(F.col("c_nationkey") > 10, F.col("c_nationkey") > 3)],
    }
    out = score.completeness(checks, {"traceability": 2.0, "identity": 1.0, "conditions": 1.0})
    return table(spark, sf_dir, "customer").select("c_custkey", out["quality_score"].alias("quality_score"))


_QUALITY = """
SELECT c_custkey, floor((50 * ((c_name IS NOT NULL)::INT + (c_acctbal > 0)::INT) / 2.0 + 25 * ((c_custkey % 3 <> 0)::INT + (c_custkey % 5 <> 0 AND c_custkey % 2 = 0)::INT) / CAST(1 + (c_custkey % 2 = 0)::INT AS DOUBLE)
  + 25 * CASE WHEN c_nationkey > 3 THEN (c_nationkey > 10)::INT ELSE 0 END) * 100 + 0.5) / 100 AS quality_score FROM customer
"""


def comparison_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("mode", F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")))
    return score.comparison_groups(rows, ["mode", "l_linestatus", "l_linenumber"], "l_orderkey", "l_partkey").select("mode", "l_linestatus", "l_linenumber", "n_observations", "n_papers", "n_samples")


def run_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", rank.alias("rank"), (-F.col("o_totalprice")).alias("by_price"))
    return encode.aligned_index(rows, ["rank", "by_price", "o_orderkey"], 8).select("o_orderkey", "rank", F.col("row_index").alias("position"))


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.breaker(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return rows.groupBy("user_id").agg(F.count_if("deferred").alias("n_deferred"), F.count_if(~F.col("deferred")).alias("n_tried"))


def batches_of_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.aligned_index(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 8)
    return rows.groupBy(F.floor(F.col("row_index") / 50).alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def aligned_xy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.aligned_index(table(spark, sf_dir, "lineitem").select(*line_id()), line_id(), 8)


def latest_state_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value", "event_id"])


def spans(spark: SparkSession, sf_dir: str, shift: int, size: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("n_chars") >= 1).select(F.col("doc_id"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 400))).alias("k"))
    return docs.select("doc_id", F.concat_ws("-", "doc_id", "k").alias("span_id"), (F.col("k") * 400 + shift + F.col("doc_id") % 90).alias("start"), (F.col("k") * 400 + shift + F.col("doc_id") % 90 + size + F.col("k") % 30).alias("end"), F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("kind"))


def renamed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("span_id").alias("b_span"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "kind")


def interval_overlap_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dedup.overlaps(spans(spark, sf_dir, 0, 150), renamed(spans(spark, sf_dir, 100, 350)).drop("kind"), ["doc_id"])
    return pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("shared"))


def interval_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = renamed(spans(spark, sf_dir, 10, 140).where("kind = 'a' OR start > 2000"))
    return dedup.without_near_duplicates(spans(spark, sf_dir, 0, 150), near, ["doc_id"], "kind", "span_id").select("span_id", "start", "end")


def _spans(shift: int, size: int) -> str:
    return f"SELECT doc_id, doc_id || '-' || k AS span_id, k * 400 + {shift} + doc_id % 90 AS s, k * 400 + {shift} + doc_id % 90 + {size} + k % 30 AS e, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS kind FROM (SELECT doc_id, unnest(range(0, n_chars // 400 + 1)) AS k FROM documents WHERE n_chars >= 1)"


def asof_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("place", F.unix_timestamp("ts"))
    out = dedup.header_before(events, ["user_id"], ["ts", "event_id"], "place", F.col("event_type") == "signup", F.col("event_id"), 86_400)
    return out.where("event_type = 'purchase'").select("event_id", "header", "header_distance")


_ASOF = """
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS place FROM events),
h AS (SELECT event_id, event_type, place, last_value(CASE WHEN event_type = 'signup' THEN struct_pack(v := event_id, p := place) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM e)
SELECT event_id, CASE WHEN place - h.p <= 86400 THEN h.v END AS header, CASE WHEN place - h.p <= 86400 THEN place - h.p END AS header_distance FROM h WHERE event_type = 'purchase'
"""


def axis_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = (F.lit(10.0), F.lit(50.0), F.lit(1.0), F.lit(1000.0), F.col("l_linenumber") % 2 == 0)
    value = N.calibrate(F.col("l_quantity"), *axis)
    return table(spark, sf_dir, "lineitem").select(*line_id(), rounded(value, 4).alias("value"), rounded(N.resolution(F.col("l_quantity"), *axis), 4).alias("resolution"))


def _axis(p: str) -> str:
    return f"CASE WHEN l_linenumber % 2 = 0 THEN pow(10.0, 3 * ({p} - 10) / 40) ELSE 1 + ({p} - 10) / 40 * 999 END"


def broken_axis_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = spark.createDataFrame([("A", 0.0, 20.0, 0.0, 100.0, False), ("A", 30.0, 50.0, 1000.0, 2000.0, False), ("R", 0.0, 50.0, 1.0, 10000.0, True)], "l_returnflag string, p1 double, p2 double, v1 double, v2 double, log boolean")
    out = geometry.broken_axis(table(spark, sf_dir, "lineitem"), segments, ["l_returnflag"], "l_quantity")
    return out.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n_points"), rounded(F.max("value"), 4).alias("value"))


_BROKEN = """
SELECT l_returnflag, l_quantity, count(*) AS n_points, floor(max(CASE WHEN l_returnflag = 'A' AND l_quantity BETWEEN 0 AND 20 THEN l_quantity / 20 * 100 WHEN l_returnflag = 'A' AND l_quantity BETWEEN 30 AND 50 THEN 1000 + (l_quantity - 30) / 20 * 1000
  WHEN l_returnflag = 'R' AND l_quantity BETWEEN 0 AND 50 THEN pow(10.0, l_quantity / 50 * 4) END) * 10000 + 0.5) / 10000 AS value FROM lineitem GROUP BY l_returnflag, l_quantity
"""


def tick_fit_linear_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("pixel"), F.when(F.col("l_orderkey") % 2 == 0, F.pow(F.lit(10.0), F.col("l_linenumber"))).otherwise(F.col("l_linenumber") * 5.0 + 3).alias("value"))
    out = geometry.tick_fit(ticks.groupBy("l_orderkey", "pixel").agg(F.max("value").alias("value")), ["l_orderkey"], "pixel", "value")
    return out.select("l_orderkey", "n_ticks", rounded(F.col("slope"), 3).alias("slope"), rounded(F.col("log_slope"), 6).alias("log_slope"), "scale")


_TICKS = """
WITH t AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS DOUBLE) AS p, CASE WHEN l_orderkey % 2 = 0 THEN pow(10.0, l_linenumber) ELSE l_linenumber * 5.0 + 3 END AS v FROM lineitem),
f AS (SELECT l_orderkey, count(*) AS n, regr_slope(v, p) AS s, regr_r2(v, p) AS r2, regr_slope(log10(v), p) AS ls, regr_r2(log10(v), p) AS lr2 FROM t GROUP BY l_orderkey),
g AS (SELECT *, coalesce(n >= 3 AND r2 >= 0.98 AND NOT isnan(r2), false) AS lin, coalesce(n >= 3 AND lr2 >= 0.98 AND NOT isnan(lr2), false) AS lg FROM f)
SELECT l_orderkey, n AS n_ticks, CASE WHEN n > 1 THEN floor(s * 1000 + 0.5) / 1000 END AS slope, CASE WHEN n > 1 THEN floor(ls * 1000000 + 0.5) / 1000000 END AS log_slope, CASE WHEN lin AND lg THEN 'ambiguous' WHEN lin THEN 'linear' WHEN lg THEN 'log' ELSE 'none' END AS scale FROM g
"""


def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("x", F.col("event_id") % 1000)
    out = geometry.series_summary(events, ["event_type", "user_id"], "x", "value", "props", F.col("value"))
    return out.withColumn("median_resolution", rounded(F.col("median_resolution"), 4))


def vector_marker_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_tax").alias("size"))
    out = geometry.markers(objects, "x", "y", "size", (5.0, 1.0, 40.0, 9.0), [(10.0, 2.0, 15.0, 4.0)], (0.01, 0.06), 2.0)
    return out.select("cell_x", "cell_y", "n_objects", "x", rounded(F.col("y"), 6).alias("y"))


_MARKERS = """
WITH o AS (SELECT l_quantity AS x, l_discount * 100 AS y, l_tax AS size FROM lineitem),
k AS (SELECT *, CAST(floor(x / 2.0) AS BIGINT) AS cell_x, CAST(floor(y / 2.0) AS BIGINT) AS cell_y FROM o WHERE x BETWEEN 5 AND 40 AND y BETWEEN 1 AND 9 AND size BETWEEN 0.01 AND 0.06 AND NOT (x BETWEEN 10 AND 15 AND y BETWEEN 2 AND 4)),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY x, y) AS n, count(*) OVER (PARTITION BY cell_x, cell_y) AS c FROM k)
SELECT cell_x, cell_y, c AS n_objects, x, floor(y * 1000000 + 0.5) / 1000000 AS y FROM r WHERE n = 1
"""


def nearest_anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([(250,), (500,), (750,)], "target long").crossJoin(table(spark, sf_dir, "events").select("user_id").distinct())  # three anchors
    events = table(spark, sf_dir, "events").withColumn("x", F.col("event_id") % 1000)
    out = dedup.nearest(events, targets, ["user_id"], "x", "target", "event_id", ["event_type"])
    return out.select("user_id", "target", "near_x", "near_event_id", "near_event_type", (F.abs(F.col("near_x") - F.col("target")) <= 50).alias("within"))


_NEAREST = """
WITH r AS (SELECT user_id, target, event_id % 1000 AS x, event_id, event_type, row_number() OVER (PARTITION BY user_id, target ORDER BY abs(event_id % 1000 - target), event_id) AS k FROM events CROSS JOIN (SELECT CAST(unnest([250, 500, 750]) AS BIGINT) AS target))
SELECT user_id, target, x AS near_x, event_id AS near_event_id, event_type AS near_event_type, abs(x - target) <= 50 AS within FROM r WHERE k = 1
"""


def gap_island_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01")).alias("day"))
    return dedup.islands(days, ["user_id"], "day", 1).select("user_id", "run_start", "run_end", "n_places")


_ISLANDS = """
WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY day) AS run FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2 THEN 1 ELSE 0 END AS n FROM d))
SELECT user_id, CAST(min(day) AS INTEGER) AS run_start, CAST(max(day) AS INTEGER) AS run_end, count(*) AS n_places FROM g GROUP BY user_id, run
"""


def unused_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.unknown_keys(table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("quality") == 0, 1_000_000_000).otherwise(0)).alias("doc_id")), table(spark, sf_dir, "documents"), "doc_id")


def decision_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).rollup("gate", "category").agg(F.count(F.lit(1)).alias("n_rows"))


def header_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("CNª", "R b(Å)", "NO Conversion (%)", "BET surface area [m2/g]")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    name, unit = X.header_parts(F.col("header"))
    return table(spark, sf_dir, "part").withColumn("header", header).select("p_partkey", name.alias("name"), unit.alias("unit"))


QUERIES = {f.__name__: f for f in (
    unit_quantity_normalize, target_standardize_percent, feature_issue_array, review_gate, withheld_rows, partition_ready_waiting, feature_pivot_unambiguous, metric_conflicts,
    cross_source_conflict, observation_dedup, numeric_overview, group_hash_split, group_leakage, balanced_group_folds, field_coverage, one_hot_encode, multi_hot_encode, vocabulary_fit,
    fold_preprocess_zscore, utility_scores, quality_completeness, comparison_groups, run_ordering, circuit_breaker, batches_of_50, aligned_xy_index, latest_state_per_key,
    interval_overlap_owners, interval_near_duplicates, asof_header, axis_calibrate, broken_axis_segments, tick_fit_linear_log, series_summary, vector_marker_select, nearest_anchor_check,
    gap_island_runs, unused_annotations, decision_rollup, header_inference,
)}

_TRAIN = f"SELECT o.* FROM orders o JOIN ({_SPLIT}) s USING (o_custkey) WHERE s.split = 'train'"
ORACLES = {
    "unit_quantity_normalize": _QUANTITY,
    "target_standardize_percent": _TARGET,
    "feature_issue_array": _ISSUES,
    "review_gate": f"SELECT {_GATE_CASE} AS gate, count(*) AS n_rows, count(value) AS n_values FROM ({_LINES}) GROUP BY 1",
    "withheld_rows": f"SELECT l_orderkey, l_linenumber, reason FROM (SELECT *, {_GATE_CASE} AS reason FROM ({_LINES})) WHERE reason <> 'ml'",
    "partition_ready_waiting": f"SELECT count(*) FILTER (g = 'ml') AS n_ready, count(*) FILTER (g = 'not_approved') AS n_waiting, count(*) FILTER (g NOT IN ('ml', 'not_approved')) AS n_excluded, count(*) AS n_all FROM (SELECT {_GATE_CASE} AS g FROM ({_LINES}))",
    "feature_pivot_unambiguous": _PIVOT,
    "metric_conflicts": "SELECT l_partkey, l_suppkey, count(*) AS n_rows, count(DISTINCT (l_discount, l_tax)) AS n_values FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_discount, l_tax)) > 1",
    "cross_source_conflict": "SELECT l_partkey, l_returnflag, CAST(count(DISTINCT l_quantity) AS INTEGER) AS n_values, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1",
    "observation_dedup": _DEDUP,
    "numeric_overview": "SELECT l_partkey, l_quantity, l_discount, min(l_orderkey * 10 + l_linenumber) AS first_at, count(*) AS n_occurrences, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_orderkey * 10 + l_linenumber) AS suppliers FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "group_hash_split": _SPLIT,
    "balanced_group_folds": _FOLDS,
    "group_leakage": f"SELECT split, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_groups, CAST(0 AS BIGINT) AS n_leaks FROM orders JOIN ({_SPLIT}) USING (o_custkey) GROUP BY split",
    "field_coverage": _COVERAGE,
    "one_hot_encode": _ONEHOT,
    "multi_hot_encode": _MULTI,
    "vocabulary_fit": f"SELECT DISTINCT 'o_orderpriority' AS field, o_orderpriority AS token FROM ({_TRAIN}) UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM ({_TRAIN})",
    "fold_preprocess_zscore": _ZSCORE,
    "utility_scores": _UTILITY,
    "quality_completeness": _QUALITY,
    "comparison_groups": "SELECT mode, l_linestatus, l_linenumber, count(*) AS n_observations, count(DISTINCT l_orderkey) AS n_papers, count(DISTINCT (l_orderkey, l_partkey)) AS n_samples FROM (SELECT *, CASE WHEN l_tax > 0.02 THEN l_returnflag END AS mode FROM lineitem) WHERE mode IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY mode, l_linestatus, l_linenumber",
    "run_ordering": "SELECT o_orderkey, rank, row_number() OVER (ORDER BY rank, o_totalprice DESC, o_orderkey) - 1 AS position FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rank FROM orders)",
    "circuit_breaker": "SELECT user_id, count(*) FILTER (d) AS n_deferred, count(*) FILTER (NOT d) AS n_tried FROM (SELECT user_id, coalesce(max(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS d FROM events) GROUP BY user_id",
    "batches_of_50": "SELECT k // 50 AS batch, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY 1",
    "aligned_xy_index": "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS row_index FROM lineitem",
    "latest_state_per_key": "SELECT user_id, n AS n_events, event_type, value, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "interval_overlap_owners": f"SELECT a.doc_id, count(*) AS n_pairs, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS shared FROM ({_spans(0, 150)}) a JOIN ({_spans(100, 350)}) b ON a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e GROUP BY a.doc_id",
    "interval_near_duplicates": f"""SELECT a.span_id, a.s AS start, a.e AS "end" FROM ({_spans(0, 150)}) a WHERE NOT EXISTS (SELECT 1 FROM ({_spans(10, 140)}) b WHERE (b.kind = 'a' OR b.s > 2000) AND a.doc_id = b.doc_id AND a.kind = b.kind AND a.s < b.e AND b.s < a.e AND (least(a.e, b.e) - greatest(a.s, b.s)) / CAST(greatest(a.e - a.s, b.e - b.s) AS DOUBLE) >= 0.85)""",
    "asof_header": _ASOF,
    "axis_calibrate": f"SELECT l_orderkey, l_linenumber, floor(({_axis('l_quantity')}) * 10000 + 0.5) / 10000 AS value, floor(abs(({_axis('(l_quantity + 0.5)')}) - ({_axis('(l_quantity - 0.5)')})) * 10000 + 0.5) / 10000 AS resolution FROM lineitem",
    "broken_axis_segments": _BROKEN,
    "tick_fit_linear_log": _TICKS,
    "series_summary": "SELECT event_type, user_id, count(*) AS n_points, min(event_id % 1000) AS x_min, max(event_id % 1000) AS x_max, min(value) AS y_min, max(value) AS y_max, floor(median(value) * 10000 + 0.5) / 10000 AS median_resolution, count(DISTINCT props) AS n_methods FROM events GROUP BY event_type, user_id",
    "vector_marker_select": _MARKERS,
    "nearest_anchor_check": _NEAREST,
    "gap_island_runs": _ISLANDS,
    "unused_annotations": "SELECT doc_id + CASE WHEN quality = 0 THEN 1000000000 ELSE 0 END AS doc_id FROM labels WHERE doc_id + CASE WHEN quality = 0 THEN 1000000000 ELSE 0 END NOT IN (SELECT doc_id FROM documents)",
    "decision_rollup": f"SELECT gate, category, count(*) AS n_rows FROM (SELECT {_GATE_CASE} AS gate, category FROM ({_LINES})) GROUP BY ROLLUP (gate, category)",
    "header_inference": "SELECT p_partkey, (['cn', 'r', 'no conversion', 'bet surface area'])[p_partkey % 4 + 1] AS name, (['', 'å', '%', 'm2/g'])[p_partkey % 4 + 1] AS unit FROM part",
}
