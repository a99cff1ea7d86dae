"""Screening, text and bibliographic queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, merge, review, screening

# A profile for the tables' invented vocabulary.
GROUPS = {"motion": "tion[a-z]*ing", "shade": "ndsh|shnd|stsh", "place": "thatth|ofth|inth"}
PRIORITY = {"reaction": "tionti|ingre", "material": "ble[a-z]*th", "experimental": "haing|wher", "performance": "[0-9]+", "conditions": "eron|onst", "characterization": "esth|edan"}
WEIGHTS = {"reaction": 40, "material": 15, "experimental": 15, "performance": 10, "conditions": 10, "characterization": 10}
STRONG, TERMS = ["tionting", "ofthble"], ["whreth", "ndhean", "eringth"]
EXPERIMENTAL, REVIEW, COMPUTATIONAL, NEGATIVE = "haing|inger", "license|rights", "ouou", "ciónes|keiten"
ROLES = {"model": "tiontion", "spectrum": "ndnd", "sorption": "haha", "performance": "ingth", "material": "rees", "schematic": "ouon"}
SQUASH = "[^a-z0-9]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("title", F.substring_index("text", "\n", 1))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.concept_groups(table(spark, sf_dir, "documents"), "text", GROUPS, F.col("text"), {"fr": "review"}, F.col("lang"))


def screen_concept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).select("doc_id", *[F.size(f"hits_{g}").alias(f"n_{g}") for g in GROUPS], "n_groups", "coverage", F.array_join("missing", ",").alias("missing"), "decision")


def _hits(p: str) -> str:
    return f"least(12, len(list_distinct(regexp_extract_all(text, '{p}'))))"


_GROUP_SQL = ", ".join(f"CAST({_hits(p)} AS INTEGER) AS n_{g}" for g, p in GROUPS.items())
_N_SQL = " + ".join(f"CAST(n_{g} > 0 AS INTEGER)" for g in GROUPS)
_SCREEN = f"""
SELECT doc_id, n_motion, n_shade, n_place, n_groups, floor(n_groups / 3.0 * 10000 + 0.5) / 10000 AS coverage,
       concat_ws(',', CASE WHEN n_motion = 0 THEN 'motion' END, CASE WHEN n_shade = 0 THEN 'shade' END, CASE WHEN n_place = 0 THEN 'place' END) AS missing,
       CASE WHEN n_groups = 3 THEN CASE WHEN lang = 'fr' THEN 'review' ELSE 'target' END
            WHEN n_groups > 0 OR coalesce(trim(text), '') = '' THEN 'review' ELSE 'non_target' END AS decision, source, lang
FROM (SELECT *, {_N_SQL} AS n_groups FROM (SELECT doc_id, text, lang, source, {_GROUP_SQL} FROM documents))
"""


def screen_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    first = docs.withColumn("d", screening.decision_list(F.col("text"), STRONG, TERMS, EXPERIMENTAL, REVIEW, COMPUTATIONAL, NEGATIVE))
    final = screening.quality_overrides(F.col("d.decision"), F.col("d.article_type"), F.when(F.col("n_chars") < 40, "failed"), F.lit(False), F.when(F.col("n_chars") < 80, F.lit(False)), F.col("text"), F.col("lang"), F.col("title").rlike("heer"), "zh-review")
    return first.withColumn("f", final).select("doc_id", F.col("d.decision").alias("rule_decision"), F.col("d.article_type").alias("rule_type"), F.col("f.decision").alias("decision"), F.col("f.article_type").alias("article_type"))


def _has(p: str, c: str = "text") -> str:
    return f"coalesce(regexp_matches({c}, '{p}'), false)"


_DECISION = f"""
WITH flags AS (
  SELECT doc_id, text, n_chars, split_part(text, chr(10), 1) AS title, ({' OR '.join(_has(p) for p in STRONG)}) AS strong,
         ({' + '.join(f'CAST({_has(p)} AS INTEGER)' for p in TERMS)}) AS terms, {_has(EXPERIMENTAL)} AS e, {_has(REVIEW)} AS r, {_has(COMPUTATIONAL)} AS m, {_has(NEGATIVE)} AS o
  FROM documents
), rule AS (
  SELECT *, CASE WHEN r AND (strong OR terms >= 2) THEN 'review|review_article' WHEN m AND NOT e AND (strong OR terms >= 2) THEN 'review|computational_or_mechanistic'
    WHEN strong AND e THEN 'target|experimental_primary' WHEN strong OR terms >= 2 THEN 'review|uncertain' WHEN o THEN 'non_target|other_reaction' ELSE 'non_target|insufficient_evidence' END AS d FROM flags
), final AS (
  SELECT *, CASE WHEN n_chars < 80 THEN 'review|uncertain' WHEN coalesce(trim(text), '') = '' THEN 'review|uncertain'
    WHEN {_has('heer', 'title')} AND split_part(d, '|', 1) <> 'non_target' AND split_part(d, '|', 2) <> 'insufficient_evidence' THEN 'review|uncertain'
    WHEN {_has('heer', 'title')} THEN 'non_target|other' WHEN d = 'non_target|insufficient_evidence' THEN 'review|uncertain' ELSE d END AS f FROM rule
)
SELECT doc_id, split_part(d, '|', 1) AS rule_decision, split_part(d, '|', 2) AS rule_type, split_part(f, '|', 1) AS decision, split_part(f, '|', 2) AS article_type FROM final
"""


def scored(df: DataFrame) -> DataFrame:
    return df.withColumns(screening.priority_score([F.col("title"), F.col("text")], PRIORITY, WEIGHTS))


_PRIORITY = "SELECT *, floor(s * 100 + 0.5) / 100 AS priority_score FROM (SELECT *, " + " + ".join(f"CASE WHEN {_has(p)} THEN {float(WEIGHTS[k])} ELSE 0.0 END" for k, p in PRIORITY.items()) + " AS s FROM documents)"


def screening_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = screening.concept_groups(documents(spark, sf_dir), "text", GROUPS, F.col("text"), {"fr": "review"}, F.col("lang"))
    return screening.decision_counts(scored(docs), ["source"], more={"top_score": F.max("priority_score")})


def priority_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir)).orderBy(F.desc("priority_score"), "doc_id").limit(50).select("doc_id", "priority_score")


def chart_role_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(screening.roles(F.col("text"), ROLES), ",").alias("roles"))


def document_type_from_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # a text's blocks are its lines: counted and joined in place, no text is shuffled
    whole = docs.where("text IS NOT NULL").select("doc_id", "lang", "title", F.translate("text", "\n", " ").alias("text"), F.regexp_count("text", F.lit("\n")).cast("long").alias("breaks")).withColumn("n_blocks", F.col("breaks") + 1)
    kind = screening.document_type(F.col("lang"), F.col("title"), F.col("text"), F.col("n_blocks") > 40, ["haing", "ndea", "wher", "tionha", "oner"], "zh-review", "thstinnt", "license", "eriner")
    return whole.select("doc_id", "n_blocks", kind.alias("document_type"))


_DOCTYPE = f"""
WITH b AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, title, CAST(len(parts) AS BIGINT) AS n_blocks, array_to_string(parts, ' ') AS text FROM b)
SELECT doc_id, n_blocks, CASE WHEN n_blocks > 40 THEN 'structured_data' WHEN {_has('thstinnt', 'title')} THEN 'review' WHEN {_has('license')} THEN 'review'
  WHEN {_has('eriner', 'title')} THEN 'supplementary_information'
  WHEN {' + '.join(f'CAST({_has(p)} AS INTEGER)' for p in ['haing', 'ndea', 'wher', 'tionha', 'oner'])} >= 2 THEN 'research_article' ELSE 'unknown' END AS document_type FROM w
"""


def sentence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "quote"))
    return rows.select("doc_id", "sentence_no", F.length("quote").alias("n_chars"), F.md5("quote").alias("quote_md5"))


_SENT = r"""
list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '([。!?]+)', '\1' || chr(2), 'g'), '\.(\s+[A-Z])', '.' || chr(2) || '\1', 'g'), chr(2)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')
"""
_SENTENCES = f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_no, CAST(length(s[i]) AS INTEGER) AS n_chars, md5(s[i]) AS quote_md5
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT.format(c='text')} AS s FROM documents))
"""


#: A made-up vocabulary, as the texts are made up.
CLAIMS = screening.ClaimProfile(
    report="mentre|thion|ablety|eshand",
    amounts=(("share", r"([0-9]+) of them"),),
    kinds=(("prospective_claim", "ouour|haea"), ("negated_statement", "nicht |ndwh"), ("mechanistic_interpretation", "tionre"), ("reported_comparison", r"(?i)\bthan\b|reshen")),
    against=r"than\s+([a-z]+)",
)


def semantic_change_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = screening.claims(docs, "text", CLAIMS)
    return found.groupBy("doc_id", "statement_type").agg(F.count(F.lit(1)).alias("n_claims"), F.count("comparator").alias("n_comparators"), F.min("sentence_no").alias("first_sentence"))


_CLAIMS = rf"""
WITH s AS (SELECT doc_id, i - 1 AS sentence_no, s[i] AS q FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT.format(c='text')} AS s FROM documents))),
c AS (SELECT *, CASE WHEN regexp_matches(q, 'ouour|haea') THEN 'prospective_claim' WHEN regexp_matches(q, 'nicht |ndwh') THEN 'negated_statement'
    WHEN regexp_matches(q, 'tionre') THEN 'mechanistic_interpretation'
    WHEN regexp_matches(q, '(?i)\bthan\b|reshen') OR regexp_matches(q, '[0-9]+ of them') THEN 'reported_comparison' ELSE 'qualitative_observation' END AS statement_type,
    nullif(trim(regexp_extract(q, 'than\s+([a-z]+)', 1)), '') AS comparator
  FROM s WHERE regexp_matches(q, 'mentre|thion|ablety|eshand') OR regexp_matches(q, '[0-9]+ of them'))
SELECT doc_id, statement_type, count(*) AS n_claims, count(comparator) AS n_comparators, CAST(min(sentence_no) AS INTEGER) AS first_sentence FROM c GROUP BY ALL
"""


def previous_sentence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), F.md5(F.lag("text").over(w)).alias("previous_md5"))


def repeated_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("quote")).where(F.length("quote") >= 20)
    return lines.groupBy("quote").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1").select(F.md5("quote").alias("quote_md5"), "n_docs", "first_doc")


def html_text_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.plain_text(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


_STRIP = r"""
SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(translate(
  replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '−–—‐', '----'), '\s+', ' ', 'g')) AS t FROM pages)
"""


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(X.links(F.col("html"))).alias("link_no", "href"))
    return rows.select("page_id", "link_no", "href")


ROUTES = {"com": ["example.com"], "org": ["example.org"], "net": ["example.net"]}


def url_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.url_host(F.col("url")).alias("host"), X.route(F.col("url"), ROUTES).alias("route"))


def url_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.url_valid(F.col("url")).alias("valid"), F.regexp_replace("url", r"(?i)((?:utm_source|ref)=)[^&#\s]+", "$1[redacted]").alias("redacted"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", X.title_key(F.col("title")).alias("title_key"), "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"), F.col("quality").cast("string").alias("quality"), F.array(F.concat("lang", F.lit(":"), "source")).alias("tags"), "text", F.create_map("source", F.col("doc_id").cast("string")).alias("ids"))


def bib_merge_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.merge_first(bib(spark, sf_dir).where("title_key <> ''"), ["title_key"], "doc_id", ["lang", "source", "quality"], ["tags"])
    return out.select(F.md5("title_key").alias("key_md5"), "doc_id", "n_merged", "lang", "source", "quality", F.array_join("tags", ",").alias("tags"))


_BIB = f"""
WITH b AS (SELECT d.doc_id, trim(regexp_replace(lower(split_part(d.text, chr(10), 1)), '{SQUASH}', ' ', 'g')) AS k, lang, CASE WHEN d.doc_id % 3 <> 0 THEN source END AS source,
  CAST(quality AS VARCHAR) AS quality, lang || ':' || d.source AS tag, text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
t AS (SELECT k, string_agg(tag, ',' ORDER BY o) AS tags FROM (SELECT k, tag, min(doc_id) AS o FROM b GROUP BY k, tag) GROUP BY k),
m AS (SELECT k, min(doc_id) AS doc_id, count(*) AS n_merged, min_by(lang, doc_id) FILTER (lang <> '') AS lang, min_by(source, doc_id) FILTER (source <> '') AS source,
  min_by(quality, doc_id) FILTER (quality <> '') AS quality FROM b WHERE k <> '' GROUP BY k)
SELECT md5(k) AS key_md5, doc_id, n_merged, lang, source, quality, tags FROM m JOIN t USING (k)
"""


def bib_merge_longest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.merge_longest(bib(spark, sf_dir), ["title_key"], "doc_id", "text", ["source"])
    return out.select(F.md5("title_key").alias("key_md5"), "doc_id", "n_sources", "text_from", F.length("text").alias("n_chars"), "source")


_LONGEST = f"""
WITH b AS (SELECT doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '{SQUASH}', ' ', 'g')) AS k, CASE WHEN doc_id % 3 <> 0 THEN source END AS source, text FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(coalesce(text, '')) DESC, doc_id) AS n FROM b)
SELECT md5(k) AS key_md5, min(doc_id) AS doc_id, count(*) AS n_sources, min(CASE WHEN n = 1 THEN doc_id END) AS text_from, CAST(max(CASE WHEN n = 1 THEN length(text) END) AS INTEGER) AS n_chars,
  min_by(source, doc_id) FILTER (source <> '') AS source FROM r GROUP BY k
"""


def bib_bridged_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("https://doi.org/10.1000/"), F.col("doc_id") % 40)).alias("doi"), "title", F.length("lang").alias("year"))
    keyed = merge.bridged_key(rows, "doi", "title", "year", "doc_id")
    return merge.merge_first(keyed, ["merge_key"], "doc_id", ["doi", "title"]).select("doc_id", "n_merged", X.doi_harvest(F.col("doi")).alias("doi"))


_BRIDGED = f"""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN '10.1000/' || (doc_id % 40) ELSE '' END AS doi, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '{SQUASH}', ' ', 'g')) AS t, length(lang) AS y FROM documents),
plain AS (SELECT t, y, min(doc_id) AS o FROM b WHERE doi = '' AND t <> '' GROUP BY t, y),
adopts AS (SELECT b.t, b.y, min(doc_id) AS o FROM b JOIN plain p ON b.t = p.t AND b.y IS NOT DISTINCT FROM p.y WHERE doi <> '' AND doc_id > p.o GROUP BY b.t, b.y),
bridge AS (SELECT b.doi, arg_min('title|' || b.t || '|' || coalesce(CAST(b.y AS VARCHAR), ''), b.doc_id) AS k FROM b JOIN adopts a ON b.doc_id = a.o GROUP BY b.doi),
keyed AS (SELECT b.doc_id, b.doi, CASE WHEN b.doi = '' THEN 'title|' || b.t || '|' || coalesce(CAST(b.y AS VARCHAR), '') ELSE coalesce(r.k, 'doi|' || b.doi) END AS k FROM b LEFT JOIN bridge r ON b.doi = r.doi)
SELECT min(doc_id) AS doc_id, count(*) AS n_merged, coalesce(min_by(doi, doc_id) FILTER (doi <> ''), '') AS doi FROM keyed GROUP BY k
"""


def import_conflict_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.alternatives(bib(spark, sf_dir), ["title_key"], "source")
    return out.select(F.md5("title_key").alias("key_md5"), "n_rows", "conflict", F.array_join("alternatives", ",").alias("alternatives"))


_ALT = f"""
WITH b AS (SELECT trim(regexp_replace(lower(split_part(text, chr(10), 1)), '{SQUASH}', ' ', 'g')) AS k, CASE WHEN doc_id % 3 <> 0 THEN source END AS s FROM documents)
SELECT md5(k) AS key_md5, count(*) AS n_rows, count(DISTINCT s) > 1 AS conflict, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS alternatives FROM b GROUP BY k
"""


def inverted_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    index = X.inverted(rows, ["conv_id", "turn"], "text").withColumn("back", X.revert_strict(F.col("index")))
    joined = rows.join(index, ["conv_id", "turn"])
    return joined.select("conv_id", "turn", F.size(F.flatten(F.map_values("index"))).alias("n_words"), F.size("index").alias("n_distinct"), (F.col("back") == F.col("text")).alias("same"))


def title_normalize_record_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", X.title_key(F.col("p_name")).alias("title_key"), X.record_id(F.lit(None).cast("string"), F.col("p_name"), F.col("p_size")).alias("record_id"))


def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.element_at(F.array(F.lit("https://doi.org/"), F.lit("DOI: "), F.lit("http://dx.doi.org/"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("10.1000/ABC."), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, F.lit(".,")).otherwise(F.lit("")))
    return table(spark, sf_dir, "part").withColumn("raw", raw).select("p_partkey", X.doi_harvest(F.col("raw")).alias("harvest"), X.doi_screening(F.col("raw")).alias("screening"), X.doi_canonical(F.col("raw")).alias("canonical"))


_DOI = r"""
WITH r AS (SELECT p_partkey, (['https://doi.org/', 'DOI: ', 'http://dx.doi.org/', ''])[p_partkey % 4 + 1] || '10.1000/ABC.' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.,' ELSE '' END AS raw FROM part)
SELECT p_partkey, regexp_replace(lower(regexp_replace(regexp_replace(raw, '^https?://(?:dx\.)?doi\.org/', '', 'i'), '^doi:\s*', '', 'i')), '[.,;)]+$', '') AS harvest,
  lower(trim(regexp_replace(raw, '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', '', 'i'))) AS screening,
  regexp_replace(lower(regexp_replace(raw, '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', '', 'i')), '[.,;)\]}>]+$', '') AS canonical FROM r
"""


def manual_decision_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, "target").otherwise("review").alias("automatic"))
    manual = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "non_target").when(F.col("toxic") == 1, "review").otherwise("").alias("decision"))
    out = review.apply_decisions(docs, manual, ["doc_id"])
    final = review.override(F.col("automatic"), F.col("manual_decision"))
    return out.select("doc_id", "automatic", "manual_decision", final.alias("decision"), (final == "target").alias("retained"))


_MANUAL = """
SELECT d.doc_id, d.automatic, l.m AS manual_decision, coalesce(nullif(trim(l.m), ''), d.automatic) AS decision, coalesce(nullif(trim(l.m), ''), d.automatic) = 'target' AS retained
FROM (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'target' ELSE 'review' END AS automatic FROM documents) d
LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN 'non_target' WHEN toxic = 1 THEN 'review' ELSE '' END AS m FROM labels) l USING (doc_id)
"""


def abstract_enrichment_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("abstract"))
    first = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("abstract"))
    second = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("abstract"))
    return merge.enrich(base, "id", "abstract", [("supplier", first), ("nation", second)])


_ENRICH = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'base' WHEN s_suppkey % 2 = 0 THEN 'supplier' WHEN n_name IS NOT NULL THEN 'nation' END AS abstract_source,
  CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN s_suppkey % 2 = 0 THEN s_name ELSE n_name END AS abstract
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_custkey
"""


def reextract_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    new = docs.where("lang <> 'es'").select("doc_id", "lang", F.when(F.col("doc_id") % 4 == 0, F.lit("changed")).otherwise(F.col("source")).alias("source"))
    old = docs.where("n_chars >= 300").select("doc_id", "lang", "source", F.when(F.col("n_chars") > 500, "reviewed").otherwise("draft").alias("review_status"))
    return merge.carry_over(new, old, "doc_id", ["lang", "source"]).select("doc_id", "previous_status", "review_status")


_CARRY = """
WITH n AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN 'changed' ELSE source END AS source FROM documents WHERE lang <> 'es'),
o AS (SELECT doc_id, lang, source, CASE WHEN n_chars > 500 THEN 'reviewed' ELSE 'draft' END AS st FROM documents WHERE n_chars >= 300)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, o.st AS previous_status, CASE WHEN n.doc_id IS NULL THEN 'stale' WHEN o.doc_id IS NULL THEN 'unreviewed'
  WHEN n.lang IS NOT DISTINCT FROM o.lang AND n.source IS NOT DISTINCT FROM o.source THEN o.st ELSE 'unreviewed' END AS review_status FROM n FULL JOIN o ON n.doc_id = o.doc_id
"""


def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (F.lower(F.substring_index("text", ".", 1)).alias("field"), F.lower(F.substring_index("text", " ", 1)).alias("stem"))
    gold = table(spark, sf_dir, "benchmark").select("item_id", *fields)
    return dedup.coverage(gold, table(spark, sf_dir, "documents").select(*fields), ["field"], ["stem"]).select("item_id", "status")


_GOLD = """
SELECT item_id, CASE WHEN lower(split_part(text, '.', 1)) IN (SELECT lower(split_part(text, '.', 1)) FROM documents) THEN 'covered'
  WHEN lower(split_part(text, ' ', 1)) IN (SELECT lower(split_part(text, ' ', 1)) FROM documents) THEN 'partial' ELSE 'missing' END AS status FROM benchmark
"""


def csv_injection_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.element_at(F.array(F.lit("="), F.lit("  +"), F.lit("-"), F.lit("@"), F.lit(""), F.lit("\t")), (F.col("turn") % 6 + 1).cast("int")), "role")
    return table(spark, sf_dir, "conversations").withColumn("cell", cell).select("conv_id", "turn", X.csv_guard(F.col("cell")).alias("cell"))


_GUARD = r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(ltrim(cell), '^[=+\-@]') OR regexp_matches(cell, '^[\t\r]') THEN '''' || cell ELSE cell END AS cell
FROM (SELECT *, (['=', '  +', '-', '@', '', chr(9)])[turn % 6 + 1] || role AS cell FROM conversations)
"""


def ris_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import ris_rows

    part = table(spark, sf_dir, "part").select(F.concat(F.lit("10.1000/"), F.col("p_partkey") % 500).alias("doi"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("p_partkey").alias("ord"))
    return ris_rows(part, "ord").select("doi", "ris")


_RIS = """
SELECT doi, 'TY  - JOUR' || chr(10) || 'TI  - ' || title || chr(10) || 'PY  - ' || year || chr(10) || 'DO  - ' || doi || chr(10) || 'ER  - ' AS ris
FROM (SELECT '10.1000/' || (p_partkey % 500) AS doi, min_by(p_name, p_partkey) AS title, min_by(p_size, p_partkey) AS year FROM part GROUP BY 1)
"""


def span_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({"start": F.col("doc_id") % 30, "end": F.col("doc_id") % 30 + 20})
    quote = F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 20)).otherwise(F.substring(F.col("text"), F.col("start").cast("int") + 1, F.lit(20)))
    return docs.select("doc_id", X.span_ok(F.col("text"), F.col("start"), F.col("end"), quote).alias("intact"))


_SPAN = """
SELECT doc_id, coalesce(s + 20 <= length(text) AND substr(text, s + 1, 20) = CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 20) ELSE substr(text, s + 1, 20) END, false) AS intact
FROM (SELECT *, doc_id % 30 AS s FROM documents)
"""


def table_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = F.filter(F.split("text", "\n"), lambda line: line.contains("|"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(bars).alias("n_rows"), F.md5(F.coalesce(F.array_join(bars, "\n"), F.lit(""))).alias("rows_md5"))


_TABLE = r"""
SELECT doc_id, CAST(len(b) AS INTEGER) AS n_rows, md5(coalesce(array_to_string(b, chr(10)), '')) AS rows_md5 FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')) AS b FROM documents)
"""

QUERIES = {f.__name__: f for f in (
    screen_concept_groups, screen_decision_list, screening_counts_by_source, priority_score_topk, chart_role_multilabel, document_type_from_blocks, sentence_blocks,
    semantic_change_claims, previous_sentence_context, repeated_quotes, html_text_strip, html_links, url_route, url_validity, bib_merge_first_nonempty,
    bib_merge_longest_text, bib_bridged_merge, import_conflict_alternatives, inverted_index_roundtrip, title_normalize_record_id, doi_normalize, manual_decision_override,
    abstract_enrichment_precedence, reextract_carry_over, gold_coverage, csv_injection_guard, ris_export_rows, span_integrity, table_passages,
)}

ORACLES = {
    "screen_concept_groups": f"SELECT doc_id, n_motion, n_shade, n_place, n_groups, coverage, missing, decision FROM ({_SCREEN})",
    "screen_decision_list": _DECISION,
    "screening_counts_by_source": f"SELECT s.source, count(*) FILTER (decision = 'target') AS n_target, count(*) FILTER (decision = 'review') AS n_review, count(*) FILTER (decision = 'non_target') AS n_non_target, count(*) AS n_all, max(priority_score) AS top_score FROM ({_SCREEN}) s JOIN ({_PRIORITY}) p USING (doc_id) GROUP BY s.source",
    "priority_score_topk": f"SELECT doc_id, priority_score FROM ({_PRIORITY}) ORDER BY priority_score DESC, doc_id LIMIT 50",
    "chart_role_multilabel": "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_has(p)} THEN '{k}' END" for k, p in ROLES.items()) + ") AS roles FROM documents",
    "document_type_from_blocks": _DOCTYPE,
    "sentence_blocks": _SENTENCES,
    "semantic_change_claims": _CLAIMS,
    "previous_sentence_context": "SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, md5(lag(text) OVER w) AS previous_md5 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "repeated_quotes": "SELECT md5(q) AS quote_md5, n_docs, first_doc FROM (SELECT q, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS q FROM documents) WHERE length(q) >= 20 GROUP BY q) WHERE n_docs > 1",
    "html_text_strip": _STRIP,
    "html_links": """SELECT page_id, CAST(i - 1 AS INTEGER) AS link_no, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1) AS h FROM pages))""",
    "url_route": f"SELECT page_id, host, CASE WHEN host LIKE '%example.com' THEN 'com' WHEN host LIKE '%example.org' THEN 'org' WHEN host LIKE '%example.net' THEN 'net' ELSE 'other' END AS route FROM (SELECT page_id, {_HOST} AS host FROM pages)",
    "url_validity": rf"SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#@\s]+(?:[/?#]|$)') AND {_HOST} LIKE '%.%' AS valid, regexp_replace(url, '((?:utm_source|ref)=)[^&#\s]+', '\1[redacted]', 'gi') AS redacted FROM pages",
    "bib_merge_first_nonempty": _BIB,
    "bib_merge_longest_text": _LONGEST,
    "bib_bridged_merge": _BRIDGED,
    "import_conflict_alternatives": _ALT,
    "inverted_index_roundtrip": "SELECT conv_id, turn, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_words, CAST(len(list_distinct(string_split(text, ' '))) AS INTEGER) AS n_distinct, true AS same FROM conversations",
    "title_normalize_record_id": f"SELECT p_partkey, t AS title_key, substr(sha256(t || '|' || p_size), 1, 20) AS record_id FROM (SELECT *, trim(regexp_replace(lower(p_name), '{SQUASH}', ' ', 'g')) AS t FROM part)",
    "doi_normalize": _DOI,
    "manual_decision_override": _MANUAL,
    "abstract_enrichment_precedence": _ENRICH,
    "reextract_carry_over": _CARRY,
    "gold_coverage": _GOLD,
    "csv_injection_guard": _GUARD,
    "ris_export_rows": _RIS,
    "span_integrity": _SPAN,
    "table_passages": _TABLE,
}
