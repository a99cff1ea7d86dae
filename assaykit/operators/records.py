"""Measurement records, evidence links and the workspace around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import quantity
from ..schemas import FIELDS
from .review import reasons


def table_records(blocks: DataFrame, specs: DataFrame, key: list[str], row: str, catalyst: str) -> DataFrame:
    """One measurement a table cell that a spec names; the row's condition cells go to each of them.

    ``specs`` has header, property, unit (a small registry, joined by header). Conditions are a map
    property -> (value, unit, raw_value). Issues say what is missing or unreadable.
    """
    category = F.create_map(*[F.lit(x) for name, (kind, _) in FIELDS.items() for x in (name, kind)])
    target = F.create_map(*[F.lit(x) for name, (_, unit) in FIELDS.items() for x in (name, unit)])
    cells = blocks.select(*key, F.col(catalyst).alias("catalyst"), F.explode(F.map_entries(row)).alias("c")).select(*key, "catalyst", F.col("c.key").alias("header"), F.col("c.value").alias("raw_value"))
    known = specs.select("header", "property", "unit").withColumns({"category": F.try_element_at(category, F.col("property")), "target": F.try_element_at(target, F.col("property"))})
    named = cells.join(known, "header").where("category IS NOT NULL")
    named = named.withColumn("q", quantity(F.col("raw_value"), F.col("unit"), F.col("target")))
    is_condition = F.col("category") == "condition"
    entry = F.struct(F.col("q.value").alias("value"), F.col("target").alias("unit"), "raw_value", F.col("q.issue").alias("issue"))
    conditions = named.where(is_condition).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", entry.alias("v"))))).alias("conditions"))
    rows = named.where(~is_condition).join(conditions, key, "left")
    bad = F.transform(F.filter(F.map_entries("conditions"), lambda e: e["value"]["issue"].isNotNull()), lambda e: F.concat(F.lit("condition_"), e["key"], F.lit("_"), e["value"]["issue"]))
    issues = F.concat(F.array_compact(F.array(F.col("q.issue"), F.when(F.coalesce(F.col("catalyst"), F.lit("")) == "", "missing_catalyst"))), F.coalesce(bad, F.array().cast("array<string>")))
    out = rows.select(*key, "catalyst", "property", "category", "raw_value", F.col("unit").alias("raw_unit"), F.col("q.value").alias("value"), F.col("target").alias("unit"), "conditions", issues.alias("issues"), F.lit("pending").alias("review_status"))
    return out.withColumn("record_id", X.digest_id(20, *[F.col(c) for c in (*key, "catalyst", "property", "raw_value", "raw_unit")]))


def linked_evidence(records: DataFrame, evidence: DataFrame, ident: str, ids: str, evidence_id: str, state: str) -> DataFrame:
    """(record, n_evidence, n_found, n_reviewed, issues): each record against its listed evidence."""
    links = records.select(ident, F.explode_outer(F.array_distinct(ids)).alias(evidence_id))
    joined = links.join(evidence.select(evidence_id, F.col(state).alias("__state")), evidence_id, "left")
    out = joined.groupBy(ident).agg(F.count(evidence_id).alias("n_evidence"), F.count("__state").alias("n_found"), F.count_if(F.col("__state") == "reviewed").alias("n_reviewed"))
    return out.withColumn("issues", reasons(no_evidence=F.col("n_evidence") == 0, evidence_missing=F.col("n_found") < F.col("n_evidence"), evidence_not_reviewed=F.col("n_reviewed") < F.col("n_found")))


def same_rows(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, state): equal, changed, only_left or only_right; nulls equal nulls."""
    a = left.select(*key, F.struct(*fields).alias("__a"), F.lit(True).alias("__l"))
    b = right.select(*key, F.struct(*fields).alias("__b"), F.lit(True).alias("__r"))
    state = F.when(F.col("__l").isNull(), "only_right").when(F.col("__r").isNull(), "only_left").when(F.col("__a").eqNullSafe(F.col("__b")), "equal").otherwise("changed")
    return a.join(b, key, "full").select(*key, state.alias("state"))


def rebind_unique(drafts: DataFrame, points: DataFrame, key: list[str], field: str) -> DataFrame:
    """Drafts bound to the one point with their key; none or several leave them unbound."""
    held = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n_matches"), F.min(field).alias(field))
    out = drafts.join(held, key, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))
    return out.withColumn(field, F.when(F.col("n_matches") == 1, F.col(field)))


def merge_equal(records: DataFrame, identity: list[str], evidence: str, roles: str) -> DataFrame:
    """Records of equal content become one: evidence united, and ``value`` wins over other roles."""
    entries = F.flatten(F.collect_list(F.map_entries(roles)))
    held = records.groupBy(*identity).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias(evidence), F.array_sort(F.array_distinct(entries)).alias("__e"), F.count(F.lit(1)).alias("n_merged"))
    values = F.transform(F.filter("__e", lambda e: e["value"] == "value"), lambda e: e["key"])
    role = lambda k: F.when(F.array_contains(values, k), F.lit("value")).otherwise(F.coalesce(F.get(F.filter("__e", lambda e: e["key"] == k), 0)["value"], F.lit("value")))
    return held.withColumn(roles, F.map_from_entries(F.transform(evidence, lambda k: F.struct(k, role(k))))).drop("__e")


def ordinal_pairs(df: DataFrame, key: list[str], labels: str, values: str) -> DataFrame:
    """(key, ord, label, value) where as many labels as values stand ("A, B: 1, 2 respectively")."""
    even = df.where((F.size(labels) == F.size(values)) & (F.size(labels) > 0))
    return even.select(*key, F.posexplode(F.arrays_zip(F.col(labels).alias("label"), F.col(values).alias("value"))).alias("ord", "p")).select(*key, "ord", "p.label", "p.value")


def caption_status(caption: Column, supplement: str = r"(?i)^\s*(?:Fig(?:ure)?\.?\s*S\d|Supplement)") -> Column:
    """numbered, supplementary, unnumbered or missing."""
    return F.when(F.coalesce(F.trim(caption), F.lit("")) == "", "missing").when(caption.rlike(supplement), "supplementary").when(caption.rlike(r"(?i)^\s*(?:Fig(?:ure)?\.?|Scheme|图)\s*\d"), "numbered").otherwise("unnumbered")


def download_plan(records: DataFrame, key: str, decision: str, order: list, limit: int) -> DataFrame:
    """Adds eligibility: download for the first ``limit`` eligible rows in order, else why not."""
    eligible = F.col(decision) == "target"
    first = records.where(eligible).orderBy(*order).limit(limit).groupBy(key).agg(F.lit(True).alias("__yes"))
    joined = records.join(first, key, "left")
    return joined.withColumn("eligibility", F.when(F.col("__yes"), "download").when(F.col(decision) == "non_target", "screened_out").when(F.col(decision) != "target", "awaiting_review").otherwise("over_limit")).drop("__yes")


def snapshot_ok(stored: Column, computed: Column, relative: float = 1e-9) -> Column:
    """Whether a stored reading is what its pixels give."""
    return F.coalesce(F.abs(stored - computed) <= relative * F.greatest(F.abs(stored), F.abs(computed)), F.lit(False))


def resolve(candidates: DataFrame, decisions: DataFrame, key: list[str], value: str) -> DataFrame:
    """Expert choices: the chosen value is approved, its alternatives are rejected; ``--`` means
    not reported and rejects all; keys without a decision stay pending."""
    chosen = decisions.select(*key, F.col("chosen").alias("__chosen"))
    out = candidates.join(chosen, key, "left")
    status = F.when(F.col("__chosen").isNull(), "pending").when(F.col("__chosen") == "--", "rejected").when(F.col(value).cast("string") == F.col("__chosen"), "approved").otherwise("rejected")
    return out.withColumn("review_status", status).drop("__chosen")


def attach_context(facts: DataFrame, records: DataFrame, key: list[str], unit: str) -> DataFrame:
    """Fills a missing record value from the one fact of its key with the record's unit; never
    overwrites. Adds reason: kept, attached, unit_differs, ambiguous or no_fact."""
    held = facts.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(unit, "value")).alias("__f"))
    out = records.join(held, key, "left")
    reason = F.when(F.col("value").isNotNull(), "kept").when(F.col("__n").isNull(), "no_fact").when(F.col("__n") > 1, "ambiguous").when(F.col(f"__f.{unit}") != F.col(unit), "unit_differs").otherwise("attached")
    out = out.withColumn("reason", reason)
    return out.withColumn("value", F.when(F.col("reason") == "attached", F.col("__f.value")).otherwise(F.col("value"))).drop("__n", "__f")


def inventory(df: DataFrame, array: str) -> DataFrame:
    """(item, n_rows, n_pending): counts of the items of an array column."""
    return df.select(F.explode(array).alias("item"), "review_status").groupBy("item").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("review_status") != "reviewed").alias("n_pending"))


PROMPTS = {"negation": "does the sentence deny the effect?", "outlook": "is this an expectation, not a result?", "comparison": "what is it compared with?", "condition": "under which conditions?", "theory": "measured or calculated?"}


def review_prompts(facets: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    """Questions for a reviewer, by facet, in a fixed order."""
    return F.array_compact(F.array(*[F.when(F.array_contains(facets, name), F.lit(text)) for name, text in prompts.items()]))


def near_places(df: DataFrame, key: list[str], order: str, x: str, y: str, reach: float) -> DataFrame:
    """Rows without an earlier row of their key closer than ``reach``. Rows meet in a grid of cells
    of that size (a row looks into the nine cells around it), so only neighbours are compared."""
    cells = df.withColumns({"__cx": F.floor(F.col(x) / reach), "__cy": F.floor(F.col(y) / reach)})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    earlier = cells.select(*key, F.col(order).alias("__o"), F.col(x).alias("__x"), F.col(y).alias("__y"), "__cx", "__cy", F.explode(steps).alias("s"))
    earlier = earlier.select(*key, "__o", "__x", "__y", (F.col("__cx") + F.col("s.i")).alias("__cx"), (F.col("__cy") + F.col("s.j")).alias("__cy"))
    close = (F.col("__o") < F.col(order)) & (F.pow(F.col("__x") - F.col(x), 2) + F.pow(F.col("__y") - F.col(y), 2) < reach * reach)
    dropped = cells.join(earlier, [*key, "__cx", "__cy"]).where(close).select(*key, order).distinct()
    return df.join(dropped, [*key, order], "left_anti")


def latest_versions(df: DataFrame, key: list[str], revision: str) -> DataFrame:
    """Adds ``superseded``: a row of the key has a higher revision."""
    return df.withColumn("superseded", F.col(revision) < F.max(revision).over(Window.partitionBy(*key)))
