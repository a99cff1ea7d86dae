"""Merging records that describe one thing. Order matters, so every merge takes an order column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def filled(c: Column) -> Column:
    """Null for empty text."""
    return F.when(c.cast("string") != "", c)


def merge_first(df: DataFrame, key: list[str], order: str, scalars: list[str], lists: list[str] = (), maps: list[str] = ()) -> DataFrame:
    """One row a key: the first non-empty scalar in order, the ordered distinct union of lists,
    and maps whose later entries win."""
    aggs = [F.min_by(F.col(c), F.when(filled(F.col(c)).isNotNull(), F.col(order))).alias(c) for c in scalars]
    for c in maps:
        entries = F.array_sort(F.flatten(F.collect_list(f"__{c}")))
        last = F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["key"] != e["key"], F.lit(True)))
        aggs.append(F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))).alias(c))
    placed = df.withColumns({f"__{c}": F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), F.col(order).alias("o"), e["value"].alias("value"))) for c in maps})
    out = placed.groupBy(*key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_merged"), *aggs)
    for c in lists:
        # each element once a key, at its first place, before any list is gathered
        items = df.select(*key, order, F.posexplode(c).alias("__k", "__v"))
        first = items.groupBy(*key, "__v").agg(F.min(F.struct(order, "__k")).alias("__o"))
        held = F.array_sort(F.collect_list(F.struct("__o", "__v")))
        own = first.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.transform(held, lambda x: x["__v"]).alias(c))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
        out = out.join(own, same, "left").drop(*[f"__{k}" for k in key]).withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    return out.select(*key, order, "n_merged", *scalars, *lists, *maps)


def bridged_key(df: DataFrame, doi: str, title: str, year: str, order: str) -> DataFrame:
    """Adds ``merge_key``: the DOI, else title and year; the first record with a DOI that comes
    after an undated-by-DOI record of the same title and year joins that record's key.

    The bridge is one-way, as it depends on order: a record without DOI that comes after one with
    a DOI stays on its own. All records of a DOI follow its first bridge. (A record of a bridged
    DOI under another title follows too, where a strictly sequential merge would open a new row.)
    """
    ids = df.withColumns({"__doi": X.doi_harvest(F.col(doi)), "__title": X.title_key(F.col(title))})
    plain = F.concat_ws(X.SEPARATOR, F.lit("title"), F.col("__title"), F.coalesce(F.col(year).cast("string"), F.lit("")))
    ids = ids.withColumn("__plain", plain)
    # aggregates joined back, so that neither a common title nor the rows without DOI meet in a task
    titled = ids.where(F.col("__title") != "").select("__plain", "__doi", F.col(order).alias("__o"))
    first = titled.where(F.col("__doi") == "").groupBy("__plain").agg(F.min("__o").alias("__first"))
    adopts = titled.where(F.col("__doi") != "").join(first, "__plain").where(F.col("__o") > F.col("__first"))
    adopts = adopts.groupBy("__plain").agg(F.min(F.struct("__o", "__doi")).alias("__a"))  # of a title, the first that opens
    bridge = adopts.groupBy(F.col("__a.__doi").alias("__doi")).agg(F.min_by("__plain", F.col("__a.__o")).alias("__to"))
    ids = ids.join(bridge, "__doi", "left")  # no bridge has an empty DOI
    key = F.when(F.col("__doi") == "", F.col("__plain")).otherwise(F.coalesce("__to", F.concat(F.lit("doi" + X.SEPARATOR), F.col("__doi"))))
    return ids.withColumn("merge_key", key).drop("__doi", "__title", "__plain", "__to")


def merge_longest(df: DataFrame, key: list[str], order: str, longest: str, scalars: list[str]) -> DataFrame:
    """First filled scalars; ``longest`` keeps one source's text whole: the longest, first on ties."""
    length = F.length(F.coalesce(F.col(longest), F.lit("")))
    aggs = [F.min_by(F.col(c), F.when(filled(F.col(c)).isNotNull(), F.col(order))).alias(c) for c in scalars]
    best = F.max_by(F.struct(F.col(longest).alias("text"), F.col(order).alias("o")), F.struct(length, -F.col(order)))
    return df.groupBy(*key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_sources"), best["text"].alias(longest), best["o"].alias(f"{longest}_from"), *aggs)


def alternatives(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Distinct values of each key; more than one is a conflict, never resolved here."""
    held = F.array_sort(F.collect_set(filled(F.col(value))))
    return df.groupBy(*key).agg(held.alias("alternatives"), (F.size(held) > 1).alias("conflict"), F.count(F.lit(1)).alias("n_rows"))


def enrich(base: DataFrame, key: str, value: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Fills a missing ``value`` from the first source that has one; never replaces. Adds
    ``<value>_source`` (base, the source's name, or null). Sources have (key, value), one row a key."""
    out = base.withColumns({value: filled(F.col(value)), f"{value}_source": F.when(filled(F.col(value)).isNotNull(), "base")})
    for name, source in sources:
        own = source.select(F.col(key), filled(F.col(value)).alias("__v"))
        out = out.join(own, key, "left")
        out = out.withColumns({f"{value}_source": F.coalesce(f"{value}_source", F.when(F.col("__v").isNotNull(), name)), value: F.coalesce(value, "__v")}).drop("__v")
    return out


def carry_over(new: DataFrame, old: DataFrame, key: str, sensitive: list[str], state: str = "review_status") -> DataFrame:
    """Review state of a new extraction: kept where the sensitive fields are unchanged, else
    ``unreviewed`` with the state before; what vanished stays as ``stale``; new rows are
    ``unreviewed``."""
    left = new.select(key, *[F.col(c).alias(f"new_{c}") for c in sensitive], F.lit(True).alias("__new"))
    right = old.select(key, *[F.col(c).alias(f"old_{c}") for c in sensitive], F.col(state).alias("previous_status"), F.lit(True).alias("__old"))
    same = F.lit(True)
    for c in sensitive:
        same = same & F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}"))
    now = F.when(F.col("__new").isNull(), "stale").when(F.col("__old").isNull(), "unreviewed").when(same, F.col("previous_status")).otherwise("unreviewed")
    return left.join(right, key, "full").withColumn(state, now).drop("__new", "__old")


def keep_last_value(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key at its first position, with the values of its last row."""
    rest = [c for c in df.columns if c not in (*key, order)]
    return df.groupBy(*key).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), F.col(order)).alias("__v")).select(*key, order, *[F.col(f"__v.{c}").alias(c) for c in rest])
