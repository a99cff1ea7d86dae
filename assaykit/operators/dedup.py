"""Duplicates and conflicts: reported, blocked or listed, never averaged away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .review import reasons


def conflicts(df: DataFrame, identity: list[str], signature: list[str]) -> DataFrame:
    """Identities with more than one distinct signature."""
    return df.groupBy(*identity).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*signature).alias("n_values")).where("n_values > 1")


def observation_codes(df: DataFrame, source: str, paper: str, observation: str, content: str, experiment: list[str], label: str, evidence: str) -> DataFrame:
    """Adds ``codes``: why a row may not count as an observation of its own.

    conflicting_source_doi      a source is filed under several papers
    repeated_record             the same observation again, equal content (only the first counts)
    conflicting_record_copy     one observation id with different contents
    duplicate_experiment        another row of the experiment with an equal label
    conflicting_experiment      another row of the experiment with a different label
    reused_value_evidence       one value's evidence serves several rows

    Grouped aggregates are joined back, so that no key's rows meet in one task.
    """
    rank = F.row_number().over(Window.partitionBy(observation, content).orderBy(*sorted(df.columns)))
    sources = df.groupBy(source).agg(F.count_distinct(F.nullif(F.col(paper), F.lit(""))).alias("__papers"))
    copies = df.groupBy(observation).agg(F.count_distinct(content).alias("__contents"))
    marked = df.withColumn("__copy", rank).join(sources, source).join(copies, observation)
    counted = (F.col("__papers") <= 1) & (F.col("__contents") == 1) & (F.col("__copy") == 1)
    marked = marked.withColumn("__counted", counted)
    alive = marked.where("__counted")
    tries = alive.groupBy(*experiment).agg(F.count(F.lit(1)).alias("__tries"), F.count_distinct(label).alias("__labels"))
    uses = alive.groupBy(source, evidence).agg(F.count(F.lit(1)).alias("__uses"))
    marked = marked.join(tries, experiment, "left").join(uses, [source, evidence], "left")
    codes = reasons(
        conflicting_source_doi=F.col("__papers") > 1,
        repeated_record=(F.col("__contents") == 1) & (F.col("__copy") > 1),
        conflicting_record_copy=F.col("__contents") > 1,
        duplicate_experiment=F.col("__counted") & (F.col("__tries") > 1) & (F.col("__labels") == 1),
        conflicting_experiment=F.col("__counted") & (F.col("__tries") > 1) & (F.col("__labels") > 1),
        reused_value_evidence=F.col("__counted") & (F.col("__uses") > 1),
    )
    return marked.withColumn("codes", codes).drop("__copy", "__papers", "__contents", "__counted", "__tries", "__labels", "__uses")


def overview(df: DataFrame, key: list[str], order: str, occurrence: list[str]) -> DataFrame:
    """One row a fact: its first place, how often it occurs, and its different occurrences in order
    (rows that repeat a place say nothing new, and leave each task once)."""
    return df.groupBy(*key).agg(F.min(order).alias("first_at"), F.count(F.lit(1)).alias("n_occurrences"), F.array_sort(F.collect_set(F.struct(order, *occurrence))).alias("occurrences"))


BUCKET = 1200


def overlaps(a: DataFrame, b: DataFrame, page: list[str], width: int = BUCKET) -> DataFrame:
    """Pairs of spans that overlap on a page: an equi join on the page and on buckets of places.

    Spans have columns start and end (of b: b_start, b_end). A pair meets in the bucket where the
    later of both starts, and only there, so it comes out once.
    """
    cut = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(F.greatest(e - 1, s) / width)))
    left = a.withColumn("__bucket", cut(F.col("start"), F.col("end")))
    right = b.withColumn("__bucket", cut(F.col("b_start"), F.col("b_end")))
    meets = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    once = F.col("__bucket") == F.floor(F.greatest("start", "b_start") / width)
    return left.join(right, [*page, "__bucket"]).where(meets & once).drop("__bucket")


def mutual_overlap() -> Column:
    """Overlap over the longer of two spans."""
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    return shared / F.greatest(F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start"))


def without_near_duplicates(a: DataFrame, b: DataFrame, page: list[str], kind: str, ident: str, least: float = 0.85) -> DataFrame:
    """Rows of ``a`` that no row of ``b`` of the same kind covers to ``least`` both ways."""
    near = overlaps(a.select(*page, kind, ident, "start", "end"), b, [*page, kind]).where(mutual_overlap() >= least)
    return a.join(near.select(ident).distinct(), ident, "left_anti")


def header_before(df: DataFrame, key: list[str], order: list[str], place: str, header: Column, value: Column, reach: int) -> DataFrame:
    """Adds header and header_distance: the last header at most ``reach`` places before a row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(header, F.struct(value.alias("v"), F.col(place).alias("p"))), ignorenulls=True).over(w)
    near = (F.col(place) - last["p"]) <= reach
    return df.withColumns({"header": F.when(near, last["v"]), "header_distance": F.when(near, F.col(place) - last["p"])})


def nearest(points: DataFrame, targets: DataFrame, key: list[str], x: str, target: str, tie: str, fields: list[str]) -> DataFrame:
    """For each target the nearest point of its key; ties by ``tie``.

    Points and targets stand in one line by place; the last point at or before a target and the
    first one at or after it are the only candidates, so no pairs are made.
    """
    held = F.struct(x, tie, *fields)
    marks = points.select(*key, F.col(x).cast("double").alias("__x"), F.lit(0).alias("__t"), F.col(tie).alias("__tie"), held.alias("__p"), F.lit(None).cast(targets.schema[target].dataType).alias(target))
    asked = targets.select(*key, target).distinct()
    line = marks.unionByName(asked.select(*key, F.col(target).cast("double").alias("__x"), F.lit(1).alias("__t"), target), allowMissingColumns=True)
    until = lambda place: Window.partitionBy(*key).orderBy(place, "__t", F.col("__tie").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = line.withColumns({"__a": F.last("__p", ignorenulls=True).over(until(F.col("__x"))), "__b": F.last("__p", ignorenulls=True).over(until(F.col("__x").desc()))})
    away = lambda c: F.struct(F.abs(F.col(f"{c}.{x}") - F.col(target)), F.col(f"{c}.{tie}"))
    best = F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull() | (away("__a") <= away("__b")), F.col("__a")).otherwise(F.col("__b"))
    out = found.where("__t = 1").withColumn("__p", best).where("__p IS NOT NULL")
    return out.select(*key, target, *[F.col(f"__p.{c}").alias(f"near_{c}") for c in (x, tie, *fields)])


def islands(df: DataFrame, key: list[str], place: str, bridge: int = 0) -> DataFrame:
    """Runs of places with gaps of at most ``bridge`` missing ones."""
    w = Window.partitionBy(*key).orderBy(place)
    gap = F.col(place) - F.lag(place).over(w) > bridge + 1
    runs = df.select(*key, place).distinct().withColumn("__new", F.when(gap, 1).otherwise(0))
    runs = runs.withColumn("run_no", F.sum("__new").over(w))
    return runs.groupBy(*key, "run_no").agg(F.min(place).alias("run_start"), F.max(place).alias("run_end"), F.count(F.lit(1)).alias("n_places"))


def coverage(gold: DataFrame, found: DataFrame, strict: list[str], loose: list[str]) -> DataFrame:
    """covered (a strict match), partial (a loose one) or missing for each gold row."""
    full = found.select(*strict).distinct().withColumn("__full", F.lit(True))
    part = found.select(*loose).distinct().withColumn("__part", F.lit(True))
    out = gold.join(full, strict, "left").join(part, loose, "left")
    return out.withColumn("status", F.when(F.col("__full"), "covered").when(F.col("__part"), "partial").otherwise("missing")).drop("__full", "__part")
