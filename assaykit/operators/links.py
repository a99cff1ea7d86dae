"""Joins by place: pages, attachments, labels beside points, curated notes, ticks of an axis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on_page(evidence: DataFrame, pages: DataFrame, at: list[str], quote: str, text: str) -> DataFrame:
    """Adds ``located``: quote_found, quote_missing or no_page, by the text of the page it names.
    One text a page is assumed; of several the longest is read."""
    whole = pages.groupBy(*at).agg(F.max_by(text, F.length(text)).alias("__text"), F.lit(True).alias("__page"))
    out = evidence.join(whole, at, "left")
    found = F.when(F.col("__page").isNull(), "no_page").when(F.contains("__text", F.col(quote)), "quote_found").otherwise("quote_missing")
    return out.withColumn("located", found).drop("__text", "__page")


def with_supplements(rows: DataFrame, attachments: DataFrame, path: str, kind: str = "document_type", issues: str = "issues") -> DataFrame:
    """Rows of an attached supplement become supplementary information that may be trained on: only
    rows of an unknown type or already supplements; a document typed otherwise keeps its type."""
    files = attachments.where("role = 'supplement'").select(F.col("path").alias(path)).distinct().withColumn("__s", F.lit(True))
    out = rows.join(files, path, "left")
    yes = F.coalesce(F.col("__s"), F.lit(False)) & F.col(kind).isin("unknown", "supplementary_information")
    changed = {kind: F.when(yes, "supplementary_information").otherwise(F.col(kind)), "training_eligible": yes | F.coalesce(F.col("training_eligible"), F.lit(False)), issues: F.when(yes, F.array_remove(issues, "unclassified_document")).otherwise(F.col(issues))}
    return out.withColumns(changed).drop("__s")


def nearest_label(points: DataFrame, labels: DataFrame, page: list[str], reach: float, label: str, tie: str) -> DataFrame:
    """Adds ``label`` and ``distance``: the label nearest to a point (x, y) of its page, within
    ``reach``; ties by ``tie``. A grid join: a label goes to the nine cells around it, a point to its
    own, so no page's points and labels are all paired."""
    cell = lambda c: F.floor(c / reach)
    around = [F.struct((cell(F.col("x")) + i).alias("cx"), (cell(F.col("y")) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = labels.select(*page, F.col("x").alias("__x"), F.col("y").alias("__y"), F.col(label).alias("__l"), F.col(tie).alias("__t"), F.explode(F.array(*around)).alias("__c")).select("*", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy")).drop("__c")
    places = points.select(*page, "x", "y").distinct().withColumns({"__cx": cell(F.col("x")), "__cy": cell(F.col("y"))})
    joined = places.join(spread, [*page, "__cx", "__cy"])
    away = F.sqrt(F.pow(F.col("x") - F.col("__x"), 2) + F.pow(F.col("y") - F.col("__y"), 2))
    near = joined.withColumn("__d", away).where(F.col("__d") <= reach)
    best = near.groupBy(*page, "x", "y").agg(F.min(F.struct("__d", "__t", "__l")).alias("__b"))
    out = points.join(best, [*page, "x", "y"], "left")
    return out.select(*points.columns, F.col("__b.__l").alias("label"), F.col("__b.__d").alias("distance"))


def annotated(annotations: DataFrame, blocks: DataFrame, locator: str, fields: list[str]) -> DataFrame:
    """Curated annotations with the block that they name: ``attached``, or ``no_block``."""
    own = blocks.select(locator, *[F.col(f).alias(f"block_{f}") for f in fields], F.lit(True).alias("__b")).dropDuplicates([locator])
    out = annotations.join(own, locator, "left")
    return out.withColumn("status", F.when(F.col("__b"), "attached").otherwise("no_block")).drop("__b")


def curve_coverage(fields: dict[str, Column], curves: DataFrame) -> DataFrame:
    """(field, n_points, covered): which gold fields have points of a curve; one pass."""
    one = curves.agg(*[F.count_if(test).alias(f"n_{name}") for name, test in fields.items()])
    rows = [F.struct(F.lit(name).alias("field"), F.col(f"n_{name}").alias("n_points"), (F.col(f"n_{name}") > 0).alias("covered")) for name in fields]
    return one.select(F.inline(F.array(*rows)))


def tick_order(ticks: DataFrame, axis: list[str], pixel: str, value: str, length: float, least: int = 3, span: float = 0.4) -> DataFrame:
    """A row an axis: whether its printed ticks can carry a scale. An axis has a handful of ticks."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*axis).orderBy(pixel, value))
    found = ticks.withColumn("__step", step).groupBy(*axis).agg(F.count(F.lit(1)).alias("n_ticks"), F.min("__step").alias("__low"), F.max("__step").alias("__high"), (F.max(pixel) - F.min(pixel)).alias("__span"))
    state = F.when(F.col("n_ticks") < least, "too_few_ticks").when(~((F.col("__low") > 0) | (F.col("__high") < 0)), "printed_ticks_not_monotonic").when(F.col("__span") < length * span, "printed_ticks_span_too_small").otherwise("usable")
    return found.select(*axis, "n_ticks", state.alias("state"))


def bands(places: DataFrame, key: list[str], place: str, gap: float, least: int = 3) -> DataFrame:
    """Clusters along a line: neighbours at most ``gap`` apart, ``least`` of them or more. Equal
    places are in one cluster; a place that has no distance (null, NaN, infinite) is near nothing."""
    line = Window.partitionBy(*key).orderBy(F.col(place).asc_nulls_last())
    first = F.when(F.col(place) - F.lag(place).over(line) <= gap, 0).otherwise(1)
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = places.withColumn("__new", first).withColumn("band", F.sum("__new").over(so_far))
    return numbered.groupBy(*key, "band").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n_places")).where(F.col("n_places") >= least)


def union_of(branches: dict[str, DataFrame]) -> DataFrame:
    """Rows of all branches, each with its branch; what a branch lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("branch", F.lit(name)) for name, df in branches.items()])
