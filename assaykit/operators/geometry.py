"""Readings of charts as tables: axes, ticks, markers, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import calibrate


def broken_axis(points: DataFrame, segments: DataFrame, key: list[str], pixel: str) -> DataFrame:
    """Value of each point on the axis segment that holds it; null in a gap.

    Segments (few a key, columns p1, p2, v1, v2, log) are gathered as an array by key, so points
    join once and no pair is tried twice.
    """
    held = segments.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("p1", "p2", "v1", "v2", "log"))).alias("__s"))
    inside = F.filter("__s", lambda s: F.col(pixel).between(F.least(s["p1"], s["p2"]), F.greatest(s["p1"], s["p2"])))
    values = F.transform(inside, lambda s: calibrate(F.col(pixel), s["p1"], s["p2"], s["v1"], s["v2"], s["log"]))
    return points.join(held, key, "left").withColumn("value", F.get(values, 0)).drop("__s")


def tick_fit(ticks: DataFrame, key: list[str], pixel: str, value: str, least: int = 3, tolerance: float = 0.02) -> DataFrame:
    """Linear and log10 fits of tick values over pixels, and which of them holds.

    At least ``least`` ticks and a correlation of 1 - tolerance are needed; if both or neither
    fit, the scale is ``ambiguous`` or ``none``.
    """
    log = F.when(F.col(value) > 0, F.log10(value))
    out = ticks.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_ticks"), F.regr_slope(value, pixel).alias("slope"), F.regr_intercept(value, pixel).alias("intercept"), F.regr_r2(value, pixel).alias("r2"),
        F.count(log).alias("n_log"), F.regr_slope(log, F.col(pixel)).alias("log_slope"), F.regr_r2(log, F.col(pixel)).alias("log_r2"),
    )
    linear = (F.col("n_ticks") >= least) & (F.col("r2") >= 1 - tolerance)
    logs = (F.col("n_log") == F.col("n_ticks")) & (F.col("n_ticks") >= least) & (F.col("log_r2") >= 1 - tolerance)
    linear, logs = F.coalesce(linear, F.lit(False)), F.coalesce(logs, F.lit(False))
    return out.withColumn("scale", F.when(linear & logs, "ambiguous").when(linear, "linear").when(logs, "log").otherwise("none"))


def markers(objects: DataFrame, x: str, y: str, size: str, region: tuple[float, float, float, float], exclude: list[tuple[float, float, float, float]], sizes: tuple[float, float], grid: float = 0.03) -> DataFrame:
    """Marker centres in a region, outside exclusions, of a size; centres in one grid cell count
    once (the smallest x, then y)."""
    inside = lambda b: F.col(x).between(b[0], b[2]) & F.col(y).between(b[1], b[3])
    keep = inside(region) & F.col(size).between(*sizes)
    for box in exclude:
        keep = keep & ~inside(box)
    cell = [F.floor(F.col(c) / grid).alias(f"cell_{c}") for c in (x, y)]
    return objects.where(keep).groupBy(*cell).agg(F.count(F.lit(1)).alias("n_objects"), F.min_by(F.struct(x, y), F.struct(x, y)).alias("p")).select(f"cell_{x}", f"cell_{y}", "n_objects", F.col(f"p.{x}").alias(x), F.col(f"p.{y}").alias(y))


def series_summary(points: DataFrame, key: list[str], x: str, y: str, method: str, resolution: Column) -> DataFrame:
    return points.groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.median(resolution).alias("median_resolution"), F.count_distinct(method).alias("n_methods"))
