"""Evidence completeness, comparison groups and single-metric scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up


def completeness(checks: dict[str, list[tuple[Column, Column]]], weights: dict[str, float]) -> dict[str, Column]:
    """ratio_<dimension> = documented / applicable, and score = sum of weight x ratio (0-100).

    A check is (documented, applicable); what doesn't apply neither helps nor hurts.
    """
    total = sum(weights.values())
    out: dict[str, Column] = {}
    parts = []
    for name, items in checks.items():
        applicable = reduce(lambda a, b: a + b, [a.cast("int") for _, a in items])
        documented = reduce(lambda a, b: a + b, [(d & a).cast("int") for d, a in items])
        ratio = F.coalesce(documented / F.nullif(applicable.cast("double"), F.lit(0.0)), F.lit(0.0))
        out[f"ratio_{name}"] = ratio
        parts.append(ratio * (100 * weights[name] / total))
    return out | {"quality_score": round_half_up(reduce(lambda a, b: a + b, parts), 2)}


def comparison_groups(df: DataFrame, signature: list[str], paper: str, sample: str) -> DataFrame:
    """Exactly equal contexts: observations, distinct papers and distinct (paper, sample) of each;
    rows with a missing part of the context have no group."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in signature])
    ident = F.substring(F.sha2(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in signature]), 256), 1, 16)
    return df.where(whole).groupBy(*signature).agg(F.count(F.lit(1)).alias("n_observations"), F.count_distinct(paper).alias("n_papers"), F.count_distinct(paper, sample).alias("n_samples")).withColumn("group_id", ident)
