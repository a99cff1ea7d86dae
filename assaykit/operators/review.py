"""Review decisions, gates and event-sourced state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(**tests: Column) -> Column:
    """Array of the names whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def override(automatic: Column, manual: Column) -> Column:
    """A human decision wins over an automatic one."""
    return F.coalesce(F.nullif(F.trim(manual), F.lit("")), automatic)


def apply_decisions(records: DataFrame, decisions: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """Joins decisions on the first key that has one: an OR of keys as equi joins, one after the
    other, so no pair of rows is ever tried. Decisions that repeat count once; different ones on
    one key cancel each other (``duplicate_keys`` lists them), so no record comes out twice."""
    out = records
    for k in keys:
        own = decisions.where(F.col(k).isNotNull() & F.col(decision).isNotNull()).groupBy(k).agg(F.min(decision).alias("__a"), F.max(decision).alias("__b"))
        own = own.select(F.col(k), F.when(F.col("__a") == F.col("__b"), F.col("__a")).alias(f"__{k}"))
        out = out.join(own, k, "left")
    return out.withColumn("manual_decision", F.coalesce(*[F.col(f"__{k}") for k in keys])).drop(*[f"__{k}" for k in keys])


def unknown_keys(decisions: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Decisions about records that don't exist."""
    return decisions.join(records.select(key), key, "left_anti")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def training_gate(category: Column, prop: Column, status: Column, issues: Column, value: Column, subject: Column, temperature: Column) -> Column:
    """ml, or the reason why a row is withheld from training."""
    return (
        F.when(status != "approved", "not_approved")
        .when(F.size(issues) > 0, "has_issues")
        .when(value.isNull(), "no_value")
        .when(F.coalesce(subject, F.lit("")) == "", "no_subject")
        .when(category != "performance", "not_performance")
        .when(~prop.isin("t50", "t90") & temperature.isNull(), "missing_temperature")
        .otherwise("ml")
    )


def latest(events: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Current state of each key: its last event. A partial aggregate, so a hot key is no burden."""
    got = F.max_by(F.struct(*fields), F.struct(*order))
    return events.groupBy(*key).agg(got.alias("__s"), F.count(F.lit(1)).alias("n_events")).select(*key, "n_events", *[F.col(f"__s.{f}").alias(f) for f in fields])


def breaker(df: DataFrame, key: list[str], order: list[str], blocked: Column) -> DataFrame:
    """Adds ``deferred``: an earlier row of the key was blocked.

    The first blocked place of each key is one small row, joined back; no key's rows meet."""
    place = F.struct(*order)
    first = df.where(blocked).groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min(place).alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    out = df.join(first, same, "left").withColumn("deferred", F.coalesce(place > F.col("__first"), F.lit(False)))
    return out.drop("__first", *[f"__{k}" for k in key])


def partition_counts(df: DataFrame, state: Column, names: list[str]) -> DataFrame:
    """Sizes of disjoint parts, which add up to the whole."""
    return df.select(state.alias("part")).groupBy().agg(*[F.count_if(F.col("part") == n).alias(f"n_{n}") for n in names], F.count(F.lit(1)).alias("n_all"))


def reject_copies(values: Column, status: Column) -> Column:
    """Values that still count: all but rejected ones."""
    return F.when(status != "rejected", values)
