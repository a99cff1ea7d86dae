"""Splits, vocabularies, encodings and fold-local preprocessing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT_SALT = "fixed-group-split-v1"
FOLD_SALT = "model-fold-v1"


def group_order(group: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + "|"), group.cast("string")), 256)


def group_split(df: DataFrame, group: str, fraction: float, least_groups: int, salt: str = SPLIT_SALT, parts: int = 64) -> DataFrame:
    """(group, split) by hash order: the first max(1, min(n-1, ceil(n * fraction))) groups are the
    test set; fewer than ``least_groups`` groups are all ``preview``."""
    groups = df.select(group).distinct()
    total = groups.agg(F.count(F.lit(1)).alias("n"))
    ranked = aligned_index(groups.withColumn("__h", group_order(F.col(group), salt)), ["__h", group], parts).withColumn("rank", F.col("row_index") + 1)
    n = F.col("n")
    count = F.greatest(F.lit(1), F.least(n - 1, F.ceil(n * fraction)))
    split = F.when(n < least_groups, "preview").when(F.col("rank") <= count, "test").otherwise("train")
    return ranked.crossJoin(F.broadcast(total)).select(group, split.alias("split"))  # one row of totals


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups in both train and test; empty for a sound split."""
    part = lambda s: df.where(F.col(split) == s).select(group)
    return part("train").intersect(part("test"))


class DealFolds:
    """Sizes in order, each into the lightest fold so far; a pass that holds only the folds' weights."""

    def __init__(self, names: list[str], most: int):
        self.names, self.most = names, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [0] * self.most
        for batch in batches:
            folds = []
            for size in batch.column(1).to_pylist():
                k = weights.index(min(weights))
                weights[k] += size
                folds.append(k + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(folds, pa.int32())], names=self.names)


def balanced_folds(df: DataFrame, group: str, most: int = 5, salt: str = FOLD_SALT) -> DataFrame:
    """(group, n_rows, fold): largest groups first into the lightest fold, hash order on ties.

    Greedy by nature: one task sorts the sizes (a row a group, spilled if need be) and deals them in
    a stream; fewer than three groups give no folds.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("__h", group_order(F.col(group), salt))
    enough = sizes.limit(3).agg((F.count(F.lit(1)) >= 3).alias("__enough"))
    line = sizes.crossJoin(F.broadcast(enough)).where("__enough").repartition(1).sortWithinPartitions(F.desc("n_rows"), "__h")  # one row
    return line.select(group, "n_rows").mapInArrow(DealFolds([group, "n_rows", "fold"], most).__call__, f"{group} {df.schema[group].dataType.simpleString()}, n_rows long, fold int")


def vocabulary(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, token): the distinct tokens of each field, as rows; fields are strings or arrays."""
    out = None
    for f in fields:
        array = df.schema[f].dataType.typeName() == "array"
        own = df.select(F.lit(f).alias("field"), (F.explode(f) if array else F.col(f)).alias("token")).where("token IS NOT NULL").distinct()
        out = own if out is None else out.unionByName(own)
    return out


def encode_long(df: DataFrame, key: str, field: str, tokens: list[str]) -> DataFrame:
    """(key, column, value): one indicator for each token, and for missing and unknown."""
    array = df.schema[field].dataType.typeName() == "array"
    held = F.col(field) if array else F.when(F.col(field).isNotNull(), F.array(field))
    cells = [F.struct(F.lit(f"{field}={t}").alias("column"), F.coalesce(F.array_contains(held, t), F.lit(False)).cast("int").alias("value")) for t in tokens]
    known = F.array(*[F.lit(t) for t in tokens]).cast("array<string>")
    cells.append(F.struct(F.lit(f"{field}__missing").alias("column"), F.col(field).isNull().cast("int").alias("value")))
    cells.append(F.struct(F.lit(f"{field}__unknown").alias("column"), F.coalesce(F.size(F.array_except(held, known)) > 0, F.lit(False)).cast("int").alias("value")))
    return df.select(key, F.inline(F.array(*cells)))


def encode_wide(df: DataFrame, field: str, tokens: list[str]) -> DataFrame:
    """Indicator columns ``field=token``, ``field__missing``, ``field__unknown``."""
    array = df.schema[field].dataType.typeName() == "array"
    held = F.col(field) if array else F.when(F.col(field).isNotNull(), F.array(field))
    known = F.array(*[F.lit(t) for t in tokens]).cast("array<string>")
    cells = {f"{field}={t}": F.coalesce(F.array_contains(held, t), F.lit(False)).cast("int") for t in tokens}
    cells[f"{field}__missing"] = F.col(field).isNull().cast("int")
    cells[f"{field}__unknown"] = F.coalesce(F.size(F.array_except(held, known)) > 0, F.lit(False)).cast("int")
    return df.withColumns(cells)


def fold_statistics(train: DataFrame, fields: list[str], zscore: bool = True) -> DataFrame:
    """One row: median of the observed, then mean and population deviation of imputed values
    (deviation 0 counts as 1); without z-score mean 0 and scale 1. A field without values has null
    statistics, and is to be dropped."""
    medians = train.agg(*[F.median(f).alias(f"{f}_median") for f in fields])
    if not zscore:
        return medians.withColumns({k: v for f in fields for k, v in ((f"{f}_mean", F.lit(0.0)), (f"{f}_scale", F.lit(1.0)))})
    filled = train.select(*fields).crossJoin(F.broadcast(medians))  # one row of medians
    value = lambda f: F.coalesce(f, f"{f}_median")
    aggs = [x for f in fields for x in (F.first(f"{f}_median").alias(f"{f}_median"), F.avg(value(f)).alias(f"{f}_mean"), F.coalesce(F.nullif(F.stddev_pop(value(f)), F.lit(0.0)), F.lit(1.0)).alias(f"{f}_scale"))]
    return filled.agg(*aggs)


def transform(df: DataFrame, statistics: DataFrame, fields: list[str]) -> DataFrame:
    """Imputed and scaled fields with missing flags; statistics are one row."""
    scaled = {f"{f}__missing": F.col(f).isNull().cast("int") for f in fields}
    scaled |= {f: (F.coalesce(f, f"{f}_median") - F.col(f"{f}_mean")) / F.col(f"{f}_scale") for f in fields}
    out = df.crossJoin(F.broadcast(statistics)).withColumns(scaled)
    return out.drop(*[f"{f}_{s}" for f in fields for s in ("median", "mean", "scale")])


def field_coverage(df: DataFrame, fields: list[str], available: dict[str, Column] | None = None) -> DataFrame:
    """(field, reported, missing, available): one pass over the table."""
    ready = available or {}
    one = df.agg(*[F.count_if(F.col(f).isNotNull()).alias(f"r_{f}") for f in fields], *[F.count_if(F.col(f).isNotNull() & ready.get(f, F.lit(True))).alias(f"a_{f}") for f in fields], F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").alias("reported"), (F.col("n") - F.col(f"r_{f}")).alias("missing"), F.col(f"a_{f}").alias("available")) for f in fields])
    return one.select(F.inline(rows))


def feature_pivot(records: DataFrame, key: list[str], prop: str, value: str, status: str, clean: Column, props: list[str]) -> DataFrame:
    """Wide features: a value only where all rows that aren't rejected agree on one and an approved
    clean one has it; ``ambiguous`` lists the other properties."""
    alive = records.where(F.col(status) != "rejected")
    own = alive.groupBy(*key).pivot(prop, props).agg(F.count_distinct(value).alias("n"), F.max(value).alias("v"), F.count_if((F.col(status) == "approved") & clean & F.col(value).isNotNull()).alias("u"), F.count(F.lit(1)).alias("c"))
    good = {p: (F.col(f"{p}_n") == 1) & (F.col(f"{p}_u") > 0) for p in props}
    bad = F.array_compact(F.array(*[F.when((F.col(f"{p}_c") > 0) & ~good[p], F.lit(p)) for p in props]))
    return own.select(*key, *[F.when(good[p], F.col(f"{p}_v")).alias(f"feature_{p}") for p in props], bad.alias("ambiguous"))


def aligned_index(df: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """Adds ``row_index``: 0, 1, 2 ... in the given order.

    Rows are dealt by ranges; a window runs inside a range, and the sizes of the ranges before it
    (one row a range) are added, so no task holds all rows.
    """
    dealt = df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    inner = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    out = inner.join(F.broadcast(before), "__range")  # a row a range
    return out.withColumn("row_index", F.col("__before") + F.col("__at") - 1).drop("__range", "__at", "__before")


def checksum(df: DataFrame) -> DataFrame:
    """Rows and an order-free checksum of a table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("checksum"))
