"""Sinks: delimited text, JSON, RIS and aligned exports. Spark's commit protocol makes each atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_guard


def flat(df: DataFrame) -> DataFrame:
    """Columns in name order, nested ones as JSON text with their nulls."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(F.col(f"`{c}`"), {"ignoreNullFields": "false"}).alias(c) if df.schema[c].dataType.typeName() in nested else F.col(f"`{c}`") for c in sorted(df.columns)])


def write_csv(df: DataFrame, path: str, guard: bool = True) -> None:
    out = flat(df)
    if guard:
        out = out.select(*[csv_guard(F.col(f"`{c}`")).alias(c) if out.schema[c].dataType.typeName() == "string" else F.col(f"`{c}`") for c in out.columns])
    out.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; a NaN or an infinity raises."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    sound = [F.assert_true(F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(f"{c} is not finite")) for c in doubles]
    checked = df.where(F.coalesce(*[s.isNull() for s in sound], F.lit(True))) if sound else df
    for s in sound[1:]:
        checked = checked.where(s.isNull())
    checked.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_aligned(df: DataFrame, path: str, key: list[str], features: list[str], label: str) -> None:
    """X, y and mapping tables in one row order, by ``row_index``."""
    from ..operators.encode import aligned_index

    rows = aligned_index(df, key)
    for name, cols in (("X", features), ("y", [label]), ("mapping", key)):
        rows.select("row_index", *cols).write.mode("overwrite").parquet(f"{path}/{name}")


def ris_rows(df: DataFrame, order: str) -> DataFrame:
    """(doi, ris): one RIS entry a DOI, from its first record; line breaks become spaces."""
    first = df.where("doi <> ''").groupBy("doi").agg(F.min_by(F.struct("title", "year"), F.col(order)).alias("r"))
    clean = lambda c: F.trim(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "))
    lines = [F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), clean(F.col("r.title"))), F.concat(F.lit("PY  - "), clean(F.col("r.year"))), F.concat(F.lit("DO  - "), F.col("doi")), F.lit("ER  - ")]
    return first.select("doi", F.concat_ws("\n", *lines).alias("ris"))


def write_ris(df: DataFrame, path: str, order: str) -> None:
    ris_rows(df, order).select(F.concat("ris", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
