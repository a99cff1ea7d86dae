"""Encodings, fold plans and score cards, composed of the operators of this package.

Everything is a plan over the records: what is left out is a table with its reason, statistics and
vocabularies come from training groups only, and a snapshot is told by its rows and a checksum.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import utility
from . import encode, score


@dataclass(frozen=True)
class Task:
    """One prediction task: which columns of the records play which part."""

    key: str
    group: str
    value: str
    identity: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    fraction: float = 0.2
    least_groups: int = 5


@dataclass(frozen=True)
class Encoding:
    rows: DataFrame
    excluded: DataFrame
    split: DataFrame
    dictionary: DataFrame
    summary: DataFrame


def sorted_out(records: DataFrame, task: Task, reason: Column) -> DataFrame:
    """The records with ``reason``: the first that applies of the caller's own, of observations with
    several values (all of them go), and of repeats (all but the smallest key go); null if usable."""
    own = records.withColumn("reason", reason)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in task.identity])
    alive = own.where("reason IS NULL").groupBy(*[F.col(c).alias(f"__{c}") for c in task.identity])
    seen = alive.agg(F.min(task.value).alias("__low"), F.max(task.value).alias("__high"), F.min(task.key).alias("__first"))
    out = own.join(seen, same, "left").drop(*[f"__{c}" for c in task.identity])
    clash = F.when(F.col("__low") != F.col("__high"), "conflicting_values").when(F.col(task.key) != F.col("__first"), "repeated_observation")
    return out.withColumn("reason", F.coalesce("reason", clash)).drop("__low", "__high", "__first")


def build_encoding(records: DataFrame, task: Task, reason: Column) -> Encoding:
    """Usable observations, split by groups, with indicators whose vocabulary comes from the
    training groups (from all of them in a preview); numbers stay as they are, with missing flags.

    The vocabulary names columns, so its tokens come to the driver: distinct ones, a column each.
    """
    judged = sorted_out(records, task, reason)
    usable = judged.where("reason IS NULL").drop("reason")
    split = encode.group_split(usable, task.group, task.fraction, task.least_groups)
    rows = usable.join(split, task.group)
    known = encode.vocabulary(rows.where("split <> 'test'"), list(task.categories)) if task.categories else None
    tokens: dict[str, list[str]] = {c: [] for c in task.categories}
    for r in known.orderBy("field", "token").collect() if known is not None else ():  # a row a column
        tokens[r.field].append(r.token)
    for c in task.categories:
        rows = encode.encode_wide(rows, c, tokens[c])
    rows = rows.withColumns({f"{c}__missing": F.col(c).isNull().cast("int") for c in task.numeric})
    entries = [(c, "number", c) for c in task.numeric] + [(c, "missing", f"{c}__missing") for c in (*task.numeric, *task.categories)]
    entries += [(c, "unknown", f"{c}__unknown") for c in task.categories] + [(c, "indicator", f"{c}={t}") for c in task.categories for t in tokens[c]]
    entries += [(task.value, "label", task.value), (task.group, "group", task.group), (task.key, "key", task.key)]
    dictionary = records.sparkSession.createDataFrame(entries, "field string, role string, column string")
    summary = judged.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("reason").isNull()).alias("n_usable"), F.count_if(F.col("reason").isNotNull()).alias("n_excluded"))
    return Encoding(rows, judged.where("reason IS NOT NULL").select(task.key, "reason"), split, dictionary, summary)


def fold_plan(rows: DataFrame, task: Task, most: int = 5) -> DataFrame:
    """A row a development fold: sizes, and whether R2 is defined on it. Test groups are untouched."""
    train = rows.where("split = 'train'")
    folds = encode.balanced_folds(train, task.group, most)
    placed = train.join(folds.select(task.group, "fold"), task.group)
    found = placed.groupBy("fold").agg(F.count(F.lit(1)).alias("n_validation"), F.count_distinct(task.group).alias("n_groups"), F.min(task.value).alias("__low"), F.max(task.value).alias("__high"))
    defined = F.when(F.col("n_validation") < 2, "undefined_single_observation").when(F.col("__low") == F.col("__high"), "undefined_constant_targets").otherwise("defined_if_model_predictions_exist")
    return found.select("fold", "n_validation", "n_groups", defined.alias("r2_applicability"))


def availability(rows: DataFrame, fields: list[str], measured: dict[str, Column]) -> DataFrame:
    """A row a field: reported, missing, known before a prediction, and reported but not known then.
    ``measured`` has the fields that must be measured, with whether a row knew them before."""
    before = {f: F.col(f).isNotNull() & measured.get(f, F.lit(True)) for f in fields}
    aggs = [x for f in fields for x in (F.count(f).alias(f"r_{f}"), F.count_if(before[f]).alias(f"b_{f}"))]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *aggs)
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").alias("reported"), (F.col("n") - F.col(f"r_{f}")).alias("missing"), F.col(f"b_{f}").alias("before_prediction"), (F.col(f"r_{f}") - F.col(f"b_{f}")).alias("reported_but_unavailable")) for f in fields]
    return one.select(F.inline(F.array(*cells)))


def revalidate(stored: DataFrame, now: DataFrame) -> DataFrame:
    """One row: whether a table still has the rows and the checksum that were stored with it."""
    current = encode.checksum(now).select(F.col("n_rows").alias("rows_now"), F.col("checksum").alias("checksum_now"))
    both = stored.select("n_rows", "checksum").crossJoin(F.broadcast(current))  # one row each
    return both.select("n_rows", "rows_now", (F.col("n_rows").eqNullSafe(F.col("rows_now")) & F.col("checksum").eqNullSafe(F.col("checksum_now"))).alias("same"))


@dataclass(frozen=True)
class Goal:
    """How a single metric is judged: 0 to 100 between low and high, by mode."""

    mode: str
    low: float
    high: float
    left: float | None = None
    right: float | None = None


@dataclass(frozen=True)
class Scores:
    cards: DataFrame
    groups: DataFrame
    excluded: DataFrame
    unused: DataFrame
    report: DataFrame


def score_encoding(rows: DataFrame, key: str, value: str, context: list[str], paper: str, sample: str, goal: Goal, checks: dict, weights: dict[str, float], annotations: DataFrame | None = None) -> Scores:
    """Cards (quality, and performance where the value and the whole context are known), comparison
    groups, rows without a score with their reason, annotations of no row, and a report of one row."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in context])
    quality = score.completeness(checks, weights)
    number = lambda x: F.lit(x).cast("double")
    judged = utility(F.col(value).cast("double"), F.lit(goal.mode), number(goal.low), number(goal.high), number(goal.left), number(goal.right))
    cards = rows.withColumns(quality).withColumn("performance", F.when(F.col(value).isNotNull() & whole, judged["score"]))
    reason = F.when(F.col(value).isNull(), "no_value").when(~whole, "incomplete_context")
    excluded = cards.where(F.col("performance").isNull()).select(key, F.coalesce(reason, F.lit("no_goal")).alias("reason"))
    groups = score.comparison_groups(rows.where(F.col(value).isNotNull()), context, paper, sample)
    unused = annotations.join(rows.select(key), key, "left_anti") if annotations is not None else rows.select(key).limit(0)
    counts = cards.agg(F.count(F.lit(1)).alias("quality_scored"), F.count("performance").alias("performance_scored"))
    of_groups = groups.agg(F.count(F.lit(1)).alias("comparison_groups"), F.count_if(F.col("n_samples") > 1).alias("groups_with_multiple_samples"))
    return Scores(cards, groups, excluded, unused, counts.crossJoin(F.broadcast(of_groups)))  # one row each


UNKNOWN_WORD = r"(?i)^\s*(?:unknown|n/?a|none|unspecified|未报告|不详|未知|待定|待补|无)?\s*$"  # fixed values: words that say nothing


def annotation_problem(kind: Column, value: Column, evidence_linked: Column, reviewer: Column) -> Column:
    """Why a comparison annotation can't be used, or null: a reviewer and linked evidence, texts that
    say something, numbers from zero, whole numbers of repeats from two."""
    number = value.try_cast("double")
    return (
        F.when(F.coalesce(F.trim(reviewer), F.lit("")) == "", "no_reviewer")
        .when(~F.coalesce(evidence_linked, F.lit(False)), "evidence_not_linked")
        .when((kind == "text") & F.coalesce(value, F.lit("")).rlike(UNKNOWN_WORD), "says_nothing")
        .when((kind != "text") & (number.isNull() | F.isnan(number) | (number < 0)), "not_a_number")
        .when((kind == "integer") & ((number < 2) | (number != F.floor(number))), "not_a_repeat_count")
    )
