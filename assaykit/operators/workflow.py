"""Revisions, review events and handoffs: what may be written, and what state follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import latest


def apply_revisions(current: DataFrame, updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``outcome`` to a batch of updates (key, base_revision, ...): accepted if they start from
    the current revision, the first of each key; ``conflict_raced`` if another was first,
    ``conflict_stale`` if the key has moved on, ``unknown_key`` if there is none."""
    known = current.select(key, F.col("revision").alias("__now"))
    judged = updates.join(known, key, "left").withColumn("__fits", F.col("base_revision") == F.col("__now"))
    first = judged.where("__fits").groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    out = judged.join(first, key, "left")
    state = F.when(F.col("__now").isNull(), "unknown_key").when(~F.coalesce("__fits", F.lit(False)), "conflict_stale").when(F.struct(*order) == F.col("__first"), "accepted").otherwise("conflict_raced")
    return out.withColumn("outcome", state).drop("__now", "__fits", "__first")


def next_revisions(current: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """The current revisions after the accepted updates."""
    won = judged.where("outcome = 'accepted'").groupBy(key).agg(F.lit(1).alias("__won"))
    return current.join(won, key, "left").withColumn("revision", F.col("revision") + F.coalesce("__won", F.lit(0))).drop("__won")


DECISIONS = ("reviewed", "excluded", "unreviewed")


def event_problem(decision: Column, reviewer: Column, known: Column, stale: Column, branch: Column, dropped: Column) -> Column:
    """Why a review event doesn't count, or null: an item that exists, is current and isn't read from
    an image; a named reviewer; a decision of the list; what was dropped can only stay excluded."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown_item")
        .when(~F.coalesce(decision.isin(*DECISIONS), F.lit(False)), "unknown_decision")
        .when(F.coalesce(F.trim(reviewer), F.lit("")) == "", "no_reviewer")
        .when(F.coalesce(stale, F.lit(False)), "stale_item")
        .when(F.coalesce(branch == "image", F.lit(False)), "image_item")
        .when(F.coalesce(dropped, F.lit(False)) & (decision != "excluded"), "not_adopted")
    )


def judged_events(items: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Events with ``problem``; items have (key, stale, branch, dropped)."""
    known = items.select(key, "stale", "branch", "dropped", F.lit(True).alias("__known"))
    out = events.join(known, key, "left")
    problem = event_problem(F.col("decision"), F.col("reviewer"), F.col("__known"), F.col("stale"), F.col("branch"), F.col("dropped"))
    return out.withColumn("problem", problem).drop("__known", "stale", "branch", "dropped")


def reviewed_items(items: DataFrame, events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Items with their state: that of the last event that counts, else unreviewed."""
    last = latest(judged_events(items, events, key).where("problem IS NULL"), [key], order, ["decision", "reviewer"])
    out = items.join(last, key, "left")
    return out.select(*items.columns, F.coalesce("decision", F.lit("unreviewed")).alias("review_status"), "reviewer", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"))


def handoff(records: DataFrame, doi: str, digest: str, status: str = "review_status", issues: str = "issues") -> DataFrame:
    """Records that aren't excluded, with the group they are split by (the DOI, else the source's
    digest) and their part: ready_for_standardization, or needs_review."""
    alive = records.where(~F.coalesce(F.col(status) == "excluded", F.lit(False)))
    part = F.when(F.size(issues) == 0, "ready_for_standardization").otherwise("needs_review")
    return alive.withColumns({"split_group": F.coalesce(F.nullif(F.trim(doi), F.lit("")), F.col(digest)), "stage": part, "ml_ready": F.lit(False)})


def team_papers(papers: DataFrame, attachments: DataFrame, key: str) -> DataFrame:
    """Papers of another tool's project: the human decision (else review), and the only primary PDF
    if there is exactly one. Nothing is chosen among several."""
    mains = attachments.where("role = 'primary' AND lower(path) LIKE '%.pdf'").groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min("path").alias("__path"))
    out = papers.join(mains, key, "left")
    one = F.col("__n") == 1
    state = F.when(F.col("__n").isNull(), "no_primary_pdf").when(one, "bound").otherwise("several_primary_pdfs")
    decision = F.when(F.col("human_decision").isin("target", "review", "non_target"), F.col("human_decision")).otherwise("review")
    return out.withColumns({"decision": decision, "pdf_state": state, "pdf_path": F.when(one, F.col("__path"))}).drop("__n", "__path")
