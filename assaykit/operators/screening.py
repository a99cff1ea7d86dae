"""Rule-based screening and scoring of records: concept groups, decision lists, weighted hits.

Every rule set is a profile (a dict), so the same algorithm serves any vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import round_half_up, spoken_number
from ..schemas import DECISIONS

MOST_HITS = 12


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags) if flags else F.lit(False)


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def hits(c: Column, pattern: str, most: int = MOST_HITS) -> Column:
    """The first distinct matches of a pattern, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)), 1, most)


def evidence_window(c: Column, hit: Column, before: int = 60, after: int = 100) -> Column:
    """The text around a hit, cut at the ends."""
    at = F.instr(c, hit)
    begin = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(c, begin, at + F.length(hit) + after - begin))


def concept_groups(df: DataFrame, text: str, groups: dict[str, str], abstract: Column | None = None, type_decisions: dict[str, str] | None = None, article_type: Column | None = None) -> DataFrame:
    """OR within a group, AND across groups.

    Adds ``hits_<group>``, coverage, missing and decision: target if every group is hit (or what
    ``type_decisions`` says for the article type), review if some are or the abstract is missing,
    else non_target.
    """
    found = df.withColumns({f"hits_{name}": hits(F.col(text), pattern) for name, pattern in groups.items()})
    flags = {name: F.size(f"hits_{name}") > 0 for name in groups}
    n = reduce(lambda a, b: a + b, [f.cast("int") for f in flags.values()])
    missing = F.array_compact(F.array(*[F.when(~f, F.lit(name)) for name, f in flags.items()]))
    full = F.lit("target")
    for kind, decision in (type_decisions or {}).items():
        full = F.when(article_type == kind, decision).otherwise(full)
    no_abstract = F.lit(False) if abstract is None else (F.coalesce(F.trim(abstract), F.lit("")) == "")
    decision = F.when(n == len(groups), full).when(no_abstract | (n > 0), "review").otherwise("non_target")
    return found.withColumns({"n_groups": n, "coverage": round_half_up(n / F.lit(float(len(groups))), 4), "missing": missing, "decision": decision})


def decision_list(c: Column, strong: list[str], terms: list[str], experimental: str, review: str, computational: str, negative: str) -> Column:
    """struct(decision, article_type) by an ordered list of rules over one text."""
    is_strong = any_of([matches(c, p) for p in strong])
    n_terms = reduce(lambda a, b: a + b, [matches(c, p).cast("int") for p in terms])
    partial = is_strong | (n_terms >= 2)
    tests, reviews, models, other = (matches(c, p) for p in (experimental, review, computational, negative))
    pair = lambda d, t: F.struct(F.lit(d).alias("decision"), F.lit(t).alias("article_type"))
    return (
        F.when(reviews & partial, pair("review", "review_article"))
        .when(models & ~tests & partial, pair("review", "computational_or_mechanistic"))
        .when(is_strong & tests, pair("target", "experimental_primary"))
        .when(partial, pair("review", "uncertain"))
        .when(other, pair("non_target", "other_reaction"))
        .otherwise(pair("non_target", "insufficient_evidence"))
    )


def quality_overrides(decision: Column, article_type: Column, status: Column, needs_ocr: Column, is_full: Column, abstract: Column, document_type: Column, other_title: Column, review_type: str) -> Column:
    """struct(decision, article_type) after checks of the data behind a decision: what can't be
    judged is for review, never rejected."""
    pair = lambda d, t: F.struct(F.lit(d).alias("decision"), F.lit(t).alias("article_type"))
    kept = F.struct(decision.alias("decision"), article_type.alias("article_type"))
    unsure = pair("review", "uncertain")
    hit = F.coalesce(other_title, F.lit(False))
    return (
        F.when(status.eqNullSafe("failed") | needs_ocr.eqNullSafe(True) | status.eqNullSafe("fallback_first_pages") | is_full.eqNullSafe(False), unsure)
        .when(F.coalesce(F.trim(abstract), F.lit("")) == "", unsure)
        .when(matches(document_type, review_type), pair("review", "review_article"))
        .when(hit & decision.isin("target", "review") & (article_type != "insufficient_evidence"), unsure)
        .when(hit, pair("non_target", "other"))
        .when((decision == "non_target") & (article_type == "insufficient_evidence"), unsure)
        .otherwise(kept)
    )


def priority_score(fields: list[Column], patterns: dict[str, str], weights: dict[str, float]) -> dict[str, Column]:
    """score_<name> contributions (100 w / sum w where a field matches) and priority_score."""
    validate_weights(weights, set(patterns))
    total = sum(weights.values())
    parts = {f"score_{k}": F.when(any_of([matches(f, p) for f in fields]), F.lit(round(100 * weights[k] / total, 4))).otherwise(F.lit(0.0)) for k, p in patterns.items()}
    return parts | {"priority_score": round_half_up(reduce(lambda a, b: a + b, parts.values()), 2)}


def validate_weights(weights: dict[str, float], names: set[str]) -> None:
    if set(weights) != names:
        raise ValueError(f"weights must name {sorted(names)}")
    for name, w in weights.items():
        if isinstance(w, bool) or not isinstance(w, (int, float)) or not 0 <= w < float("inf"):
            raise ValueError(f"weight of {name} must be finite and not negative")
    if sum(weights.values()) <= 0:
        raise ValueError("weights must not all be zero")


def decision_counts(df: DataFrame, by: list[str], decision: str = "decision", decisions: tuple[str, ...] = DECISIONS, more: dict[str, Column] | None = None) -> DataFrame:
    """A count for every decision, zero where it doesn't occur, and ``more`` aggregates of the same
    pass; rows with a null key are a group like any other."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(decision) == d).alias(f"n_{d}") for d in decisions], F.count(F.lit(1)).alias("n_all"), *[c.alias(n) for n, c in (more or {}).items()])


def roles(c: Column, rules: dict[str, str]) -> Column:
    """All roles whose pattern matches, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(matches(c, p), F.lit(name)) for name, p in rules.items()]))


def document_type(declared: Column, title: Column, text: Column, structured: Column, markers: list[str], review_declared: str, review_title: str, review_text: str, supplement: str) -> Column:
    """structured_data, review, supplementary_information, research_article or unknown."""
    n = reduce(lambda a, b: a + b, [matches(text, p).cast("int") for p in markers])
    return (
        F.when(structured, "structured_data")
        .when(matches(declared, review_declared), "review")
        .when(matches(title, review_title), "review")
        .when(matches(text, review_text), "review")
        .when(matches(title, supplement), "supplementary_information")
        .when(n >= 2, "research_article")
        .otherwise("unknown")
    )


@dataclass(frozen=True)
class ClaimProfile:
    """The vocabulary of change statements: patterns only, no rule of its own.

    ``report`` selects sentences; ``amounts`` has (unit, pattern with one group for the number), the
    first that holds a number gives the amount; ``kinds`` has (statement type, pattern) in order of
    precedence, ``amount_kind`` is the type of a sentence that states an amount and matches none of
    the kinds before it, ``otherwise`` the type of the rest; ``against`` has one group, what is compared with.
    ``questions`` names what a reader must ask of a type: (type, issue) when nothing is compared with.
    """

    report: str
    amounts: tuple[tuple[str, str], ...]
    kinds: tuple[tuple[str, str], ...]
    against: str
    amount_kind: str = "reported_comparison"
    otherwise: str = "qualitative_observation"
    questions: tuple[tuple[str, str], ...] = (("reported_comparison", "missing_comparator"),)
    amount_question: str = "missing_absolute_baseline"


#: A small vocabulary in English; other fields and languages bring their own.
PLAIN_CLAIMS = ClaimProfile(
    report=r"(?i)\b(?:rose|rise[sn]?|fell|falls?|grew|grows?|gain(?:s|ed)?|loses?|lost|better|worse|higher|lower|increase[sd]?|decrease[sd]?|improve[sd]?)\b",
    amounts=(("fold", r"(?i)([0-9]+(?:\.[0-9]+)?|[a-z]+)[ -]?(?:fold|times)\b"), ("%", r"(?i)\bby\s+([0-9]+(?:\.[0-9]+)?)\s*%")),
    kinds=(
        ("prospective_claim", r"(?i)\b(?:may|might|could|will|should)\b"),
        ("negated_statement", r"(?i)\b(?:not|never|neither|nor)\b"),
        ("mechanistic_interpretation", r"(?i)\b(?:explained by|due to|we (?:suggest|propose))\b"),
        ("reported_comparison", r"(?i)\b(?:than|versus|compared)\b"),
    ),
    against=r"(?i)\b(?:than|versus|compared (?:to|with))\s+([^,;.\n]+)",
)


def claims(df: DataFrame, text: str, profile: ClaimProfile = PLAIN_CLAIMS) -> DataFrame:
    """One row a sentence that reports a change: type, amount, comparator, issues."""
    q = F.col("quote")
    read = {unit: spoken_number(F.nullif(F.regexp_extract(q, pattern, 1), F.lit(""))) for unit, pattern in profile.amounts}
    rows = df.select("*", F.posexplode(X.sentences(F.col(text))).alias("sentence_no", "quote"))
    none = F.lit(None).cast("struct<value:double,unit:string>")
    rows = rows.withColumn("__amount", F.coalesce(none, *[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(unit).alias("unit"))) for unit, v in read.items()]))
    rows = rows.where(matches(q, profile.report) | F.col("__amount").isNotNull())
    stated, before = F.col("__amount").isNotNull(), profile.kinds
    # the type of amounts stands where the table has it, or last
    table = [(name, matches(q, pattern) | (stated if name == profile.amount_kind else F.lit(False))) for name, pattern in before]
    if profile.amount_kind not in dict(before):
        table.append((profile.amount_kind, stated))
    kind = reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(table), F.lit(profile.otherwise))
    rows = rows.withColumns({"statement_type": kind, "amount": F.col("__amount.value"), "amount_unit": F.col("__amount.unit"), "comparator": F.nullif(F.trim(F.regexp_extract(q, profile.against, 1)), F.lit(""))})
    asked = [F.when((F.col("statement_type") == name) & F.col("comparator").isNull(), issue) for name, issue in profile.questions]
    return rows.withColumn("issues", F.array_compact(F.array(*asked, F.when(stated, profile.amount_question)))).drop("__amount")
