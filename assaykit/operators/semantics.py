"""Semantic candidates: what a clause says of a metric, of which sample, in which standing.

A sentence is split into clauses only where both sides name a metric of their own. A clause gives one
candidate for each metric it names: the quantity that fits the metric's units and stands nearest, or
a comparison, or (where the clause denies, demands or hopes) the bare statement. Candidates are never
joined, averaged or completed from other sentences; what is unclear is an issue, and a number that
can't be read is no number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import extract

SCHEMA = (
    "start int, end int, quote string, kind string, metric string, operator string, value double, value_high double, unit string, uncertainty double, "
    "sample string, reference string, scope string, facets array<string>, issues array<string>"
)
CONTRAST = ("but", "whereas", "while", "但是", "然而", "而")  # fixed values
NOT_ONLY = re.compile(r"\bnot\s+only\b", re.IGNORECASE)
JOINTS = re.compile(r"\s*[,，]\s*(?:(?:and|but|whereas|while)\b\s*)?|\s+(?:and|but|whereas|while)\s+|但是|然而", re.IGNORECASE)


@dataclass(frozen=True)
class Profile:
    """A field's vocabulary: metric -> (pattern, units), the look of sample names, and the words of
    conditions, whose quantities are no metric's."""

    metrics: dict[str, tuple[str, tuple[str, ...]]]
    sample: str = r"\b(?:[A-Z][a-z]?\d*){1,4}[-/][A-Z0-9][\w/.-]*\b"
    condition: str = r"\b(?:at|under|below|above|between|over|for|after)\s*$"
    units: tuple[str, ...] = field(default=("%", "°C", "K", "ppm", "mL/min", "m²/g", "h", "min", "nm", "fold"))


PLAIN = Profile({"conversion": (r"\bconversion\b", ("%",)), "selectivity": (r"\bselectivity\b", ("%",)), "yield": (r"\byield\b", ("%",)), "surface_area": (r"\bsurface area\b", ("m²/g",)), "light_off": (r"\b(?:T50|light-off temperature)\b", ("°C", "K"))})


def metrics_in(text: str, profile: Profile) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), name) for name, (pattern, _) in profile.metrics.items() for m in re.finditer(pattern, text, re.IGNORECASE)]
    return sorted(found)


def quantities(text: str) -> list[tuple[re.Match, list[str]]]:
    return [(m, extract.invalid(text, m)) for m in extract.QUANTITY.finditer(text)]


def clauses(text: str, profile: Profile) -> list[tuple[int, int]]:
    """Spans of clauses. A joint parts two clauses if both sides name a metric, and either it is one
    of contrast, or the left side has its own measured value or its own denial."""
    out, start = [], 0
    for joint in JOINTS.finditer(text):
        left, right = text[start : joint.start()], text[joint.end() :]
        if not metrics_in(left, profile) or not metrics_in(right, profile):
            continue
        word = joint[0].strip(" ,，").lower()
        measured = any(not wrong for _, wrong in quantities(left))
        if measured or (word in CONTRAST or extract.NEGATED.search(left)) and not NOT_ONLY.search(left):
            out.append((start, joint.start()))
            start = joint.end()
    return [*out, (start, len(text))]


def measure(text: str, name: str, at: int, profile: Profile, taken: set[int]) -> tuple[re.Match | None, list[str]]:
    """The quantity of a metric: of its units, not of a condition, nearest after it, else before."""
    _, units = profile.metrics[name]
    fits = [(m, wrong) for m, wrong in quantities(text) if m.start() not in taken and extract.unit_name(m["unit"]) in units and (m["bound"] or not re.search(profile.condition, text[: m.start("value")], re.IGNORECASE) or "%" in units)]
    if not fits:
        return None, []
    return min(fits, key=lambda f: (f[0].start("value") < at, abs(f[0].start("value") - at)))


def candidates(text: str, profile: Profile = PLAIN) -> list[dict]:
    out = []
    for start, end, cut in extract.sentence_spans(text):
        view = extract.View(text, start, end)
        for a, b in clauses(view.text, profile):
            clause = view.text[a:b]
            named = metrics_in(clause, profile)
            if not named:
                continue
            related = next(((kind, m) for kind, pattern in extract.RELATIONS if kind in ("difference", "ratio", "ambiguous_fold_change", "relative_change", "before_after") for m in [pattern.search(clause)] if m), None)
            samples = list(dict.fromkeys(m[0] for m in re.finditer(profile.sample, clause)))
            shared = {"scope": extract.scope(clause), "facets": extract.facets(clause)}
            quote = view.span(a, b)
            taken: set[int] = set()
            first = {name: at for at, _, name in reversed(named)}
            for name, at in sorted(first.items(), key=lambda x: x[1]):
                issues = ["sentence_cut"] if cut else []
                row = {"start": quote[0], "end": quote[1], "quote": text[quote[0] : quote[1]], "metric": name, "operator": None, "value": None, "value_high": None, "unit": None, "uncertainty": None, "sample": samples[0] if len(samples) == 1 else None, "reference": None}
                if len(samples) > 1:
                    issues.append("several_samples")
                if extract.NEGATED.search(clause) and not NOT_ONLY.search(clause):
                    row["kind"] = "negated"
                elif related:
                    kind, m = related
                    g = m.groupdict()
                    row |= {"kind": kind, "value": extract.as_number(g["value"]), "unit": extract.unit_name(g["unit"].strip("- ")), "reference": (g.get("reference") or "").strip() or None}
                    if kind == "ambiguous_fold_change":
                        issues.append("ambiguous_base")
                    elif kind in ("difference", "ratio") and not row["reference"]:
                        issues.append("missing_comparator")
                else:
                    m, wrong = measure(clause, name, at, profile, taken)
                    if m is not None:
                        taken.add(m.start())
                        fact = next(f for f in extract.numeric_facts(clause) if f["unit"] == extract.unit_name(m["unit"]) and f["end"] == m.end()) if not wrong else None
                        row["kind"] = "absolute"
                        row["unit"] = extract.unit_name(m["unit"])
                        if fact:
                            row |= {k: fact[k] for k in ("operator", "value", "value_high", "uncertainty")}
                        issues += wrong
                    elif shared["scope"] in ("modal", "requirement", "prior_work"):
                        row["kind"] = "statement"
                    else:
                        continue
                out.append(row | shared | {"issues": issues})
    return out


class Candidates:
    def __init__(self, profile: Profile):
        self.profile = profile

    def __call__(self, text: str) -> list[dict]:
        return candidates(text, self.profile)


def candidate_rows(df: DataFrame, key: str, text: str, profile: Profile = PLAIN) -> DataFrame:
    """A row a candidate of a column of texts."""
    return extract.scan(df, key, text, Candidates(profile), SCHEMA)
