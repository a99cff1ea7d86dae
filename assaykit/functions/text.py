"""Text, identity and address functions, as Column expressions.

Null in gives null out unless a docstring says otherwise. Regular expressions are Java's; ``(?U)``
makes classes Unicode where that matters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed characters: sub- and superscripts, and the minus signs of typesetting.
SCRIPTS = ("₀₁₂₃₄₅₆₇₈₉²³−⁻", "012345678923--")
DASHES = ("−–—‐", "----")
SEPARATOR = "\u0001"
DOI_TAIL = ".,;)]}>。，；）】》"
DOI_PATTERN = r"10\.\d{4,9}/\S+"
NO_ABSTRACT = ["no abstract available", "abstract unavailable", "n/a", "none", "null", "无摘要"]


def norm(c: Column) -> Column:
    """Scripts and typeset minus signs to plain characters; trimmed."""
    return F.trim(F.translate(c, *SCRIPTS))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def plain_text(c: Column) -> Column:
    """Tags to spaces, the five named entities decoded, dashes folded, white space collapsed."""
    stripped = F.regexp_replace(c, "<[^>]+>", " ")
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
    decoded = reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, stripped)
    return collapse(F.translate(decoded, *DASHES))


def known_abstract(c: Column) -> Column:
    """The plain abstract; the phrases that stand for a missing one become empty."""
    text = plain_text(F.coalesce(c, F.lit("")))
    return F.when(F.lower(text).isin(NO_ABSTRACT), F.lit("")).otherwise(text)


def digest_id(length: int, *cols: Column) -> Column:
    """A deterministic id: the first hex digits of a SHA-256 over the values in order; null and
    empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, length)


def doi_harvest(c: Column) -> Column:
    """Resolver addresses and the doi: label removed, lower case, no closing punctuation."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r"(?i)^doi:\s*", "")), r"[.,;)]+$", "")


def doi_screening(c: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.lower(F.trim(bare))


def doi_canonical(c: Column) -> Column:
    """Decoded, without resolver and closing punctuation; empty unless it is a DOI."""
    decoded = F.coalesce(F.try_url_decode(F.trim(F.coalesce(c, F.lit("")))), F.trim(F.coalesce(c, F.lit(""))))
    bare = F.lower(F.regexp_replace(decoded, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    cut = F.regexp_replace(bare, r"[.,;)\]}>。，；）】》]+$", "")
    return F.when(cut.rlike(f"^{DOI_PATTERN}$"), cut).otherwise(F.lit(""))


def doi_strict(c: Column) -> Column:
    """As ``doi_canonical``, but a value that is no DOI raises."""
    value = doi_canonical(c)
    blank = F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank, F.lit("")).when(value != "", value).otherwise(F.raise_error(F.concat(F.lit("not a DOI: "), c)).cast("string"))


def doi_all(c: Column) -> Column:
    """Distinct DOIs of a text, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"(?i)({DOI_PATTERN})"), 1), doi_canonical))


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def record_id(doi: Column, title: Column, year: Column) -> Column:
    fallback = F.concat(title_key(title), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))
    return F.substring(F.sha2(F.coalesce(F.nullif(doi_harvest(doi), F.lit("")), fallback), 256), 1, 20)


def short_identity(c: Column) -> Column:
    return F.lower(collapse(c))


def metric_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(norm(c)), r"(?U)[^\p{L}\p{N}]+", "")


def safe_error(c: Column) -> Column:
    """Keys and addresses in query strings redacted."""
    return F.regexp_replace(c, r"(?i)((?:api[_-]?key|key|token|email|mailto)=)[^&\s]+", "$1[redacted]")


def safe_stem(c: Column, length: int = 80) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(cleaned, 1, length), F.lit("")), F.lit("record"))


def csv_guard(c: Column, controls: bool = True) -> Column:
    """An apostrophe before cells that a spreadsheet would run as a formula."""
    risky = F.ltrim(c).rlike(r"^[=+\-@]")
    if controls:
        risky = risky | c.rlike(r"^[\t\r]")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_valid(c: Column) -> Column:
    """http(s), no credentials, a public host name."""
    host = url_host(c)
    private = host.rlike(r"^(?:localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)|\.local$|^\[")
    return F.coalesce(c.rlike(r"(?i)^https?://[^/?#@\s]+(?:[/?#]|$)") & host.contains(".") & ~private, F.lit(False))


def route(c: Column, groups: dict[str, list[str]], default: str = "other") -> Column:
    """The first group one of whose suffixes ends the host."""
    host = url_host(c)
    out = F.lit(default)
    for name, suffixes in reversed(groups.items()):
        hit = reduce(lambda a, b: a | b, [(host == s) | host.endswith("." + s) for s in suffixes])
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def links(c: Column, pattern: str = "") -> Column:
    """Targets of href, in order, that match ``pattern``."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"), 1)
    return F.filter(found, lambda x: x.rlike(pattern)) if pattern else found


def sentences(c: Column) -> Column:
    """Sentences with their marks: after runs of marks, or a full stop before a capital."""
    marked = F.regexp_replace(F.regexp_replace(c, "([。!?]+)", "$1\u0002"), r"\.(?=\s+[A-Z])", ".\u0002")
    return F.filter(F.transform(F.split(marked, "\u0002"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def inverted(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, index): word -> positions of each text's words (split at single spaces)."""
    places = df.select(*key, F.posexplode(F.split(text, " ")).alias("at", "word"))
    words = places.groupBy(*key, "word").agg(F.array_sort(F.collect_list("at")).alias("places"))
    return words.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))


def revert(index: Column) -> Column:
    """The text of an inverted index; gaps are skipped."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " ")


def revert_strict(index: Column, most: int = 50_000) -> Column:
    """As ``revert``, but null for gaps, collisions, negative places and too many words."""
    places = F.flatten(F.map_values(index))
    good = (F.size(places) > 0) & (F.size(places) <= most) & (F.size(F.array_distinct(places)) == F.size(places)) & (F.array_min(places) == 0) & (F.array_max(places) == F.size(places) - 1)
    return F.when(good, revert(index))


HEADER_UNIT = r"^(.+?)\s*[\[(](.+?)[\])]$"


def header_parts(c: Column) -> tuple[Column, Column]:
    """(name, unit) of a table header, footnote letters removed."""
    text = F.regexp_replace(F.lower(norm(c)), r"\s+", " ")
    text = F.regexp_replace(text, r"(?<=[)])\s+[a-zªᵃ]$", "")
    text = F.regexp_replace(text, r"\s+[a-zªᵃ]\s*(?=[(\[])", " ")
    text = F.trim(F.regexp_replace(text, "[ªᵃ]$", ""))
    has = text.rlike(HEADER_UNIT)
    return F.when(has, F.trim(F.regexp_extract(text, HEADER_UNIT, 1))).otherwise(text), F.when(has, F.regexp_extract(text, HEADER_UNIT, 2)).otherwise(F.lit(""))


def span_ok(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether the code points [start, end) of a text are the quote."""
    inside = (start >= 0) & (end > start) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start.cast("int") + 1, (end - start).cast("int")) == quote), F.lit(False))


def longest_matches(found: Column) -> Column:
    """Greedy non-overlapping choice among array<struct<start, end, ...>>: longest first, then
    earliest."""
    ranked = F.array_sort(found, lambda a, b: F.when((a["end"] - a["start"]) != (b["end"] - b["start"]), (b["end"] - b["start"]) - (a["end"] - a["start"])).otherwise(a["start"] - b["start"]).cast("int"))
    return F.aggregate(ranked, F.slice(found, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(x))))
