"""Abstracts of provider responses and pages, and whether a document is the article it should be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import doi_canonical, title_key

# Where responses keep an abstract, outermost first.
API_ROOTS = ("$", "$.coredata", "$.full-text-retrieval-response", "$.full-text-retrieval-response.coredata", "$.abstracts-retrieval-response", "$.abstracts-retrieval-response.coredata")
API_KEYS = ("dc:description", "description")
STOP_WORDS = ("the", "and", "for", "with", "from", "into", "doi", "www", "https")  # fixed values
LEAST_CHARS = 80


def clean(c: Column) -> Column:
    """Markup dropped, white space collapsed; null for nothing."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " ")), F.lit(""))


def api_abstract(response: Column) -> Column:
    """The abstract of a JSON response: a string, or an object with its text under ``$``; never a
    title or other metadata. Null if the response is no JSON object."""
    found = []
    for root in API_ROOTS:
        for name in API_KEYS:
            place = f"{root}['{name}']"
            held = F.get_json_object(response, place)
            inner = F.get_json_object(response, f"{place}['$']")
            found.append(clean(F.when(held.startswith("{"), inner).otherwise(held)))
    return F.coalesce(*found)


def meta(html: Column, *names: str) -> Column:
    """The content of the first meta element with one of the names, in the order of the names."""
    own = [F.nullif(F.regexp_extract(html, rf"(?is)<meta\s[^>]*(?:name|property)\s*=\s*[\"']{n}[\"'][^>]*content\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")) for n in names]
    return F.coalesce(*own)


def publisher_abstract(html: Column, doi: Column, title: Column) -> Column:
    """A page's labelled abstract, if the page says that it is this article's (by its DOI, or by its
    title if it names none), and if it is whole: ``LEAST_CHARS`` characters, no trailing dots."""
    page_doi = meta(html, "citation_doi", "dc.identifier.doi", "dc.identifier")
    same_title = (title_key(F.coalesce(title, F.lit(""))) != "") & (title_key(F.coalesce(meta(html, "citation_title"), F.lit(""))) == title_key(F.coalesce(title, F.lit(""))))
    ours = F.when(page_doi.isNotNull(), doi_canonical(page_doi) == doi_canonical(F.coalesce(doi, F.lit("")))).otherwise(same_title)
    section = F.regexp_extract(html, r"(?is)<(section|div)\s[^>]*(?:id|class)\s*=\s*[\"']abstracts?[\"'][^>]*>(.*?)</\1>", 2)
    body = F.regexp_replace(section, r"(?is)<h[23][^>]*>.*?</h[23]>", " ")
    text = F.coalesce(clean(meta(html, "citation_abstract", "dc.description", "dcterms.abstract")), clean(body))
    whole = (F.length(text) >= LEAST_CHARS) & ~text.rlike(r"(?:\.\.\.|…)$")
    return F.when(F.coalesce(ours & whole, F.lit(False)), text)


def title_coverage(title: Column, text: Column) -> Column:
    """Share of a title's words (three letters or digits and more, common ones apart) that a text
    has, white space apart; null for titles of fewer than four."""
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]{3,})"), 1)), F.array(*[F.lit(w) for w in STOP_WORDS]))
    body = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    held = F.size(F.filter(words, lambda w: F.contains(body, w)))
    return F.when(F.size(words) >= 4, held / F.size(words))


def document_identity(doi: Column, title: Column, first_pages: Column) -> Column:
    """verified, title_mismatch or doi_not_found: the DOI must be printed on the first pages, and a
    title that can be compared must be covered to 0.6, or the DOI may be that of a cited article."""
    printed = F.contains(F.regexp_replace(F.lower(first_pages), r"\s+", ""), doi_canonical(doi)) & (doi_canonical(doi) != "")
    return F.when(~F.coalesce(printed, F.lit(False)), "doi_not_found").when(title_coverage(title, first_pages) < 0.6, "title_mismatch").otherwise("verified")
