"""Language of pages by Bayesian evidence fusion.

Four kinds of evidence are fused in log space, per page and language: the likelihood of the main
text as the host's wrapper gives it (byte trigrams, tempered, since trigrams aren't independent), the
declared markup language, the address suffix (a language segment of the path, or a country domain),
and the prior of the host. The tables of declared languages and suffixes, and the priors, come from
grouped sums of the text posteriors; a host's prior is smoothed towards its domain's, and that
towards the whole. A page's own share is taken out of its host's sums, so no page votes for itself.
Evidence is an array with an entry a language, so any number of languages goes.

Text models are fitted on at most ``TRAIN_ROWS`` documents with a language (seeded choice, one row an
id) and SAMPLE_BYTES bytes of them. Defined cases: null or empty html has a flat likelihood, so other
evidence decides; pages of any length are read whole; a null or odd url has the empty host; without
training rows the language is ``und``; of languages that tie the first by name is taken; repeated rows
each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, first_by_hash, map_rows, sample_texts, share, shared_value, written
from .wrappers import Wrappers, main_text, named, with_host, wrappers

TRAIN_ROWS = 4000
BUCKETS = 1 << 15
#: Effective trigrams of a text grow with the root of its length.
TEMPER = 0.5
HOST_WEIGHT, DOMAIN_WEIGHT, CUE_WEIGHT = 4.0, 8.0, 1.0
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en"}  # fixed values
HTML_TAG = re.compile(r"<html\b([^>]*)>", re.IGNORECASE)
SEGMENT = re.compile(r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[-_][a-z]{2})?(?:[/?#]|$)", re.IGNORECASE)


def grams(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = (raw[:-2] << 16) ^ (raw[1:-1] << 8) ^ raw[2:] if len(raw) > 2 else np.empty(0, np.uint32)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 15)


def fit(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram bucket in each of them."""
    langs = sorted({lang for lang, _ in rows})
    counts = np.zeros((len(langs), BUCKETS))
    for lang, text in rows:
        counts[langs.index(lang)] += np.bincount(grams(text), minlength=BUCKETS)
    probability = (counts + 0.1) / (counts + 0.1).sum(1, keepdims=True) if langs else counts
    return langs, np.log(np.maximum(probability, 1e-12)).astype(np.float32)


class Likelihood:
    """Tempered log likelihoods of the main text, the declared language and the suffix."""

    def __init__(self, shared):
        self.shared = shared

    def start(self):
        langs, table = shared_value(self.shared)
        flat, known = [0.0] * len(langs), Wrappers()

        def one(page: str | None, wrapper: str | None) -> list[float]:
            text = main_text(page, known[wrapper])
            codes = grams(text) if text else ()
            if not len(codes):
                return flat
            total = table[:, codes].sum(1, dtype=np.float64)
            total = (total - total.max()) * len(codes) ** (TEMPER - 1.0)
            return total.tolist()

        def work(page_id, url, host, html, wrapper):
            declared = [cue(named(m[1]).get("lang") if (m := HTML_TAG.search(h or "")) else None, langs) for h in html]
            suffix = [cue(m[1] if (m := SEGMENT.match(u or "")) else COUNTRY.get((h or "").rpartition(".")[2]), langs) for u, h in zip(url, host)]
            return {"page_id": page_id, "url": url, "host": host, "declared": declared, "suffix": suffix, "ll": [one(h, w) for h, w in zip(html, wrapper)]}

        return work


def cue(value: str | None, langs: list[str]) -> str:
    low = (value or "").lower()[:2]
    return low if low in langs else "other" if low else "none"


def softmax(total: str):
    """The posterior of an array of log terms."""
    top = F.array_max(total)
    weights = F.transform(total, lambda x: F.exp(x - top))
    return F.element_at(F.transform(F.array(weights), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y))), 1)


def summed(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Sums of arrays by place, as an array: place by place, so that partial sums leave each task."""
    long = rows.select(*by, F.posexplode(value).alias("place", "v"))
    sums = long.groupBy(*by, "place").agg(F.sum("v").alias("v"))
    held = F.array_sort(F.collect_list(F.struct("place", "v")))  # an entry a language
    return sums.groupBy(*by).agg(F.transform(held, lambda x: x["v"]).alias(name))


def cue_table(scored: DataFrame, name: str) -> DataFrame:
    """log P(cue | language) by cue, as an array; at most languages + 2 rows."""
    sums = summed(scored, [name], "p", "s")
    whole = summed(sums.withColumn("one", F.lit(1)), ["one"], "s", "t").join(sums.agg(F.count(F.lit(1)).alias("kinds"), F.lit(1).alias("one")), "one")
    terms = F.zip_with("s", "t", lambda s, t: F.log((s + CUE_WEIGHT) / (t + CUE_WEIGHT * F.col("kinds"))))
    return sums.crossJoin(F.broadcast(whole)).select(name, terms.alias(f"{name}_terms"))  # one row of totals


def training_texts(documents: DataFrame, limit: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """(lang, text) of at most ``limit`` documents, one row an id."""
    train = columns(documents, doc_id="long", lang="string", text="string").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # ids alone are ordered; the chosen texts are then fetched by a broadcast of ``limit`` ids
    ids = train.select("doc_id").distinct()
    chosen = first_by_hash(ids, "language", limit, ids.count()).withColumn("at", F.xxhash64(F.lit("language"), "doc_id"))
    return [(r.lang, r.text) for r in sample_texts(train, chosen)]


def identify(pages: DataFrame, documents: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """page_id, url, host, lang, confidence, text_lang, declared, suffix of every page."""
    langs, table = fit(training_texts(documents, limit))
    spread = with_host(pages).select("page_id", "url", "host", "html")
    if not langs:
        return spread.select("page_id", "url", "host", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.lit("none").alias("declared"), F.lit("none").alias("suffix"))
    shared = share(pages.sparkSession, (langs, table))
    read = spread.join(written(wrappers(spread)), "host", "left").select("page_id", "url", "host", "html", "wrapper")
    found = map_rows(read, Likelihood(shared), "page_id long, url string, host string, declared string, suffix string, ll array<double>")
    scored = written(found.withColumn("p", softmax("ll")).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))

    hosts = summed(scored, ["domain", "host"], "p", "of_host")
    domains = summed(hosts, ["domain"], "of_host", "of_domain")
    whole = summed(domains.withColumn("one", F.lit(1)), ["one"], "of_domain", "of_all").select("of_all")
    # written, so that a host with most of the pages can be split in the join
    priors = written(hosts.join(domains, "domain").select("host", "of_host", "of_domain"))
    joined = scored.join(priors, "host").crossJoin(F.broadcast(whole))
    for name in ("declared", "suffix"):
        joined = joined.join(F.broadcast(cue_table(scored, name)), name)  # a row a cue: languages + 2 at most

    for level, weight, above in (("of_all", 1.0, F.transform("p", lambda x: F.lit(1.0 / len(langs)))), ("of_domain", DOMAIN_WEIGHT, F.col("of_all")), ("of_host", HOST_WEIGHT, F.col("of_domain"))):
        others = F.zip_with(level, "p", lambda a, p: F.greatest(a - p, F.lit(0.0)))
        joined = joined.withColumn("__rest", others).withColumn("__sum", F.aggregate("__rest", F.lit(0.0), lambda a, x: a + x))
        joined = joined.withColumn(level, F.zip_with("__rest", above, lambda a, b: (a + F.lit(weight) * b) / (F.col("__sum") + F.lit(weight))))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = joined.withColumn("total", plus(plus(plus("ll", "declared_terms"), "suffix_terms"), F.transform("of_host", lambda x: F.log(x))))
    fused = fused.withColumn("post", softmax("total"))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return fused.select("page_id", "url", "host", best("post").alias("lang"), F.array_max("post").alias("confidence"), best("ll").alias("text_lang"), "declared", "suffix")
