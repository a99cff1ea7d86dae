"""Scans of files, metadata and provider responses as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X
from . import parsers

BLOCKS = "source string, source_sha256 string, ord int, kind string, locator string, text string, row map<string,string>, error string"


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256, length and time of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", F.col("modificationTime").alias("modified"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source", pa.string()), ("source_sha256", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("locator", pa.string()), ("text", pa.string()), ("row", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
    for batch in batches:
        rows = []
        for path, digest, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
            try:
                found = parsers.document(path, content)
            except Exception as problem:  # a bad file is a row, not a failed job
                rows.append((path, digest, 0, "error", "file", "", None, f"{type(problem).__name__}: {problem}"[:500]))
                continue
            rows += [(path, digest, k, kind, place, text, list(row.items()) if row else None, None) for k, (kind, place, text, row) in enumerate(found)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def blocks(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Blocks of every file: tables to rows, texts to chunks; a file that can't be read gives one
    row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    out = files.select("path", F.sha2("content", 256).alias("d"), "content").mapInArrow(_blocks, BLOCKS)
    return out.withColumn("block_id", X.digest_id(20, F.col("source_sha256"), F.col("locator"), F.col("text")))


class HtmlBlocks:
    """Blocks of a column of HTML texts."""

    def __init__(self, key: str):
        self.key = key

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(key, k, kind, place, text) for k, (kind, place, text, _) in enumerate(parsers.html(page or ""))]
            if rows:
                names = [self.key, "ord", "kind", "locator", "text"]
                types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def html_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInArrow(HtmlBlocks(key).__call__, f"{key} {kind}, ord int, kind string, locator string, text string")


def metadata(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Bibliographic records with list columns parsed from JSON, flags as booleans and an id."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').format(fmt).load(path)
    out = raw
    for c in ("authors", "pdf_urls", "source_names", "query_matches", "keywords"):
        if c in raw.columns and raw.schema[c].dataType.typeName() == "string":
            out = out.withColumn(c, F.from_json(c, "array<string>"))
    for c in ("is_oa", "needs_ocr", "abstract_is_full"):
        if c in raw.columns:
            low = F.lower(F.col(c).cast("string"))
            out = out.withColumn(c, F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False))
    col = lambda c: F.col(c) if c in out.columns else F.lit(None).cast("string")
    return out.withColumn("record_id", X.record_id(col("doi"), col("title"), col("year")))


def ris_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of RIS files, one row each."""
    rows = blocks(spark, path, "*.ris").where("kind = 'bibliographic'")
    fields = ["doi", "title", "abstract", "journal", "document_type", "date", "url", "authors", "keywords"]
    return rows.select("source", "ord", *[F.col("row")[f].alias(f) for f in fields])


def intake(records: DataFrame, sidecar: DataFrame, manual: str = "manual_decision", automatic: str = "decision") -> DataFrame:
    """Adds ``part`` (papers, waiting, excluded) and ``reason_code``; the sidecar has record_id,
    doi, pdf_sha256 and, for the stored file, expected_sha256."""
    links = sidecar.select("record_id", F.col("doi").alias("__doi"), "pdf_sha256", "expected_sha256")
    both = records.join(links, (records["record_id"] == links["record_id"]) & (X.doi_canonical(records["doi"]) == X.doi_canonical(links["__doi"])), "left").drop(links["record_id"]).drop("__doi")
    final = F.coalesce(F.nullif(F.col(manual), F.lit("")), F.col(automatic))
    reason = (
        F.when(final == "non_target", "screened_out").when(final != "target", "awaiting_review").when(F.col("pdf_sha256").isNull(), "no_pdf")
        .when(~F.col("pdf_sha256").eqNullSafe(F.coalesce("expected_sha256", "pdf_sha256")), "hash_mismatch")
    )
    part = F.when(reason.isNull(), "papers").when(reason == "screened_out", "excluded").otherwise("waiting")
    return both.withColumns({"reason_code": reason, "part": part})


# --- Provider responses: JSON columns to one bibliographic shape ---------------------------------

OPENALEX = "id string, doi string, title string, publication_year int, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, open_access struct<is_oa:boolean>"
CROSSREF = "DOI string, title array<string>, abstract string, `container-title` array<string>, issued struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string>>"
EUROPE_PMC = "id string, doi string, title string, abstractText string, pubYear string, authorString string, journalTitle string"
SEMANTIC = "paperId string, externalIds struct<DOI:string>, title string, abstract string, year int, authors array<struct<name:string>>, venue string"
CORE = "id string, doi string, title string, abstract string, yearPublished int, authors array<struct<name:string>>, publisher string"


def _shape(provider: str, doi: Column, title: Column, abstract: Column, year: Column, journal: Column, authors: Column) -> list[Column]:
    return [F.lit(provider).alias("provider"), X.doi_canonical(doi).alias("doi"), X.plain_text(title).alias("title"), X.known_abstract(abstract).alias("abstract"), year.cast("int").alias("year"), journal.alias("journal"), authors.alias("authors")]


def _names(authors: Column) -> Column:
    return F.transform(authors, lambda a: a["name"])


def provider_records(df: DataFrame, json: str, provider: str) -> DataFrame:
    """provider, doi, title, abstract, year, journal, authors from a JSON response item."""
    schema = {"openalex": OPENALEX, "crossref": CROSSREF, "europe_pmc": EUROPE_PMC, "semantic_scholar": SEMANTIC, "core": CORE}[provider]
    j = F.from_json(json, schema)
    if provider == "openalex":
        cols = _shape(provider, j["doi"], j["title"], X.revert(j["abstract_inverted_index"]), j["publication_year"], j["primary_location"]["source"]["display_name"], F.transform(j["authorships"], lambda a: a["author"]["display_name"]))
    elif provider == "crossref":
        cols = _shape(provider, j["DOI"], F.get(j["title"], 0), j["abstract"], F.get(F.get(j["issued"]["date-parts"], 0), 0), F.get(j["container-title"], 0), F.transform(j["author"], lambda a: F.concat_ws(" ", a["given"], a["family"])))
    elif provider == "europe_pmc":
        cols = _shape(provider, j["doi"], j["title"], j["abstractText"], j["pubYear"].try_cast("int"), j["journalTitle"], F.split(j["authorString"], ", "))
    elif provider == "semantic_scholar":
        cols = _shape(provider, j["externalIds"]["DOI"], j["title"], j["abstract"], j["year"], j["venue"], _names(j["authors"]))
    else:
        cols = _shape(provider, j["doi"], j["title"], j["abstract"], j["yearPublished"], j["publisher"], _names(j["authors"]))
    return df.select(*[c for c in df.columns if c != json], *cols)


class Discovery(DataSource):
    """Bibliographic discovery: one partition a query. ``fetch(query, limit)`` is given by the
    user of the library and yields (provider, json) pairs; nothing here opens a connection."""

    fetch: Callable[[str, int], Iterator[tuple[str, str]]] = staticmethod(lambda query, limit: iter(()))
    MOST_QUERIES, MOST_RECORDS = 10, 100

    @classmethod
    def name(cls) -> str:
        return "discovery"

    def schema(self) -> str:
        return "query string, provider string, json string"

    def reader(self, schema) -> DataSourceReader:
        return DiscoveryReader(self.options, type(self).fetch)


class DiscoveryReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.limit, self.fetch = int(options.get("limit", 20)), fetch
        if len(self.queries) > Discovery.MOST_QUERIES or not 1 <= self.limit <= Discovery.MOST_RECORDS:
            raise ValueError("too many queries, or a limit out of range")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k, (provider, json) in enumerate(self.fetch(partition.value, self.limit)):
            if k >= self.limit:
                return
            yield partition.value, provider, json
