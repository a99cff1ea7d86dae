"""Bundles: a folder of tables with a manifest that says what they are. Writers of runs, screenings,
encodings, folds, scores, handoffs, readings and projects; loaders with a version gate; PDF scans.

A manifest is one JSON line, written last: a folder without one is an unfinished bundle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import encode
from . import sinks

#: Tables and columns that each kind of bundle must have, and its version.
KINDS = {
    "run": ("run/1", {"records": ["record_id", "title", "doi", "decision"]}),
    "screening": ("screening/1", {"records": ["record_id", "decision"], "ranking": ["record_id", "priority_score"], "review_template": ["record_id", "decision", "reviewer", "note"]}),
    "encoding": ("encoding/1", {"X": ["row_index"], "y": ["row_index"], "mapping": ["row_index"], "dictionary": ["field", "role", "column"], "excluded": ["reason"]}),
    "fold": ("fold/1", {"train/X": ["row_index"], "validation/X": ["row_index"], "statistics": []}),
    "scores": ("scores/1", {"quality": [], "performance": [], "excluded": ["reason"]}),
    "handoff": ("handoff/1", {"ready": ["split_group"], "waiting": ["split_group"], "relations": []}),
    "readings": ("readings/1", {"points": ["session"], "skipped": ["session", "reason"]}),
    "project": ("project/1", {"measurements": [], "features": [], "claims": []}),
}


def write_bundle(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], as_csv: tuple[str, ...] = ()) -> None:
    """The tables of a bundle as Parquet (and as guarded CSV where asked), then its manifest with
    rows and checksums of each."""
    version, wanted = KINDS[kind]
    missing = [f"{t}.{c}" for t, cols in wanted.items() for c in cols if t not in tables or c not in tables[t].columns] + [t for t in wanted if t not in tables]
    if missing:
        raise ValueError(f"a bundle of kind {kind} lacks {sorted(set(missing))}")
    sums = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        kept = spark.read.parquet(f"{path}/{name}")
        row = encode.checksum(kept).first()
        sums[name] = {"rows": row.n_rows, "checksum": row.checksum}
        if name in as_csv:
            sinks.write_csv(kept, f"{path}/csv/{name}")
    line = json.dumps({"kind": kind, "version": version, "tables": sums}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str, kind: str, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a bundle; its kind, version, tables and columns must be right, and with
    ``check`` the rows and checksums that were written with it."""
    lines = [r.value for r in spark.read.text(f"{path}/manifest").limit(2).collect()]
    if len(lines) != 1:
        raise ValueError("an unfinished bundle, or two in one folder")
    manifest, (version, wanted) = json.loads(lines[0]), KINDS[kind]
    if manifest.get("kind") != kind or manifest.get("version") != version:
        raise ValueError(f"not a bundle of kind {kind}, version {version}")
    out = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    for name, cols in wanted.items():
        if name not in out or set(cols) - set(out[name].columns):
            raise ValueError(f"the bundle lacks {name} or columns of it")
    for name, df in out.items() if check else ():
        row = encode.checksum(df).first()
        if {"rows": row.n_rows, "checksum": row.checksum} != manifest["tables"][name]:
            raise ValueError(f"{name} has changed since it was written")
    return out


def write_run(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Records, counts by decision, and the DOIs of what is a target."""
    counts = records.groupBy("decision").agg(F.count(F.lit(1)).alias("n_records"))
    dois = records.where("decision = 'target' AND doi <> ''").select("doi").distinct()
    write_bundle(spark, path, "run", {"records": records, "counts": counts, "dois": dois}, ("records", "counts"))


def write_screening(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Records, their ranking, and an empty review template, from one table."""
    template = records.select("record_id", *[F.lit("").alias(c) for c in ("decision", "reviewer", "note")])
    ranking = records.select("record_id", "priority_score")
    write_bundle(spark, path, "screening", {"records": records, "ranking": ranking, "review_template": template}, ("records", "review_template"))


def write_encoding(spark: SparkSession, path: str, encoding, task) -> None:
    """X, y and mapping in one row order, the dictionary, and what was left out."""
    columns = [r.column for r in encoding.dictionary.where("role IN ('number', 'missing', 'unknown', 'indicator')").orderBy("column").collect()]  # a row a column
    rows = encode.aligned_index(encoding.rows, [task.group, task.key])
    quoted = [F.col(f"`{c}`") for c in columns]
    parts = {"X": rows.select("row_index", "split", *quoted), "y": rows.select("row_index", "split", task.value), "mapping": rows.select("row_index", "split", task.key, task.group)}
    write_bundle(spark, path, "encoding", parts | {"dictionary": encoding.dictionary, "excluded": encoding.excluded}, ("dictionary", "excluded"))


def write_fold(spark: SparkSession, path: str, rows: DataFrame, folds: DataFrame, fold: int, task) -> None:
    """Matrices of one development fold, imputed and scaled by its training part alone; test groups
    never come in."""
    placed = rows.where("split = 'train'").join(folds.select(task.group, "fold"), task.group)
    fields = list(task.numeric)
    statistics = encode.fold_statistics(placed.where(F.col("fold") != fold), fields)
    tables: dict[str, DataFrame] = {"statistics": statistics}
    for name, part in (("train", placed.where(F.col("fold") != fold)), ("validation", placed.where(F.col("fold") == fold))):
        made = encode.aligned_index(encode.transform(part, statistics, fields), [task.group, task.key])
        tables[f"{name}/X"] = made.select("row_index", *fields, *[f"{f}__missing" for f in fields])
        tables[f"{name}/y"] = made.select("row_index", task.value)
        tables[f"{name}/mapping"] = made.select("row_index", task.key, task.group)
    write_bundle(spark, path, "fold", tables)


def write_scores(spark: SparkSession, path: str, scores, key: str) -> None:
    """Quality and performance of each row, the ratios one a row, what has no score, and the report."""
    ratios = [c for c in scores.cards.columns if c.startswith("ratio_")]
    checks = scores.cards.select(key, F.explode(F.map_from_arrays(F.array(*[F.lit(c[6:]) for c in ratios]), F.array(*ratios))).alias("check", "ratio"))
    performance = scores.cards.where("performance IS NOT NULL").select(key, "performance")
    write_bundle(spark, path, "scores", {"quality": scores.cards.select(key, "quality_score"), "performance": performance, "checks": checks, "excluded": scores.excluded, "report": scores.report}, ("quality", "performance", "excluded"))


def write_handoff(spark: SparkSession, path: str, records: DataFrame, relations: DataFrame) -> None:
    """Records (of ``workflow.handoff``) that are ready, those that wait, and relations apart."""
    part = lambda name: records.where(F.col("stage") == name)
    write_bundle(spark, path, "handoff", {"ready": part("ready_for_standardization"), "waiting": part("needs_review"), "relations": relations}, ("ready", "waiting"))


def write_readings(spark: SparkSession, path: str, exports: DataFrame, points: DataFrame) -> None:
    """Points of each session's latest export; older exports are listed as skipped."""
    last = exports.groupBy("session").agg(F.max_by("export", F.struct("at", "export")).alias("export"))
    kept = points.join(last, ["session", "export"], "left_semi")
    skipped = exports.join(last, ["session", "export"], "left_anti").select("session", "export", F.lit("superseded").alias("reason"))
    write_bundle(spark, path, "readings", {"points": kept, "skipped": skipped}, ("points", "skipped"))


def write_project(spark: SparkSession, path: str, measurements: DataFrame, features: DataFrame, claims: DataFrame) -> None:
    """Reviewed measurements, features and claims of a project."""
    write_bundle(spark, path, "project", {"measurements": measurements, "features": features, "claims": claims}, ("measurements", "features", "claims"))


# --- PDF scans with a given reader of page texts -------------------------------------------------------

SCREENED = "source string, sha256 string, n_bytes long, n_pages int, doi string, title string, abstract string, error string"


class PdfScreen:
    """Title, abstract and DOI of a PDF's first pages. ``pages(content, most)`` gives their texts."""

    def __init__(self, pages: Callable[[bytes, int], list[str]], most: int, single_doi: bool):
        self.pages, self.most, self.single_doi = pages, most, single_doi

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        doi = re.compile(r"10\.\d{4,9}/[^\s\"<>]*[^\s\"<>.,;)\]]")
        heading = re.compile(r"(?is)\babstract\b[\s.:—-]*(.+?)(?=\n\s*\n|\b(?:keywords?|introduction)\b|\Z)")
        for batch in batches:
            rows = []
            for path, digest, size, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                texts, problem = [], None
                try:
                    if not content.lstrip().startswith(b"%PDF-"):
                        raise ValueError("not a PDF")
                    texts = self.pages(content, self.most)
                except Exception as e:  # a bad file is a row, not a failed job
                    problem = f"{type(e).__name__}: {e}"[:500]
                whole = "\n".join(texts)
                found = list(dict.fromkeys(m[0].lower() for m in doi.finditer(whole)))
                known = found[0] if found and (len(found) == 1 or not self.single_doi) else None
                lines = [x.strip() for x in (texts[0] if texts else "").split("\n") if len(x.split()) >= 4]
                match = heading.search(whole)
                rows.append((path, digest, size, len(texts), known, lines[0] if lines else None, " ".join(match[1].split()) if match else None, problem))
            if rows:
                types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in SCREENED.split(", ")])


def screen_pdfs(spark: SparkSession, path: str, pages: Callable[[bytes, int], list[str]], most: int = 5, recursive: bool = True, single_doi: bool = False) -> DataFrame:
    """A row a PDF below a folder, unreadable ones with their error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.sha2("content", 256).alias("d"), "length", "content").mapInArrow(PdfScreen(pages, most, single_doi).__call__, SCREENED)


def local_pdf_run(spark: SparkSession, path: str, pages: Callable[[bytes, int], list[str]]) -> DataFrame:
    """PDFs of one folder, by their first two pages; a DOI only where exactly one is printed."""
    return screen_pdfs(spark, path, pages, 2, recursive=False, single_doi=True)


def pdf_intake(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Every PDF of a folder as a waiting paper; equal files are all kept and marked as repeats."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower()).load(path)
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), "length", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))
    first = rows.groupBy(F.col("sha256").alias("d")).agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    out = rows.join(first, F.col("sha256") == F.col("d")).drop("d")
    return out.select("path", "sha256", "length", X.digest_id(20, F.col("sha256")).alias("paper_id"), F.when(~F.col("is_pdf"), "not_a_pdf").otherwise("waiting").alias("state"), (F.col("path") != F.col("first")).alias("repeat"), "n_copies")
