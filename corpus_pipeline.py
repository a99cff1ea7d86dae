"""A corpus pipeline of five stages: quality, near-duplicates, decontamination, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined cases: other columns are dropped, so none can clash; null and empty texts are judged by the
quality model as empty texts, count as near-duplicates (one of them stays), are never contaminated, are
not changed by redaction and give no words to the mix; rows with null or repeated ids are rows like any other; an empty table stays empty; without labels of
both classes the quality stage keeps or drops all by the base rate, and keeps all without labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.llm import decontaminate, mixing, neardup, pii, quality
from assaykit.llm.common import columns, table, written

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled rows of ``docs``."""
    plain = columns(docs, **COLUMNS)
    labels = columns(table(spark, sf_dir, "labels"), doc_id="long", quality="int")
    return quality.keep_good(plain, quality.train(plain, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id (null first), and of rows with
    equal ids the first by a digest of its columns. Rows are told apart by that digest, not by
    their ids, so unlike texts under one id or none all stay."""
    plain = columns(docs, **COLUMNS)
    keyed = plain.withColumn("row", F.md5(F.concat(*[F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in COLUMNS])))
    found = neardup.near_groups(keyed).withColumn("first", F.struct(F.coalesce("doc_id", F.lit(neardup.NO_ID)), "row"))
    first = found.groupBy("component").agg(F.min("first").alias("first")).select("first.row")
    # rows alike in all columns have one digest
    same = Window.partitionBy("row").orderBy("doc_id")
    return keyed.join(first, "row", "left_semi").withColumn("at", F.row_number().over(same)).where("at = 1").select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.keep_clean(columns(docs, **COLUMNS), table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text."""
    return pii.redact(columns(docs, **COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, their texts as mixed (blocks left out or repeated;
    n_chars is that of the new text), with the whole text's size, the target and the words taken."""
    plan = mixing.mix(columns(docs, **COLUMNS), carry=("text", "lang"))
    return plan.where("taken > 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("personal data", redacted),
    ("source mixing", mixed),
]
#: Fitted models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
