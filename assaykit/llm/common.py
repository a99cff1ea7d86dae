"""Shared pieces of the corpus operators: table access, Arrow row mapping, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes handled at once inside a Python worker; a longer text makes a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 4_000_000
#: Bytes of text that a training sample may take on the driver.
SAMPLE_BYTES = 48_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, cast to the type asked for; extra columns never clash."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in wanted.items()])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most SLICE_ROWS rows and, but for single rows, SLICE_BYTES bytes."""
    size = np.zeros(batch.num_rows, np.int64)
    for i, field in enumerate(batch.schema):
        if pa.types.is_string(field.type) or pa.types.is_binary(field.type) or pa.types.is_large_string(field.type) or pa.types.is_large_binary(field.type):
            size += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    stops, at = np.cumsum(size), 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(stops, (stops[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        end = min(max(fit, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def map_rows(df: DataFrame, fn: Callable[..., dict], schema: str | StructType) -> DataFrame:
    """Run ``fn(**columns as lists) -> dict of lists`` over slices of Arrow batches.

    ``fn`` may be a callable with a ``start()`` method, which is called once in each
    task (caches, compiled tables) and returns the function to use.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(kind)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn.start() if hasattr(fn, "start") else fn
        for batch in batches:
            for part in slices(batch):
                got = work(**{c: part.column(i).to_pylist() for i, c in enumerate(names)})
                arrays = [pa.array(got[f.name], type=f.type) for f in out]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of ``value`` with its class, for executors that lack this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(shared: Broadcast):
    return cloudpickle.loads(shared.value)


def ensure_checkpoints(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's, or else a folder of the warehouse, which
    driver and executors share as well."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        known = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/assaykit-checkpoints"
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables that ``written`` has made in this driver.
WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later plans read it as often as they like. It belongs
    to a lazy result, so it stays until ``drop_written`` is called."""
    path = f"{ensure_checkpoints(df.sparkSession).rstrip('/')}/assaykit-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables of results that have been read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """The split of a contract: crc32 of the id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(mod)) == rest


#: xxhash64 gives each of so many values with equal chance.
HASHES = float(1 << 64)


def first_by_hash(ids: DataFrame, salt: str, limit: int, count: int) -> DataFrame:
    """The ``limit`` ids (column doc_id) with the smallest seeded hashes, of ``count`` in all.

    A threshold on the hash leaves a few more than ``limit`` before anything is ordered, so tasks
    send no more than their share of them.
    """
    order = F.xxhash64(F.lit(salt), "doc_id")
    share = (limit + 6 * limit**0.5 + 20) / max(1, count)
    near = ids.where(order < F.lit(int(share * HASHES - HASHES / 2))) if share < 1 else ids
    return near.orderBy(order, "doc_id").limit(limit)


def sample_texts(docs: DataFrame, chosen: DataFrame, most_bytes: int = SAMPLE_BYTES) -> Iterator:
    """Rows (doc_id, text and the columns of ``docs`` and ``chosen``) by ``at``, one row an id.

    ``chosen`` (doc_id, at, ...) is bounded by its caller and is broadcast. Of rows with one id the
    one with the smallest content is taken, before anything reaches the driver. Rows come one
    partition after the other, until ``most_bytes`` bytes of text have come (the first always does).
    """
    rest = [c for c in docs.columns if c != "doc_id"]
    rows = docs.join(F.broadcast(chosen), "doc_id").withColumn("row", F.struct(F.xxhash64(*rest), *rest))
    one = rows.groupBy(*chosen.columns).agg(F.min("row").alias("row"))
    size = 0
    for row in one.select(*chosen.columns, *[f"row.{c}" for c in rest]).orderBy("at", "doc_id").toLocalIterator():
        own = len((row.text or "").encode("utf-8", "surrogatepass"))
        if size and size + own > most_bytes:
            return
        size += own
        yield row


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int, most_bytes: int = SAMPLE_BYTES) -> list:
    """At most ``limit`` labelled training rows and ``most_bytes`` bytes, half of them of either
    class where they exist; one row an id. Ids with labels of both classes are left out.

    The choice depends on the ids alone (seeded hash order), so reruns agree. Only ids are
    ordered; the texts are then fetched by a broadcast of at most ``limit`` ids.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = ids.where(train & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    sizes = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}  # two rows
    half = [first_by_hash(ids.where(F.col("y") == y), "sample", (limit + y) // 2, sizes.get(y, 0)) for y in (0, 1)]
    # classes take turns, so that a bound on bytes leaves as many of either
    turn = Window.partitionBy("y").orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id")
    chosen = half[0].unionByName(half[1]).withColumn("at", F.row_number().over(turn) * 2 + F.col("y"))
    rows = sample_texts(docs.select("doc_id", "text"), chosen, most_bytes)
    return sorted(((r.text or "", r.y, r.doc_id) for r in rows), key=lambda r: (r[2], r[0]))


def crc_mod(column: str, mod: int, rest: int) -> Column:
    return held_out(F.col(column), mod, rest)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
