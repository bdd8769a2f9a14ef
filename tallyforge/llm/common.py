"""Shared plumbing of the corpus operators: shared-folder tables, Arrow text views, salted ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one numpy step of an executor works on.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to a Python worker at a time, at most: with texts of some KB, a few MB.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS, so that several workers fit beside an executor's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new one of this machine if all of Spark
    runs in one process, as in tests; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tallyforge"


def stash(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and the copy outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(*tables: DataFrame) -> None:
    """Delete the files of all tables that stash gave and that these read. Only for what was written again since and is of the caller's own
    making: never for a plan that reads documents, which may be a stashed table themselves."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        home = path(f"{shared_folder(spark)}/").toUri().getPath()
        for folder in sorted({file.rsplit("/", 1)[0] for file in df.inputFiles()}):
            at = path(folder)
            if at.getParent().toUri().getPath() == home:
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_views(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of slices with at most `most` bytes, or one row; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def rank_in_group(df: DataFrame, key: str, rows_per_salt: int = 2_000, order: tuple[str, ...] = ("doc_id",), name: str = "rank") -> DataFrame:
    """Add a gapless rank from 0 within each key of a small fixed domain (it is broadcast), without gathering a hot key in one task.

    A key with many rows is dealt into salts by a hash of the order columns; ranks are counted within each
    (key, salt) and moved up by the counts of the salts before. df is read twice, so hand in a stashed one."""
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / rows_per_salt).cast("int").alias("_salts"))
    salted = df.join(F.broadcast(sizes), key)
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts")).cast("int"))
    before = (
        salted.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select(key, "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(key, "_salt").orderBy(*order)
    return (
        salted.withColumn("_row", F.row_number().over(within) - 1)
        .join(before, [key, "_salt"])
        .withColumn(name, (F.col("_row") + F.col("_before")).cast("long"))
        .drop("_salts", "_salt", "_row", "_before")
    )


def crc32_mod5(doc_id: Column) -> Column:
    """crc32 of the id written as text, mod 5: the folds of the scored operators."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5
