"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Rows are dealt by ranges of doc_id and sorted within them, so files, stripes and row groups each hold a narrow range of ids;
a reader of some documents skips the rest by metadata, and a reader of all takes stripes in parallel.

Defined results: null and empty texts have the end id alone; repeated rows, and rows without an id, are documents each; a null doc_id sorts first; an empty table gives no rows."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder
from .encoder import encoder

#: Stripes of so many bytes can be read by a task each; a row index entry stands for so many rows.
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}
#: Words that a worker keeps the ids of: rare words come again in later documents, and fewer than these would be encoded anew each time.
MOST_WORDS = 240_000


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, ids array<int>: the whole text's ids and the end id. Row order is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path, MOST_WORDS), np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # a few MB of ids at a time
                part = batch.slice(at, 500)
                ids = [np.concatenate([enc.ids(t.as_py() or ""), end]) for t in part.column(1)]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                values = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode and write in ascending doc_id order: file by file, and within each."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    encode(dealt, tokenizer_path, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids, file; with doc_ids, stripes and row groups without them are skipped."""
    df = spark.read.schema("doc_id long, ids array<int>").orc(path)
    if doc_ids is not None:
        df = df.filter(F.col("doc_id").isin(doc_ids))
    return df.select("doc_id", "ids", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens gives: files follow each other in the order of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).cast(pa.large_list(pa.int32()))
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(offsets)), pa.array([zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64())],
                names=["doc_id", "file", "n_tokens", "ids_crc32"])

    rows = tokens.mapInArrow(run, "doc_id long, file string, n_tokens long, ids_crc32 long")
    return rows


def place(rows: DataFrame, file_tokens: dict[str, int]) -> DataFrame:
    """start: the ids of the files before, from their totals (one number a file), and of the rows before in the same file."""
    firsts, at = [], 0
    for name in sorted(file_tokens):
        firsts.append((name, at))
        at += file_tokens[name]
    first = F.broadcast(rows.sparkSession.createDataFrame(firsts, "file string, first long"))
    before = Window.partitionBy("file").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .join(first, "file")
        .select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file")
    )


def tokens_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the files, read them back, and return each document's place and digest in them."""
    from .common import stash

    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id)
    rows = stash(digests(read_tokens(spark, path)), "digests")
    totals = {r["file"]: r["n"] for r in rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()}
    return place(rows, totals)
