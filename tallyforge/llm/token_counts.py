"""Token counts of flat, unindexed token files by a separator scan.

A file is nothing but little-endian unsigned ids; an end-of-document id closes each document. Every file is read as blocks, the
separators of all blocks are found by array comparison, and a running maximum over the blocks' last separators (a prefix scan)
gives each block the place where its first document begins. Files are stitched the same way from one summary row each, so
documents may lie across blocks and files.

The files that write_flat makes hold id + 1, so 0 is free to end a document; ids below 65,535 take two bytes, others four. They
are written by Spark's own text writer with the end id as its line separator, to any file system, without a shuffle.

Defined results: null and empty texts have the end id alone; repeated rows, and rows without an id, are documents each; a document without an end at the end of the last file is returned with
ended false; no files give no rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stash
from .encoder import encoder

BLOCK = 1 << 20
DOCUMENTS_PER_FILE = 10_000


def _same_scan(docs: DataFrame) -> DataFrame:
    """The same columns for writing and for matching, so that both see the same tasks and the same order of rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def write_flat(docs: DataFrame, path: str, tokenizer_path: str, width: int = 2) -> None:
    """Flat files of `width`-byte ids (+ 1), 0 after each document, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind = encoder(tokenizer_path), f"<u{width}"
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids = [enc.ids(t.as_py() or "") for t in batch.column(1).slice(at, 500)]
                if max((int(x.max()) for x in ids if len(x)), default=0) + 1 >= 1 << 8 * width:
                    raise ValueError(f"ids do not fit into {width} bytes")
                yield pa.RecordBatch.from_arrays([pa.array([(x + np.uint32(1)).astype(kind).tobytes() for x in ids], pa.binary())], names=["ids"])

    raw = _same_scan(docs).mapInArrow(run, "ids binary")
    raw.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", "\0" * width).option("maxRecordsPerFile", DOCUMENTS_PER_FILE).text(path)


def scan(tokens: np.ndarray, end: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Places of the end ids, and of the first id of the document that each closes (-1 where it began before these tokens)."""
    found = [np.flatnonzero(tokens[a : a + block] == end) + a for a in range(0, len(tokens), block)]
    last = np.array([f[-1] if len(f) else -1 for f in found] or [-1], np.int64)
    before = np.concatenate([[-1], np.maximum.accumulate(last)[:-1]])  # the last end id before each block
    starts = [np.concatenate([[b], f[:-1]]) + 1 for f, b in zip(found, before) if len(f)]
    ends, first = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(starts or [np.zeros(0, np.int64)])
    if len(first):
        first[0] = -1
    return ends.astype(np.int64), first.astype(np.int64)


def token_counts(spark: SparkSession, path: str, width: int = 2, end: int = 0) -> DataFrame:
    """file, place (of the document in its file), start (over all files in the order of their names), n_tokens (with the end id), ended.

    To the driver come three numbers for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.frombuffer(content.as_buffer(), f"<u{width}")
                ends, first = scan(tokens, end)
                n = len(ends)
                # the last row sums up the file
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (n + 1)), pa.array(np.append(np.arange(n), -1)), pa.array(np.append(first, ends[-1] if n else -1)), pa.array(np.append(ends, len(tokens)))],
                    names=["file", "place", "first", "last"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = stash(files.mapInArrow(run, "file string, place long, first long, last long"), "separators")
    base, carry, summed = 0, 0, []
    for r in sorted(rows.filter("place = -1").collect(), key=lambda r: r["file"]):
        summed.append((r["file"], base, carry))
        carry = base + r["first"] + 1 if r["first"] >= 0 else carry
        base += r["last"]
    if not summed:
        return spark.createDataFrame([], "file string, place long, start long, n_tokens long, ended boolean")
    at = F.broadcast(spark.createDataFrame(summed, "file string, base long, carry long"))
    start = F.when(F.col("first") < 0, F.col("carry")).otherwise(F.col("base") + F.col("first"))
    out = rows.filter("place >= 0").join(at, "file").select("file", "place", start.alias("start"), (F.col("base") + F.col("last") + 1 - start).alias("n_tokens"), F.lit(True).alias("ended"))
    if carry < base:
        out = out.unionAll(spark.createDataFrame([(summed[-1][0], -1, carry, base - carry, False)], out.schema))
    return out


def document_places(docs: DataFrame) -> DataFrame:
    """doc_id, part (the task that reads it), row (from 0 within it): as write_flat meets the rows of the same scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=["doc_id", "part", "row"])
            at += n

    return _same_scan(docs).mapInArrow(run, "doc_id long, part int, row long")


def documents_round_trip(docs: DataFrame, tokenizer_path: str, width: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, file: written as flat files, counted from them, and matched to the documents by task and order.

    The rows are read twice, by the same plan: docs must give the same tasks and order whenever it runs, as a scan or a written table
    does. A task with another number of documents than its files hold raises an error."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/flat-{uuid.uuid4().hex}"
    write_flat(docs, path, tokenizer_path, width)
    counted = token_counts(spark, path, width).withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
    by_file = sorted((r["part"], r["file"], r["n"]) for r in counted.filter("ended").groupBy("part", "file").agg(F.count("*").alias("n")).collect())
    before, rows, total = [], 0, {}
    for k, (part, file, n) in enumerate(by_file):
        rows = 0 if not k or by_file[k - 1][0] != part else rows
        before.append((file, rows))
        rows += n
        total[part] = rows
    places = document_places(docs)
    have = {r["part"]: r["n"] for r in places.groupBy("part").agg(F.count("*").alias("n")).collect()}
    if have != total:
        raise RuntimeError("the scan was dealt to tasks in another way than when it was written")
    if not before:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, file string")
    offset = F.broadcast(spark.createDataFrame(before, "file string, before long"))
    counted = counted.filter("ended").join(offset, "file").withColumn("row", F.col("place") + F.col("before"))
    return places.join(counted, ["part", "row"]).select("doc_id", "start", "n_tokens", "file")
