"""Best-fit packing planned on the length histogram.

The plan sees one count per length, at most `capacity` of them, whatever the corpus holds: best-fit decreasing is run on
groups of equal sequences instead of on documents. Documents then take planned slots by their rank within their length.

Defined results: null and empty texts have the end id alone, one piece of length 1; repeated rows take a slot each;
an empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_in_group, stash
from .encoder import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "length long, rank_from long, rank_to long, first_sequence long, times long, first_offset long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut every `capacity` ids where they are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([enc.ids(text.as_py() or "").astype("<u4", copy=False), end])
                rows += [(doc_id, k, at, len(part := ids[at : at + capacity]), zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), capacity))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Best-fit decreasing over counts: slots (length, rank_from, rank_to, first_sequence, times, first_offset), and the number of sequences.

    A slot gives ranks rank_from.. of a length to the sequences from first_sequence on, `times` pieces in each from first_offset.
    Sequences that are filled alike form one group; a length splits at most one group, so there are few."""
    slots: list[tuple[int, ...]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free ids -> (first sequence, sequences)
    sizes: list[int] = []  # the keys of room, sorted
    total = 0

    def keep(free: int, first: int, n: int) -> None:
        if free and n:
            if not room[free]:
                insort(sizes, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, n = room[free].pop()
                if not room[free]:
                    sizes.pop(at)
            else:
                free, first, n = capacity, total, -(-left // (capacity // length))
                total += n
            times = min(free // length, left)
            use = min(n, left // times)
            slots.append((length, rank, rank + use * times, first, times, capacity - free))
            keep(free - times * length, first, use)
            if n > use:
                keep(free, first + use, n - use)
            rank, left = rank + use * times, left - use * times
    return slots, total


def pack(items: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to capacity. items is read more than once: hand in a stashed one.

    To the driver comes the histogram, at most `capacity` rows; the slots that are broadcast are a few for each length."""
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(counts, capacity)
    table = F.broadcast(spark.createDataFrame(slots, SLOTS).withColumnRenamed("length", "_length"))
    ranked = rank_in_group(items, "length", order=order, name="_rank")
    at = F.col("_rank") - F.col("rank_from")
    return (
        ranked.join(table, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(at / F.col("times")))
        .withColumn("offset", F.col("first_offset") + F.pmod(at, F.col("times")) * F.col("length"))
        .drop("_rank", "_length", *SLOTS.replace(",", "").split()[2::2])
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Each row's ids and an end, cut where they are longer than the capacity, in sequences. Null and empty texts are an end; repeated rows
    and rows without an id are packed each; an empty table gives no rows."""
    return pack(stash(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
