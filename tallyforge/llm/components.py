"""Connected components of links that never leave the executors, and lookups of a subset of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Bits of the filter that spares the shuffle of documents that aren't asked for; 4 MB at any size of the corpus.
FILTER_BITS = 25


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). id, component: the smallest id that each linked id reaches.

    Every round maps an id to its smallest neighbour, or itself, and that one's likewise; links are renamed and those within one id
    go. The ids left at least halve, so rounds grow with the logarithm of the longest chain; each round is written, not kept in lineage."""
    edges = stash(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b").distinct(), "links")
    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    state = ids.select("id", F.col("id").alias("component"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        jump = up.join(up.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p", "left").select("a", F.least("p", F.coalesce("pp", "p")).alias("to"))
        jump = stash(jump, "jumps")
        left, right = jump.select("a", F.col("to").alias("x")), jump.select(F.col("a").alias("b"), F.col("to").alias("y"))
        last = [edges, state, jump]
        edges = stash(edges.join(left, "a").join(right, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        state = stash(state.join(jump.withColumnRenamed("a", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        drop_stash(*last)
    return state


def _bit(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))


def bitmap(bits: DataFrame) -> np.ndarray:
    """bits: bit (long, below 1 << FILTER_BITS). A bitmap of them, built by the executors; 4 MB at most reach the driver."""
    bit = F.col("bit") + 1
    parts = bits.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts:  # buckets count from 1
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def pick(docs: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys and the text of the documents whose keys are in `ids` (the keys, distinct).

    A bitmap of the keys' hashes, of a fixed size, first drops most other documents where they are read, so their text isn't
    shuffled; the join then decides. With more keys than bits it only drops less."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(_bit(*keys).alias("bit"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            kept = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays(kept.columns[1:], names=[*keys, "text"])

    typed = [F.col(k).cast("long").alias(k) if k == "doc_id" else F.col(k) for k in keys]
    rows = docs.select(*typed, F.col("text").cast("string").alias("text"))
    near = rows.select(_bit(*keys).alias("bit"), *keys, "text").mapInArrow(run, rows.schema)
    return near.join(ids, list(keys), "left_semi")
