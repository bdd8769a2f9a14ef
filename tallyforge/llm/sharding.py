"""Minimax contiguous partition of atomic groups into shards.

Rows with equal texts form one group; groups are ordered by a 64-bit hash of the text. The smallest shard capacity for which
a greedy walk needs at most `shards` shards is found by binary search, and the walk's cuts are the shards' bounds.
The walk sees sums by hash prefix: 65,536 of them first, then only the buckets that may hold a cut are divided further, until no
bucket with more than one group is left there. So the driver holds a bounded number of sums at any size.

Defined results: null text has no bytes (size 8) and groups with other nulls, apart from empty texts; repeated rows stay together;
a group larger than the capacity of equal shards sets the capacity; an empty table gives no rows. All [native] expressions."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rank_in_group, stash

KEY_BITS = 63
FIRST_BITS, MORE_BITS = 16, 8


def group_key(text: Column) -> Column:
    """63 bits of the text's hash, not negative; nulls have the key 0."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(text), 1))


def walk(firsts: list[int], sizes: list[int], prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (indices where a shard begins, without 0) with no shard over capacity; None if more than `shards` are needed."""
    cuts, at = [], 0
    while True:
        end = bisect_right(prefix, prefix[at] + capacity) - 1
        if end == len(sizes):
            return cuts
        if end == at or len(cuts) == shards - 1:
            return None
        cuts.append(at := end)


def smallest(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity over ordered sizes, and its cuts."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    low, high = max([-(-prefix[-1] // shards), *sizes], default=0), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if walk(sizes, sizes, prefix, mid, shards) is not None else (mid + 1, high)
    return low, walk(sizes, sizes, prefix, low, shards) or []


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """groups: key long, size long. The least keys of shards 1.., and the capacity. Buckets are divided where a cut may fall."""
    cells: dict[tuple[int, int], tuple[int, int]] = {}  # (bits, prefix) -> (size, keys)

    def fetch(bits: int, within: list[tuple[int, int]] | None) -> None:
        df = groups
        if within is not None:  # a bounded list of buckets, matched on the bits that name them
            spark, parts = groups.sparkSession, []
            for b in sorted({c[0] for c in within}):
                names = F.broadcast(spark.createDataFrame([(p,) for c, p in within if c == b], "_p long"))
                parts.append(groups.join(names, F.shiftright("key", KEY_BITS - b) == F.col("_p"), "left_semi"))
            df = reduce(DataFrame.unionAll, parts)
        for r in df.groupBy(F.shiftright("key", KEY_BITS - bits).alias("p")).agg(F.sum("size").alias("s"), F.min("key").alias("a"), F.max("key").alias("b")).collect():
            cells[(bits, r["p"])] = (r["s"], 1 if r["a"] == r["b"] else 2)

    fetch(FIRST_BITS, None)
    while True:
        order = sorted(cells, key=lambda c: c[1] << (KEY_BITS - c[0]))
        sizes = [cells[c][0] for c in order]
        if not sizes:
            return [], 0
        prefix = [0]
        for s in sizes:
            prefix.append(prefix[-1] + s)
        # No solution over single groups is above this one, and none is below the mean and the largest single group.
        high, cuts = smallest(sizes, shards)
        low = max([-(-prefix[-1] // shards), *(cells[c][0] for c in order if cells[c][1] == 1)])
        open_cells: set[tuple[int, int]] = set()
        if low < high:
            # Over single groups, the k-th cut with a capacity between the two lies between these two positions: at least the
            # last bucket bound that the lower capacity reaches, at most where the higher ends, or where a single group does not fit.
            early = late = 0
            for _ in range(shards):
                early = max(early, prefix[bisect_right(prefix, early + low) - 1])
                late = min(late + high, prefix[-1])
                at = min(bisect_right(prefix, late) - 1, len(order) - 1)
                if cells[order[at]][1] == 1 and late < prefix[at + 1]:
                    late = prefix[at]
                a = max(bisect_right(prefix, early) - 1, 0)
                open_cells |= {order[i] for i in range(a, at + 1) if cells[order[i]][1] > 1}
        if not open_cells:
            firsts = [order[i][1] << (KEY_BITS - order[i][0]) for i in cuts]
            return firsts, high
        bits = min(KEY_BITS, max(c[0] for c in open_cells) + MORE_BITS)
        todo = sorted(open_cells)
        for c in todo:
            del cells[c]
        fetch(bits, todo)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text").cast("string")
    rows = stash(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        group_key(text).alias("key")), "sized")
    firsts, _ = cut_keys(rows.select("key", "size"), shards)
    shard = F.lit(0)
    for k in firsts:
        shard = shard + (F.col("key") >= F.lit(k)).cast("int")
    placed = rank_in_group(rows.withColumn("shard", shard.cast("int")), "shard", order=("doc_id", "text_crc32"), name="slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
