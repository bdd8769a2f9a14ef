"""Near-duplicates by min-max hashing of word shingles.

Under each permutation both the least and the greatest value of a set are kept, so a signature takes half the hash evaluations of
one-sided hashing; a band is the four values of two permutations. The number of bands follows from the threshold, so that a pair at
it is missed less than once in ten million. Equal sets are one node from the start, however many documents have them.

A bucket's pairs are never listed. The member that shares most buckets leads, and all others are compared with it on their full
sets. What it links is one class; for those that it doesn't link, members of its star are compared by the shingles that set them
apart from the leader, block by block, which decides every pair exactly.

Words: A-Z in lower case, then runs of other bytes than white space. Defined results: null, empty and blank texts have no set and are
linked with nothing; fewer words than a shingle form one; rows that share a doc_id are one document; a null doc_id is kept alone."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stash, stash, text_views
from .components import components, pick
from .decontaminate import _mix, words

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
PER_BAND = 2  # permutations; four values
MISSED = 1e-7
SALTS = 64
MEMBERS_PER_SALT = 500
MEMBERS_PER_BLOCK = 1_000


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** (2 * PER_BAND)))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and each document's first (and one more at the end)."""
    hashes, bounds, _ = words(data, offsets, _WORD)
    n = np.diff(bounds)
    weight = _mix(np.arange(k) + 1000) | np.uint64(1)
    out = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k):
        out += hashes[j : j + len(out)] * weight[j]
    out = _mix(out)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short) and (n >= k).all():
        keep = np.ones(len(out), bool)
        for j in range(1, k):  # shingles that would run into the next document
            keep[np.maximum(bounds[1:-1] - j, 0)] = False
        return out[keep], np.concatenate([[0], np.cumsum(n - k + 1)])
    sizes = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(sizes)])
    res = np.empty(first[-1], np.uint64)
    for d in range(len(n)):
        if n[d] >= k:
            res[first[d] : first[d + 1]] = out[bounds[d] : bounds[d] + sizes[d]]
        elif n[d]:
            res[first[d]] = _mix((hashes[bounds[d] : bounds[d + 1]] * weight[: n[d]]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n[d]))[0]
    return res, first


def distinct_sets(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Each document's sorted distinct shingles."""
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the distinct set, null for none), bands array<long>."""
    scale = _mix(np.arange(bands * PER_BAND) + 77) | np.uint64(1)
    shift = _mix(np.arange(bands * PER_BAND) + 7_777)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_views(batch, most=1 << 20):
                values, first = shingles(data, offsets, k)
                sets = distinct_sets(values, first)
                has = np.flatnonzero(np.diff(first))
                keys = np.zeros((hi - lo, bands), np.uint64)
                if len(has):
                    at = first[has]
                    for b in range(bands):
                        key = np.full(len(has), b + 1, np.uint64)
                        for p in range(b * PER_BAND, (b + 1) * PER_BAND):
                            v = values * scale[p] + shift[p]
                            key = _mix(key ^ np.minimum.reduceat(v, at))
                            key = _mix(key ^ np.maximum.reduceat(v, at))
                        keys[has, b] = key
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(keys.view(np.int64).ravel(), bands).cast(pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


STARS = "leader long, member long, hit boolean, size long, differs array<long>"


def similar(same: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * same >= percent * (a + b - same)


def stars(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Each member against its leader on full sets: whether they are linked, the member's size, and, where the leader has other
    members, the shingles that only one of the two has.

    A leader's text goes to as many tasks as its members need, ahead of them, and members stream past it."""
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / MEMBERS_PER_SALT).cast("int")
    members = pairs.join(sizes, "leader").select("leader", F.col("member").alias("doc_id"), F.pmod(F.xxhash64("member"), salts).cast("int").alias("salt"), F.lit(1).alias("turn"), "n")
    leaders = sizes.select("leader", F.col("leader").alias("doc_id"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("turn"), "n")
    rows = leaders.unionByName(members).join(texts, "doc_id").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for lo, _, data, offsets in text_views(batch, most=1 << 20):
                out: list[tuple] = []
                for i, s in enumerate(distinct_sets(*shingles(data, offsets, k)), lo):
                    leader, doc_id, turn, n = (batch.column(c)[i].as_py() for c in range(4))
                    if turn == 0:
                        now, own = leader, s
                        continue
                    if now != leader:
                        raise RuntimeError("a leader's text is missing")
                    both = np.concatenate([s, own])
                    both.sort()
                    twice = both[1:] == both[:-1]
                    differs = None
                    if n > 1:
                        once = np.ones(len(both), bool)
                        once[1:] &= ~twice
                        once[:-1] &= ~twice
                        differs = both[once].view(np.int64)
                    out.append((leader, doc_id, bool(similar(twice.sum(), len(s), len(own), percent)), len(s), differs))
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())))], names=["leader", "member", "hit", "size", "differs"])

    return rows.select("leader", "doc_id", "turn", "n", "text").mapInArrow(run, STARS)


def within_stars(found: DataFrame, percent: int) -> DataFrame:
    """Links between members of a star that its leader doesn't already hold together, exactly.

    What two members have in common follows from what sets each apart from their leader, so short difference sets are compared, not
    texts. Members that are linked with the leader are held together by it, so only the others are looked up, each in blocks of all
    members: a star of n members of which a few aren't linked takes about n rows. A block of the ones meets a block of the others in one
    task, as two lists of members, never as pairs."""
    open_ = found.groupBy("leader").agg(F.count("*").alias("n"), F.count_if(~F.col("hit")).alias("apart")).filter("n > 1 and apart > 0")
    blocks = lambda n: F.ceil(F.col(n) / MEMBERS_PER_BLOCK).cast("int")
    stars_ = found.join(open_.select("leader", blocks("n").alias("all"), blocks("apart").alias("few")), "leader")
    place = lambda of: F.pmod(F.xxhash64("member"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    cols = ("member", "hit", "size", "differs")
    asked = stars_.select("leader", every("few").alias("i"), place("all").alias("j"), F.lit(0).alias("asks"), *cols)
    asking = stars_.filter(~F.col("hit")).select("leader", place("few").alias("i"), every("all").alias("j"), F.lit(1).alias("asks"), *cols)
    rows = asked.unionByName(asking).repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    def solve(group: list[tuple]) -> pa.RecordBatch:
        asks, member, hit, size = (np.array([r[c] for r in group]) for c in (3, 4, 5, 6))
        n = np.array([len(r[7]) for r in group])
        p, q = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
        kinds, code, times = np.unique(np.concatenate([np.asarray(r[7], np.int64) for r in group]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(group)), n)
        shared = times[code] > 1
        number = np.cumsum(times > 1) - 1
        row, col = row[shared], number[code[shared]]
        same = np.zeros((len(p), len(q)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for c in range(0, int((times > 1).sum()), 2_048):
            a, b = np.searchsorted(col, [c, c + 2_048])
            x = np.zeros((len(group), 2_048), np.float32)
            x[row[a:b], col[a:b] - c] = 1
            same += x[p] @ x[q].T
        apart = n[p][:, None] + n[q][None, :] - 2 * same.astype(np.int64)
        common = (size[p][:, None] + size[q][None, :] - apart) // 2
        link = similar(common, size[p][:, None], size[q][None, :], percent) & (hit[q][None, :] | (member[p][:, None] < member[q][None, :]))
        a, b = np.nonzero(link)
        return pa.RecordBatch.from_arrays([pa.array(member[p[a]], pa.int64()), pa.array(member[q[b]], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns[:7]), batch.column(7)):
                r = (*r[:7], r[7].values.to_numpy(zero_copy_only=False))
                if group and r[:3] != group[0][:3]:
                    yield solve(group)
                    group = []
                group.append(r)
        if group:
            yield solve(group)

    return rows.mapInArrow(run, "a long, b long")


def classes(reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """reps: doc_id, bands: one document of each distinct set. id, component of those that are linked with another.

    Two members of a bucket are both members of its leader's star, so all of a bucket's pairs are decided in one round."""
    cells = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = cells.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    cells = stash(cells.join(shared, "key"), "cells")
    degree = cells.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    sized, cells = cells, stash(cells.join(degree, "doc_id").select("key", "doc_id", "degree"), "cells")
    drop_stash(sized)
    top = cells.groupBy("key").agg(F.max_by("doc_id", F.struct("degree", -F.col("doc_id"))).alias("leader"))
    pairs = stash(cells.join(top, "key").filter("doc_id != leader").select("leader", F.col("doc_id").alias("member")).distinct(), "pairs")
    drop_stash(cells)
    wanted = pairs.select(F.col("leader").alias("doc_id")).union(pairs.select("member")).distinct()
    found = stash(stars(pairs, pick(docs, wanted).dropDuplicates(["doc_id"]), k, percent), "stars")
    drop_stash(pairs)
    links = found.filter("hit").select(F.col("leader").alias("a"), F.col("member").alias("b")).unionAll(within_stars(found, percent))
    known = components(links)
    drop_stash(found)
    return known


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are pairs with 100 * intersection >= percent * union of their k-word shingle sets."""
    rows = stash(signatures(docs, k, bands_for(percent)), "signatures").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    full = rows.filter("set_key is not null and doc_id is not null")
    sets = full.groupBy("set_key", "salt").agg(F.min("doc_id").alias("m"))
    sets = stash(sets.withColumn("rep", F.min("m").over(Window.partitionBy("set_key"))).drop("m"), "sets")
    reps = full.join(sets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "bands").dropDuplicates(["doc_id"])
    known = classes(reps, docs, k, percent).withColumnRenamed("id", "rep")
    sets = sets.join(known, "rep", "left").select("set_key", "salt", F.coalesce("component", "rep").alias("component"))
    placed = full.join(sets, ["set_key", "salt"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.filter("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose document stays: the smallest doc_id of each class. Rows without an id, and without words, are no
    one's duplicates and stay; repeated rows of a document that stays all stay."""
    gone = near_duplicates(docs, k, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
