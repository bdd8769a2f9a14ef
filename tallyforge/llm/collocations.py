"""Phrase collocation mining: a count sketch first, exact counts of what it leaves second, then scores and subsumption.

Texts are cut into pieces at punctuation and line ends, pieces into words. Pass one: every task counts the hashes of all its words and phrases
(one to `most_words` words, with their language) in a row of 2^34 cells, which is never laid out: cells in use move as gaps and counts,
and are summed block by block. A cell never counts too few, so a phrase whose cell is below `least` isn't frequent. Cells that reach it are
marked in two bitmaps. Pass two: words and phrases that are marked, with the two phrases within
them, are counted as words, not as hashes, first within a slice of text, then by Spark; those that really reach `least` are left. Nothing frequent is
lost, whatever the widths: full cells or bitmaps only let more through.

Of each phrase, cuts meet the counts of both parts by joins; products are decimals of 38 digits. A phrase within a longer one that has `percent` of its
count goes. Ranks are taken within salts of a language first.

Defined results: null text is empty, null lang is 'und' and counted with it; words keep every other character; overlapping occurrences count each;
repeated rows count each; of equal scores and counts the phrase that is less as UTF-8 comes first; empty table or nothing frequent: no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stash, text_views

#: Cells of the sketch, and of a block of it: 2 to the power of these. A trillion occurrences are 58 to a cell; a wider row takes a bit more of each.
WIDE, INNER = 34, 23
#: Occurrences that a task sorts at a time, and cells that it sums up at a time (of a block at most as many as it has).
RUN, SUMMED = 1 << 22, 1 << 22
#: A cell and its count share 64 bits; counts stop there, and `least` with them.
MOST = (1 << (64 - WIDE)) - 1
#: Frequent cells are marked in two bitmaps of 2^26 bits, 8 MB each when they are broadcast. Some 60 million of them fill the bitmaps; from then
#: on phrases that aren't frequent are counted exactly, too, and none is lost. `bits` sets another width.
BITS = 26
#: Bits of a block of a bitmap, as it is sent to be put together.
BLOCK_BITS = 1 << 18
#: Keys of a join's small side that may be broadcast: languages.
MOST_LANGS = 10_000
SALTS = 64

_SPLIT, _WHITE = np.zeros(256, bool), np.zeros(256, bool)
_SPLIT[list(b".,;:!?\n\x0b\x0c\r")] = True
_WHITE[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Lower-cased words of a slice of texts, the text of each, and whether the next word belongs to the same piece."""
    low = _LOWER[data]
    cut = _SPLIT[low]
    gap = cut | _WHITE[low]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = ~gap[starts]
    at = np.flatnonzero(first)
    ids = np.cumsum(first) - 1  # of the word that a byte belongs to
    lengths = np.bincount(ids[~gap], minlength=len(at)) if len(at) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, at, side="right") - 1
    cuts = np.concatenate([[0], np.cumsum(cut)])[at]
    follows = np.zeros(len(at), bool)
    follows[:-1] = (text[1:] == text[:-1]) & (cuts[1:] == cuts[:-1])
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low[~gap])))
    return words, text, follows


def slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, list[str], np.ndarray]]:
    """Of slices of a batch with lang and text: word codes, the words by code, language codes by word, languages by code, follows."""
    langs = batch.column(0).dictionary_encode()
    names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in text_views(batch):
        words, text, follows = words_of(data, offsets)
        if len(words):
            coded = words.dictionary_encode()
            yield coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), codes[lo:hi][text], names, follows


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def hashes(codes: np.ndarray, words: list[str], langs: np.ndarray, names: list[str], follows: np.ndarray, most_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one word, two words and so on: where such a phrase begins, and its hash. A phrase's hash goes on from that of its first words."""
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[codes]
    start = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[langs]
    at, h = np.arange(len(codes)), _mix(start + own)
    yield at, h
    for k in range(1, most_words):
        more = follows[at + k - 1]
        at, h = at[more], h[more]
        h = _mix(h * _ODD[0] + own[at + k])
        yield at, h


def cells(h: np.ndarray) -> np.ndarray:
    """The sketch's cell for each hash."""
    return h >> np.uint64(64 - WIDE)


def places(cell: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bit for each cell in either bitmap."""
    g = _mix(cell + _ODD[0])
    return [(g & np.uint64((1 << bits) - 1)).astype(np.int64), (g >> np.uint64(64 - bits)).astype(np.int64)]


def packed(cell: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Cells in order and their counts, a row for each block: the bytes of gaps and counts plane by plane, so that they compress well."""
    block = (cell >> np.uint64(INNER)).astype(np.int32)
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    gap = np.diff(cell, prepend=cell[:1])
    gap[edges[:-1]] = cell[edges[:-1]] & np.uint64((1 << INNER) - 1)
    planes = np.concatenate([v.astype("<u4").view(np.uint8).reshape(-1, 4).T for v in (gap, times)])
    shrink = zstandard.ZstdCompressor(1).compress
    for lo in range(0, len(edges) - 1, 256):
        own = edges[lo : lo + 257]
        rows = [shrink(planes[:, a:b].tobytes()) for a, b in zip(own, own[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(block[own[:-1]]), pa.array(rows, pa.binary())], names=["block", "cells"])


def unpacked(block: int, raw: bytes) -> np.ndarray:
    """Cells and counts in 64 bits each."""
    gap, times = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(2, 4, -1).transpose(0, 2, 1).copy().view("<u4")[..., 0].astype(np.uint64)
    return np.cumsum(gap) + np.uint64(block << INNER) << np.uint64(64 - WIDE) | np.minimum(times, np.uint64(MOST))


def _sketched(most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            cell = np.concatenate(held)
            held.clear()
            cell.sort()
            new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            yield from packed(cell[new], np.diff(new, append=len(cell)))

        for batch in batches:
            for part in slices(batch):
                for _, h in hashes(*part, most_words):
                    held.append(cells(h))
                    n += len(h)
                if n > RUN:
                    yield from out()
                    n = 0
        if n:
            yield from out()

    return run


def _merged(bits: int, least: int):
    size, low = min(BLOCK_BITS, 1 << bits), np.uint64(MOST)

    def summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate(held)
        both.sort()
        cell = both >> np.uint64(64 - WIDE)
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        return cell[new], np.minimum(np.add.reduceat(both & low, new), low)

    def marked(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, total = summed(held)
        for r, at in enumerate(places(cell[total >= np.uint64(max(0, min(least, MOST)))], bits)):
            at = np.unique(at)
            edges = np.searchsorted(at, np.arange(0, (1 << bits) + 1, size))
            on = np.flatnonzero(np.diff(edges))
            rows = [(at[edges[b] : edges[b + 1]] - b * size).astype("<u4").tobytes() for b in on.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), r, np.int32)), pa.array(on.astype(np.int32)), pa.array(rows, pa.binary())], names=["row", "block", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most, last = [], 0, SUMMED, None
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if n > SUMMED and block != last:
                    yield from marked(held)
                    held, n, most = [], 0, SUMMED
                elif n > most:
                    cell, total = summed(held)
                    held, n = [cell << np.uint64(64 - WIDE) | total], len(cell)
                    most = max(SUMMED, 2 * n)
                held.append(unpacked(block, raw.as_py()))
                n, last = n + len(held[-1]), block
        if n:
            yield from marked(held)

    return run


def _put_together(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                on.setdefault((row, block), np.zeros(size, bool))[np.frombuffer(raw, "<u4")] = True
        for (row, block), x in on.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], names=["row", "block", "bits"])

    return run


def sketch(texts: DataFrame, bits: int, most_words: int, least: int) -> list[np.ndarray]:
    """texts: lang, text. The cells that reach `least`, marked in two packed bitmaps of 2^bits bits each."""
    size = min(BLOCK_BITS, 1 << bits)
    counts = texts.mapInArrow(_sketched(most_words), "block int, cells binary").repartition("block").sortWithinPartitions("block")
    blocks = counts.mapInArrow(_merged(bits, least), "row int, block int, at binary").repartition("row", "block").mapInArrow(_put_together(size), "row int, block int, bits binary")
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    for r in blocks.collect():
        out[r["row"]][r["block"] * size // 8 : (r["block"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _survivors(shared, bits: int, most_words: int):
    def reached(h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for row, at in zip(shared.value, places(cells(h), bits), strict=True):
            ok &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return ok

    def counted(part) -> Iterator[pa.RecordBatch]:
        codes, words, langs, names, _ = part
        ids, alive = langs.astype(np.int64) * len(words) + codes, None
        for k, (at, h) in enumerate(hashes(*part, most_words)):
            if alive is not None:  # both phrases of one word less are left
                within = alive[at] & alive[at + 1]
                at = at[within]
                at = at[reached(h[within])]
                ids = numbers[at] * len(words) + codes[at + k]  # a phrase is known by the number of its first words and its last one
            else:
                at = at[reached(h)]
                ids = ids[at]
            if not len(at):
                return
            _, place, inverse, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
            alive, numbers = np.zeros(len(codes) + 1, bool), np.zeros(len(codes), np.int64)
            alive[at], numbers[at] = True, inverse
            begin = at[place]
            phrases = [" ".join([words[c] for c in row]) for row in codes[begin[:, None] + np.arange(k + 1)].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in langs[begin].tolist()], pa.string()), pa.array(np.full(len(begin), k + 1, np.int32)), pa.array(phrases, pa.string()), pa.array(n.astype(np.int64))],
                names=["lang", "k", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch):
                for name, n in zip(part[3], np.bincount(part[2], minlength=len(part[3])).tolist(), strict=True):
                    total[name] = total.get(name, 0) + n
                yield from counted(part)
        some = [(k, v) for k, v in total.items() if v]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in some], pa.string()), pa.array(np.zeros(len(some), np.int32)), pa.array([""] * len(some), pa.string()), pa.array([v for _, v in some], pa.int64())],
            names=["lang", "k", "phrase", "n"])

    return run


def frequent(docs: DataFrame, most_words: int = 5, least: int = 100, bits: int = BITS) -> DataFrame:
    """docs: lang, text. lang, k, phrase, n: words and phrases of up to most_words words with at least `least` occurrences; k = 0: all words of lang."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(sketch(texts, bits, most_words, least))
    found = texts.mapInArrow(_survivors(shared, bits, most_words), "lang string, k int, phrase string, n long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("k") == 0))


def _part(words, first, n):
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, most_words: int = 5, least: int = 100, percent: int = 100, scale: int = 1000, top: int = 2000, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each lang."""
    counts = stash(frequent(docs, most_words, least, bits), "phrases")
    phrases = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a")).withColumn("w", F.split("phrase", " "))
    totals = counts.filter("k = 0").select("lang", F.col("n").alias("total"))
    # Within a longer phrase of (nearly) the same count.
    inner = phrases.select("lang", F.col("a").alias("f"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k")), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _part("w", i, m))))).alias("phrase"), "k")
    inner = inner.filter(F.size(F.split("phrase", " ")) < F.col("k")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = phrases.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
    cuts = left.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), _part("w", F.lit(1), i).alias("head"), _part("w", i + 1, F.col("k") - i).alias("tail")))).alias("c")).select("lang", "phrase", "a", "c.*")
    known = lambda name, n: counts.filter("k >= 1").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(known("head", "l"), ["lang", "head"]).join(known("tail", "r"), ["lang", "tail"])
    few = totals.count() <= MOST_LANGS
    cuts = cuts.join(F.broadcast(totals) if few else totals, "lang")
    score = F.expr(f"(cast(a * {scale} AS decimal(19,0)) * cast(total AS decimal(18,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(18,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
