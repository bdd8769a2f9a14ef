"""Benchmark decontamination with suffix arrays of the training text.

Each executor builds the suffix array of a shard (a slice of documents) over word numbers and binary-searches every suffix of every
benchmark item in it by its first `window` words (an item of fewer words: by all of them). The interval found has all places where the
suffix begins. Suffixes that begin alike share an interval, and intervals of one length are disjoint, so hits and items are read off a list
no longer than `window` times the shard, however often a word is repeated on both sides. Longest matches come from one more suffix array
over the matched runs of both: a suffix' longest match is with its nearest neighbour of the other side. Words outside the
benchmark's vocabulary, and neighbours that are nowhere neighbours in it, end a match, so the array holds only suffixes that can match
at least two words.

The benchmark is read as blocks of at most BLOCK_BYTES of text (or one item), each broadcast on its own and read one after the other,
so a worker holds one; every shard is searched for every block, so the benchmark's size does not bound what is found. A block holds its
items as one row of word numbers; suffixes are places in it, so what is broadcast grows with the text alone. Documents are scanned once
and never shuffled.

Words: A-Z in lower case, then maximal runs of 0-9, a-z and characters beyond ASCII. Defined results: null and empty texts have no
words and no hits; null and empty items match nothing; items of equal text each count; items of equal id count once; an item without an
id counts as one and isn't listed; repeated rows give a row each; empty tables give no rows, or no hits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_views

WINDOW = 13
BLOCK_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_IS_WORD[65:91] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _ODD)]), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _ODD)]), dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and for each document the number of its first word (and one more at the end); byte starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    at = np.flatnonzero(inside)
    head = first[at]
    starts = at[head]
    heads = np.flatnonzero(head)
    lens = np.diff(np.append(heads, len(at)))
    rel = np.arange(len(at)) - np.repeat(heads, lens)
    value = _BYTE[_LOWER[data[at]]] * _powers(int(lens.max(initial=0)) + 1)[rel]
    sums = np.add.reduceat(value, heads) if len(heads) else np.zeros(0, np.uint64)
    return _mix(sums ^ lens.astype(np.uint64)), np.searchsorted(starts, offsets), starts


@dataclass
class Block:
    """Part of the benchmark: its words, neighbours, and the suffixes to search for."""

    vocabulary: np.ndarray  # sorted hashes; a word's number is its place from 1
    pairs: np.ndarray  # sorted codes of neighbours
    alone: np.ndarray  # numbers of words that are an item each
    flat: np.ndarray  # word numbers, item after item
    bounds: np.ndarray  # of the items in it
    starts: np.ndarray  # of the suffixes, in flat
    lengths: np.ndarray  # words that each is searched by
    names: list  # item ids by number


def build_block(items: list[tuple], window: int = WINDOW) -> Block:
    """items: (item id, text or None)."""
    raw = [(t or "").encode() for _, t in items]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    hashes, bounds, _ = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    flat = (number + 1).astype(np.int32)
    n = np.diff(bounds)
    inner = np.ones(max(len(flat) - 1, 0), bool)
    inner[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(flat))] - 1] = False
    pairs = np.unique((flat[:-1].astype(np.int64) * (len(vocabulary) + 1) + flat[1:])[inner])
    item, starts = _spread(bounds[:-1], bounds[:-1] + np.where(n, np.maximum(n - window + 1, 1), 0))
    lengths = np.minimum(n[item], window)
    return Block(vocabulary, pairs, np.unique(flat[starts[lengths == 1]]).astype(np.int64), flat, bounds, starts.astype(np.int32), lengths.astype(np.int32), [i for i, _ in items])


def _in(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Places with s > 0 in the order of the next `depth` numbers at least, by rank doubling."""
    places = np.flatnonzero(s)
    rank = np.concatenate([s, [0]]).astype(np.int64)
    k = 1
    while True:
        nxt = np.minimum(np.arange(len(s)) + k, len(s))
        key = rank[:-1] * (rank.max(initial=0) + 1) + rank[nxt]
        order = np.argsort(key, kind="stable")
        new = np.zeros(len(s) + 1, np.int64)
        ordered = key[order]
        steps = np.concatenate([[0], ordered[1:] != ordered[:-1]]).cumsum() if len(s) else np.zeros(0, np.int64)
        new[order] = steps + 1
        rank, k = new, 2 * k
        if k >= depth or (len(s) and steps[-1] == len(s) - 1):
            break
    return places[np.argsort(rank[places], kind="stable")]


class Shard:
    """A suffix array over word numbers, searched by binary search on groups of words packed into 64 bits."""

    def __init__(self, s: np.ndarray, depth: int, vocabulary: int):
        self.bits = 16 if vocabulary < 65_535 else 32
        self.per = 64 // self.bits
        self.levels = -(-max(depth, 1) // self.per)
        self.array = suffix_array(s, self.levels * self.per)
        self.s = np.concatenate([s, np.zeros(self.levels * self.per + self.per, np.int64)]).astype(np.uint64)
        self.keys: dict[int, np.ndarray] = {}

    def pack(self, level: int) -> np.ndarray:
        if level in self.keys:
            return self.keys[level]
        at = self.array + level * self.per
        out = np.zeros(len(at), np.uint64)
        for k in range(self.per):
            out = (out << np.uint64(self.bits)) | self.s[at + k]
        if level < 8:  # windows need no more; long matches would keep a key for every few words
            self.keys[level] = out
        return out

    def queries(self, flat: np.ndarray, starts: np.ndarray, level: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest key of this level that agree with the words of flat from these places, up to their lengths."""
        low = np.zeros(len(starts), np.uint64)
        high = np.zeros(len(starts), np.uint64)
        top = np.uint64((1 << self.bits) - 1)
        for k in range(level * self.per, level * self.per + self.per):
            on = k < lengths
            w = flat[np.minimum(starts + k, len(flat) - 1)].astype(np.uint64)
            low = (low << np.uint64(self.bits)) | np.where(on, w, np.uint64(0))
            high = (high << np.uint64(self.bits)) | np.where(on, w, top)
        return low, high

    @staticmethod
    def bound(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of each q within its own [lo, hi)."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                return lo
            mid = (lo[on] + hi[on]) >> 1
            go = key[mid] <= q[on] if right else key[mid] < q[on]
            lo[on] = np.where(go, mid + 1, lo[on])
            hi[on] = np.where(go, hi[on], mid)

    def find(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) in the array of the suffixes that begin with the `lengths` words of flat from each of these places."""
        starts, lengths = starts.astype(np.int64), lengths.astype(np.int64)
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.array), np.int64)
        for level in range(-(-int(lengths.max(initial=0)) // self.per)):
            on = np.flatnonzero((lo < hi) & (lengths > level * self.per))
            if not len(on):
                break
            low, high = self.queries(flat, starts[on], level, lengths[on])
            key = self.pack(level)
            a = self.bound(key, lo[on], hi[on], low, False)
            hi[on] = self.bound(key, a, hi[on], high, True)
            lo[on] = a
        return lo, hi


def candidates(hashes: np.ndarray, bounds: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The shard's words that can take part in a match, as numbers with 0 after each run; and their places among all words (-1 for 0)."""
    at, known = _in(block.vocabulary, hashes)
    number = np.where(known, at + 1, 0)
    link = np.zeros(len(number), bool)
    if len(number) > 1:
        _, pair = _in(block.pairs, number[:-1] * (len(block.vocabulary) + 1) + number[1:])
        link[:-1] = pair & (number[:-1] > 0) & (number[1:] > 0)
    last = bounds[1:] - 1
    link[last[(last >= 0) & (last < len(link))]] = False
    keep = link.copy()
    keep[1:] |= link[:-1]
    keep |= _in(block.alone, number)[1] & (number > 0)
    kept = np.flatnonzero(keep)
    ends = ~link[kept]
    to = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64) if len(kept) else np.zeros(0, np.int64)
    size = len(kept) + int(ends.sum())
    s, place = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    s[to], place[to] = number[kept], kept
    return s, place


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which interval, and which place: all places of all intervals."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


@dataclass
class Found:
    """What a shard and a block have in common, by suffix intervals: one entry a place of the shard and length searched by, never one a place
    of the shard and place of the block."""

    s: np.ndarray  # the shard's candidates, and their places among all its words
    place: np.ndarray
    at: np.ndarray  # places in s where a searched suffix begins, and the words it was searched by
    length: np.ndarray
    interval: np.ndarray  # number of the distinct interval, of each of these places
    suffix: np.ndarray  # the block's suffixes that were found, and their intervals
    of: np.ndarray
    sets: list  # distinct sets of items
    set_of: np.ndarray  # of each interval

    @property
    def word(self) -> np.ndarray:
        return self.place[self.at]


def find(hashes: np.ndarray, bounds: np.ndarray, block: Block) -> Found | None:
    """The suffixes of the block's items that begin anywhere in the shard, and where."""
    s, place = candidates(hashes, bounds, block)
    if not len(s) or not len(block.starts):
        return None
    shard = Shard(s, int(block.lengths.max()), len(block.vocabulary))
    lo, hi = shard.find(block.flat, block.starts, block.lengths)
    suffix = np.flatnonzero(lo < hi)
    if not len(suffix):
        return None
    # suffixes of equal words share an interval; intervals of one length are disjoint, so all of them are at most `window` times the shard
    distinct, of = np.unique(np.stack([lo[suffix], hi[suffix], block.lengths[suffix].astype(np.int64)], 1), axis=0, return_inverse=True)
    of = of.reshape(-1)
    item = np.searchsorted(block.bounds, block.starts[suffix], side="right") - 1
    pairs = np.unique(np.stack([of, item], 1), axis=0)
    cuts = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    known: dict[bytes, int] = {}
    items = np.ascontiguousarray(pairs[:, 1])
    set_of = np.array([known.setdefault(items[i:j].tobytes(), len(known)) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
    interval, where = _spread(distinct[:, 0], distinct[:, 1])
    return Found(s, place, shard.array[where], distinct[interval, 2], interval, suffix, of, [np.frombuffer(k, np.int64) for k in known], set_of)


def _covered(values: np.ndarray, starts: np.ndarray, window: int, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values within a window of the starts, run by run with 0 after each (runs end at breaks); their places, and how many of the run are left."""
    edge = np.zeros(len(values) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]))
    new = np.ones(len(kept), bool)
    new[1:] = (kept[1:] != kept[:-1] + 1) | np.isin(kept[1:], breaks)
    to = np.arange(len(kept)) + np.cumsum(new) - 1
    size = len(kept) + int(new.sum())
    seq, origin, left = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    heads = np.flatnonzero(new)
    lens = np.diff(np.append(heads, len(kept)))
    seq[to], origin[to] = values[kept], kept
    left[to] = np.repeat(heads + lens, lens) - np.arange(len(kept))
    return seq, origin, left


class Joint:
    """One suffix array over the matched runs of shard and block. The longest match of a suffix with the other side is the longer of its common
    prefixes with the nearest suffixes of that side, above and below it."""

    def __init__(self, found: Found, block: Block, window: int):
        text = np.sort(found.at[found.length == window])
        self.suffix = found.suffix[block.lengths[found.suffix] == window]
        starts = block.starts[self.suffix].astype(np.int64)
        seq_t, origin_t, left_t = _covered(found.s, text, window, np.zeros(0, np.int64))
        seq_i, origin_i, left_i = _covered(block.flat, starts, window, block.bounds)
        self.origin, self.left, self.split = np.concatenate([origin_t, origin_i]), np.concatenate([left_t, left_i]), len(seq_t)
        seq = np.concatenate([seq_t, seq_i])
        self.text = np.searchsorted(np.where(origin_t < 0, np.maximum.accumulate(origin_t), origin_t), text)
        self.test = len(seq_t) + np.searchsorted(np.where(origin_i < 0, np.maximum.accumulate(origin_i), origin_i), starts)
        depth = int(min(left_t.max(initial=0), left_i.max(initial=0))) + 1
        self.ranks = [np.append(seq, 0).astype(np.int32)]
        while 1 << (len(self.ranks) - 1) < depth:
            last, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            key = last[:-1].astype(np.int64) * (int(last.max()) + 1) + last[np.minimum(np.arange(len(seq)) + step, len(seq))]
            self.ranks.append(np.append(np.unique(key, return_inverse=True)[1].reshape(-1) + 1, 0).astype(np.int32))
        places = np.flatnonzero(seq)
        self.order = places[np.argsort(self.ranks[-1][places], kind="stable")]
        self.rank = np.zeros(len(seq), np.int64)
        self.rank[self.order] = np.arange(len(self.order))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at a and b, as far as their runs go."""
        n, end = np.zeros(len(a), np.int64), len(self.ranks[0]) - 1
        for level in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[level]
            n += (r[np.minimum(a + n, end)] == r[np.minimum(b + n, end)]).astype(np.int64) << level
        return np.minimum(n, np.minimum(self.left[a], self.left[b]))

    def longest(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Longest match of each suffix in `at` with the other side's (a mask over the order)."""
        n, k = len(self.order), np.arange(len(self.order))
        above = np.maximum.accumulate(np.where(other, k, -1))[self.rank[at]]
        below = np.minimum.accumulate(np.where(other, k, n)[::-1])[::-1][self.rank[at]]
        out = np.zeros(len(at), np.int64)
        for near in (above, below):
            on = np.flatnonzero((near >= 0) & (near < n))
            out[on] = np.maximum(out[on], self.common(at[on], self.order[near[on]]))
        return out

    def of_text(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard's candidates, and their longest matches."""
        return self.origin[self.text], self.longest(self.text, self.order >= self.split)

    def of_tests(self, priority: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of the block, their longest matches, and the least priority (of the shard's candidates) among the places that have them."""
        n = self.longest(self.test, self.order < self.split)
        own = self.rank[self.test]
        first, last = own.copy(), own.copy()
        low, high = np.zeros(len(own), np.int64), np.full(len(own), len(self.order) - 1)
        for _ in range(len(self.order).bit_length() + 1):  # the order's stretch that shares these words
            mid = (low + first) >> 1
            go = self.common(self.order[mid], self.test) >= n
            first, low = np.where(go, mid, first), np.where(go, low, np.minimum(mid + 1, first))
            mid = (high + last + 1) >> 1
            go = self.common(self.order[mid], self.test) >= n
            last, high = np.where(go, mid, last), np.where(go, high, np.maximum(mid - 1, last))
        size = last - first + 1
        least, best, step = np.full(len(self.order), np.iinfo(np.int64).max), np.zeros(len(own), np.int64), 1
        mine = self.order < self.split
        least[mine] = priority[self.origin[self.order[mine]]]
        while step <= int(size.max(initial=0)):  # minima of stretches of 1, 2, 4.. places; two of them cover each stretch
            on = (size >= step) & (size < 2 * step)
            best[on] = np.minimum(least[first[on]], least[last[on] - step + 1])
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least
            step *= 2
        return self.suffix, n, best


def _blocks(benchmark: DataFrame, window: int) -> list:
    """Broadcasts of at most BLOCK_BYTES of text (or one item), made one after the other."""
    out, items, size = [], [], 0
    sc = benchmark.sparkSession.sparkContext
    for item_id, text in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        n = len((text or "").encode())
        if items and size + n > BLOCK_BYTES:
            out.append(sc.broadcast(build_block(items, window)))
            items, size = [], 0
        items.append((item_id, text))
        size += n
    return [*out, sc.broadcast(build_block(items, window))] if items else out


def _each(blocks: list) -> Iterator[Block]:
    """The blocks; of several, a worker holds one at a time."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            del b._value  # read again from the executor's copy when it is next asked for


@dataclass
class Shards:
    """The slices of a batch, their words, and what of them is hit."""

    spans: list  # first row, row after the last
    hashes: list
    bounds: list
    hits: list

    @classmethod
    def of(cls, batch: pa.RecordBatch, column: str) -> "Shards":
        out = cls([], [], [], [])
        for lo, hi, data, offsets in text_views(batch, column):
            hashes, bounds, _ = words(data, offsets)
            out.spans.append((lo, hi))
            out.hashes.append(hashes)
            out.bounds.append(bounds)
            out.hits.append(np.zeros(len(hashes) + 1, np.int64))
        return out

    def search(self, blocks: list) -> Iterator[tuple[int, Block, Found]]:
        """Number of the slice, block and what was found of each; and the hits are noted."""
        for block in _each(blocks):
            for k, (hashes, bounds) in enumerate(zip(self.hashes, self.bounds)):
                f = find(hashes, bounds, block)
                if f is not None:
                    np.add.at(self.hits[k], f.word, 1)
                    np.add.at(self.hits[k], f.word + f.length, -1)
                    yield k, block, f

    def counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words, and hit words, of each document of a slice."""
        total = np.concatenate([[0], np.cumsum(np.cumsum(self.hits[k])[:-1] > 0)])
        bounds = self.bounds[k]
        return np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest verbatim match); with keep_text, also text."""
    blocks = _blocks(benchmark, window)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = Shards.of(batch, "text")
            names: list[dict[int, set]] = [{} for _ in shards.spans]
            longest = [np.zeros(hi - lo, np.int64) for lo, hi in shards.spans]
            for k, block, f in shards.search(blocks):
                doc_of = lambda word: np.searchsorted(shards.bounds[k], word, side="right") - 1  # noqa: E731, B023
                doc = doc_of(f.word)
                np.maximum.at(longest[k], doc, np.where(f.length < window, f.length, 0))
                if (f.length == window).any():
                    at, length = Joint(f, block, window).of_text()
                    np.maximum.at(longest[k], doc_of(f.place[at]), length)
                for d, items in np.unique(np.stack([doc, f.set_of[f.interval]], 1), axis=0).tolist():
                    names[k].setdefault(d, set()).update(block.names[i] for i in f.sets[items].tolist())
            for k, (lo, hi) in enumerate(shards.spans):
                n_words, n_hit = shards.counts(k)
                n_items, digest = np.zeros(hi - lo, np.int64), [none] * (hi - lo)
                for d, found in names[k].items():
                    n_items[d], digest[d] = len(found), hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items), pa.array(digest), pa.array((n_hit > 0) & (20 * n_hit >= n_words)), pa.array(longest[k])]
                more = [batch.column(1).slice(lo, hi - lo)] if keep_text else []
                yield pa.RecordBatch.from_arrays(cols + more, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "text"][: 7 + len(more)])

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long" + ", text string" * keep_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """item_id (as string), start, n_words, doc_id, word: of each test suffix its longest verbatim match of `least` words or more (or of
    its whole item, if that is shorter) over all documents, and the first place that has it (the smallest doc_id, then word)."""
    blocks, least_words = _blocks(benchmark, least), least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = Shards.of(batch, "text")
            for k, block, f in shards.search(blocks):
                first, doc = shards.spans[k][0], np.searchsorted(shards.bounds[k], f.place, side="right") - 1
                ids = batch.column(0).slice(first, len(shards.bounds[k]) - 1)
                by_id = np.lexsort((f.place, np.asarray(pc.rank(ids, null_placement="at_start", tiebreaker="first"))[doc]))
                priority = np.empty(len(f.s), np.int64)
                priority[by_id] = np.arange(len(f.s))
                # items shorter than the window are matched as a whole: the least place of their interval
                heads = np.searchsorted(f.interval, f.of)
                least = np.minimum.reduceat(priority[f.at], np.searchsorted(f.interval, np.arange(len(f.set_of))))
                suffix, length, best = f.suffix, f.length[heads], least[f.of]
                if (f.length == least_words).any():
                    short = length < least_words
                    parts = Joint(f, block, least_words).of_tests(priority)
                    suffix, length, best = (np.concatenate([a[short], b]) for a, b in zip((suffix, length, best), parts))
                at, start = by_id[best], block.starts[suffix].astype(np.int64)
                item = np.searchsorted(block.bounds, start, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if block.names[i] is None else str(block.names[i]) for i in item.tolist()], pa.string()), pa.array(start - block.bounds[item]), pa.array(length), ids.take(pa.array(doc[at])),
                    pa.array(f.place[at] - shards.bounds[k][doc[at]])], names=["item_id", "start", "n_words", "doc_id", "word"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id string, start long, n_words long, doc_id long, word long")
    best = found.groupBy("item_id", "start").agg(F.min_by(F.struct("n_words", "doc_id", "word"), F.struct(-F.col("n_words"), "doc_id", "word")).alias("m"))
    return best.select("item_id", "start", "m.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated: less than a twentieth of their words hit, or none. Each row is judged for
    itself; rows without words stay."""
    blocks = _blocks(benchmark, window)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = Shards.of(batch, batch.schema.names[at])
            for _ in shards.search(blocks):
                pass
            for k, (lo, hi) in enumerate(shards.spans):
                n_words, n_hit = shards.counts(k)
                yield batch.slice(lo, hi - lo).filter(pa.array((n_hit == 0) | (20 * n_hit < n_words)))

    return docs.mapInArrow(run, docs.schema)
