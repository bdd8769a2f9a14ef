"""Removal of repeated passages with suffix arrays built by induced sorting.

Every string of `length` bytes is dealt by content: the least hash among its anchor-sized substrings (the leftmost of equals) is its
anchor, so equal strings, wherever they are, have the same anchor at the same place within them. Strings of one anchor that follow
each other are a run; a run's context is all bytes of its strings, and of the longer ones (`reach` bytes) that begin with them. An
anchor that occurs once can't repeat anything. Contexts that are equal (two 64-bit hashes, of the anchor and of the whole, and the
place of the one in the other) are counted, and need no more: all their strings repeat. One copy of each context goes to the shard of
its anchor, where a suffix array over the shard's contexts and the permuted common prefixes tell how far each string's longest match
goes: `length` bytes, or `reach`. Shards therefore never have to be compared with each other.

A shard holds SHARD_BYTES of contexts. An anchor with more is dealt anew by what stands around it: each string has half of what it has
more than the anchor on one side at least, and goes by these bytes; and so on, by halves, as long as any group is too large. At the end
the group's strings are equal as a whole.

Text is shuffled for documents with such contexts and for those that lose bytes; a fixed-size filter spares most others.

Defined results: null and empty texts have no bytes; texts shorter than `length` keep all; repeated rows repeat each other's bytes, and
lose theirs; rows are told apart by doc_id and text, so rows that share a doc_id, or have none, are documents of their own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash, text_views
from .components import pick
from .decontaminate import _BYTE, _ODD, _mix
from .induced import common_prefixes, suffix_array

LENGTH = 400
#: Passages that documents share are told from this length on, by strings of SHARED bytes within.
PASSAGE, SHARED = 300, 200
#: Bytes of an anchor, or a third of the length, where that is less.
ANCHOR = 96
#: Bytes of contexts of one group that one suffix array holds; a shard stops at as many, so two times as many at most: some 150 MB of arrays.
SHARD_BYTES = 1 << 19
KEYS = ("id", "mark")

_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_PLACE_BITS = np.uint64(31)
#: Tables of powers that a worker keeps, for texts of up to so many bytes: 16 MB. Longer texts make theirs anew.
_KEPT = 1 << 20
_TABLES: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    return [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]), dtype=np.uint64) for base in (_ODD, _INVERSE)]


def _powers(n: int) -> list[np.ndarray]:
    if n > _KEPT + 1:
        return _power_tables(n)
    if not _TABLES:
        _TABLES.extend(_power_tables(_KEPT + 1))
    return _TABLES


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte values times powers, and the inverse powers: any substring's hash is a difference times an inverse."""
    power, inverse = _powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)]), inverse


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values: by running minima from the ends of blocks of w."""
    n = len(v) - w + 1
    grid = np.concatenate([v, np.full(-len(v) % w, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _hashes(data: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor at each place; sums and inverse powers."""
    sums, inverse = _sums(data)
    n = len(data) - anchor + 1
    return _mix((sums[anchor:] - sums[:n]) * inverse[:n]), sums, inverse


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, reach: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each run: document, anchor hash, context hash, first and last string start (within the document), and bytes from the last
    start to the context's end."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 6
    value, sums, inverse = _hashes(data, anchor)
    key = (value >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(value), dtype=np.uint64)
    least = (_sliding_least(key, length - anchor + 1) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    own = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), own)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own) + offsets[doc]
    if not len(start):
        return (none,) * 6
    at = least[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    doc, at = doc[new], at[new]
    end = np.minimum(last + reach, offsets[doc + 1])
    form = (end - first).astype(np.uint64) << np.uint64(40) | (last - first).astype(np.uint64) << np.uint64(20) | (at - first).astype(np.uint64)
    context = _mix(((sums[end] - sums[first]) * inverse[first]) ^ _mix(form))
    return doc, value[at].view(np.int64), context.view(np.int64), first - offsets[doc], last - offsets[doc], end - last


def keyed(docs: DataFrame) -> DataFrame:
    """id, mark, text: what tells rows apart. Where two rows agree in id and mark, their doc_id and text are the same (32 bits of the text's hash stand
    beside the id)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(row_id(docs).alias("id"), row_mark(docs).alias("mark"), text.alias("text"))


def row_mark(docs: DataFrame) -> Column:
    return F.hash(F.coalesce(docs["text"].cast("string"), F.lit("")))


def row_id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))


RUNS = "id long, mark int, anchor long, context long, first int, last int, room int"


def runs(rows: DataFrame, length: int, reach: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_views(batch):
                doc, key, context, first, last, room = runs_of(data, offsets, length, reach, anchor)
                at = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(key), pa.array(context), *(pa.array(x.astype(np.int32)) for x in (first, last, room))],
                    names=[x.split()[0] for x in RUNS.split(", ")])

    return rows.mapInArrow(run, RUNS)


def matches_in(contexts: list[tuple[bytes, int, int]], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """contexts: bytes, and the first and last start of a string in them. Of each, for each length, the [from, to) byte intervals of
    its strings of that length that are found from another context's starts, too."""
    sizes = np.array([len(c) for c, _, _ in contexts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    s = np.zeros(begins[-1], np.uint16)  # 0 ends a context
    starts = np.zeros(len(s), bool)
    for (c, lo, hi), b in zip(contexts, begins):
        s[b : b + len(c)] = np.frombuffer(c, np.uint8).astype(np.uint16) + 1
        starts[b + lo : b + hi + 1] = True
    room = np.repeat(begins[1:] - 1, sizes + 1) - np.arange(len(s))
    sa = suffix_array(s, 257)
    shared = common_prefixes(s, sa)[sa]
    mine = np.flatnonzero(starts[sa])
    # what a start has in common with the start before it, among starts alone: the least of what lies between
    before = np.minimum.reduceat(shared[: mine[-1] + 1], np.concatenate([[0], mine[:-1] + 1]))
    before[0] = 0
    match = np.zeros(len(s), np.int64)
    match[sa[mine]] = np.maximum(before, np.append(before[1:], 0))
    match = np.minimum(match, room)
    out = []
    for b, n in zip(begins, sizes):
        own = []
        for length in lengths:
            at = np.flatnonzero(match[b : b + n] >= length)
            new = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1])) if len(at) else np.zeros(0, np.int64)
            own.append(np.stack([at[new], at[np.append(new[1:], len(at)) - 1] + length], 1) if len(at) else np.zeros((0, 2), np.int64))
        out.append(own)
    return out


FOUND = "anchor long, context long, level int, x array<int>, y array<int>"
CONTEXTS = "key long, anchor long, context long, base int, lo int, hi int, core int, core_end int, bytes binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(list(zip(*rows)) or [[]] * len(names), types)], names=list(names))


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """CONTEXTS, cut out of the documents named in `wanted`, whose rows carry the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for text, places in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                for w in places.as_py():
                    part = raw[w["first"] : w["last"] + w["room"]]
                    rows.append((w["anchor"], w["anchor"], w["context"], 0, 0, w["last"] - w["first"], None, None, part))
                    size += len(part)
                if size > 1 << 20:
                    yield _batch(rows, CONTEXTS)
                    rows, size = [], 0
            yield _batch(rows, CONTEXTS)

    by_doc = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct("anchor", "context", "first", "last", "room")).alias("places"))
    return texts.join(by_doc, list(KEYS)).select("text", "places").mapInArrow(run, CONTEXTS)


def deeper(row: tuple, lengths: tuple[int, ...], anchor_bytes: int) -> list[tuple]:
    """A context of a group that is too large, dealt by more bytes: its strings that have half of what is left before the core, and the
    others, which have as much after it; strings that are all core go by what follows them, as far as the longest length."""
    key, anchor, context, base, lo, hi, core, core_end, raw = row
    length, reach = lengths[0], lengths[-1]
    if core is None:
        value = _hashes(np.frombuffer(raw, np.uint8), anchor_bytes)[0]
        core = int(np.flatnonzero(value[: hi + length - anchor_bytes + 1].view(np.int64) == anchor)[0])
        core_end = core + anchor_bytes
    left = length - (core_end - core)
    if left > 0:
        half = (left + 1) // 2
        parts = [(b"<", lo, min(hi, core - half), core - half, core_end), (b">", max(lo, core - half + 1), hi, core, core_end + half)]
    else:
        more = core_end + (reach - (core_end - core) + 1) // 2
        parts = [(b"+", lo, hi, core, more)] if core + reach <= len(raw) else []
    out = []
    for side, a, b, c, d in parts:
        if a <= b:
            name = hashlib.blake2b(key.to_bytes(8, "little", signed=True) + side + raw[c:d], digest_size=8).digest()
            out.append((int.from_bytes(name, "little", signed=True), anchor, context, base + a, 0, b - a, c - a, d - a, raw[a : b + reach]))
    return out


def _by_suffix_arrays(contexts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        done: list[tuple] = []
        size, now = 0, None

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            found = matches_in([r[3:] for r in rows], lengths)
            return _batch([(r[0], r[1], level, (v[:, 0] + r[2]).tolist(), (v[:, 1] + r[2]).tolist()) for r, own in zip(rows, found) for level, v in enumerate(own) if len(v)], FOUND)

        for batch in batches:
            for key, raw, *rest in zip(*(batch.column(n).to_pylist() for n in ("key", "bytes", "anchor", "context", "base", "lo", "hi"))):
                if key != now:
                    done, group, now = done + group, [], key
                    if size > SHARD_BYTES:
                        yield solve(done)
                        done, size = [], 0
                group.append((*rest[:3], raw, *rest[3:]))
                size += len(raw)
        if done or group:
            yield solve(done + group)

    dealt = contexts.select("key", "anchor", "context", "base", "lo", "hi", "bytes").repartition("key").sortWithinPartitions("key", "anchor", "context", "base")
    return dealt.mapInArrow(run, FOUND)


def found_in(contexts: DataFrame, lengths: tuple[int, ...], anchor: int) -> DataFrame:
    """FOUND of contexts of any number and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield _batch([out for row in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)) for out in deeper(row, lengths, anchor)], CONTEXTS)

    length, reach = lengths[0], lengths[-1]
    out = []
    while True:
        large = contexts.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size"), F.count("*").alias("rows")).filter((F.col("size") > SHARD_BYTES) & (F.col("rows") > 1)).select("key")
        large = stash(large, "large-groups")
        if large.isEmpty():
            out.append(_by_suffix_arrays(contexts, lengths))
            break
        out.append(_by_suffix_arrays(contexts.join(large, "key", "left_anti"), lengths))
        over = stash(contexts.join(large, "key", "left_semi").select(contexts.columns), "large-contexts")
        core = F.col("core_end") - F.col("core")
        for level, n in enumerate(lengths):  # equal strings, as many as the group has rows
            out.append(over.filter(core == n).select("anchor", "context", F.lit(level).alias("level"), F.array("base").alias("x"), F.array((F.col("base") + n).cast("int")).alias("y")))
        contexts = stash(over.filter(core.isNull() | (core < reach)).mapInArrow(run, CONTEXTS), "parted-contexts")
    if len(out) == 1:
        return out[0]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionAll(df)
    # a context that was dealt in parts becomes one row again, of as many intervals as it has strings at most
    return whole.groupBy("anchor", "context", "level").agg(F.flatten(F.collect_list("x")).alias("x"), F.flatten(F.collect_list("y")).alias("y"))


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...], anchor: int) -> DataFrame:
    """id, mark, spans array<struct<first, level, x, y>>: the byte intervals (x and y count from first) of the documents that have any,
    of strings of each length; not merged, not sorted."""
    length, reach = lengths[0], lengths[-1]
    rows = keyed(docs)
    all_runs = stash(runs(rows, length, reach, anchor), "runs")
    shared = all_runs.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    shared = stash(shared, "shared-anchors")  # plain tables, so Spark can split a hot anchor's side of the joins
    some = stash(all_runs.join(shared, "anchor"), "shared-runs")
    drop_stash(all_runs, shared)
    place = F.struct("id", "mark", "first", "last", "room")
    contexts = stash(some.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("at")), "contexts")
    several = stash(contexts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor"), "several")
    wanted = stash(contexts.join(several, "anchor").select("anchor", "context", "at.*"), "wanted")
    texts = pick(rows, wanted.select(*KEYS).distinct(), KEYS).dropDuplicates(list(KEYS))
    strings = stash(_contexts(texts, wanted), "context-bytes")
    drop_stash(several, wanted)
    found = found_in(strings, lengths, anchor)
    once = contexts.filter("n = 1").select("anchor", "context")
    end = F.col("at.last") - F.col("at.first") + F.col("at.room")
    whole = contexts.filter("n > 1")
    spans = found.join(once, ["anchor", "context"], "left_semi")
    for level, n in enumerate(lengths):
        stop = F.least(end, F.col("at.last") - F.col("at.first") + n).cast("int")
        spans = spans.unionAll(whole.filter(end >= n).select("anchor", "context", F.lit(level).alias("level"), F.array(F.lit(0)).alias("x"), F.array(stop).alias("y")))
    known = stash(spans, "context-spans")
    drop_stash(spans)  # contexts, their bytes and what large groups were dealt to
    return some.join(known, ["anchor", "context"]).groupBy(*KEYS).agg(F.collect_list(F.struct("first", "level", "x", "y")).alias("spans"))


def merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals without overlaps or gaps of nothing between them, in order."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], np.maximum.accumulate(y[order]) if len(y) else y
    new = np.flatnonzero(np.concatenate([[True], x[1:] > y[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[new], y[np.append(new[1:], len(y)) - 1] if len(x) else y


LOSSES = "id long, mark int, n_removed long, n_spans long, n_repeated long, x array<int>, y array<int>"


def _losses(spans: DataFrame, top: int) -> DataFrame:
    """LOSSES: merged intervals of the level `top`, and the bytes of those of level 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, mark, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = row.values
                first, level = (own.field(k).to_numpy() for k in (0, 1))
                xs, ys = own.field(2), own.field(3)
                n = xs.value_lengths().to_numpy()
                first, level, x, y = np.repeat(first, n), np.repeat(level, n), xs.flatten().to_numpy(), ys.flatten().to_numpy()
                cut = merged((x + first)[level == top], (y + first)[level == top])
                all_ = merged((x + first)[level == 0], (y + first)[level == 0])
                rows.append((id_, mark, int((cut[1] - cut[0]).sum()), len(cut[0]), int((all_[1] - all_[0]).sum()), cut[0].tolist(), cut[1].tolist()))
            yield _batch(rows, LOSSES)

    return spans.select("id", "mark", "spans").mapInArrow(run, LOSSES)


def cut(raw: bytes, x: list[int], y: list[int]) -> bytes:
    at, parts = 0, []
    for a, b in zip(x, y):
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def losses(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), with_text: bool = False, anchor: int | None = None) -> DataFrame:
    """Of the documents with repeated strings of the first length: id, mark, n_repeated (bytes of these), n_removed and n_spans (of
    those of the last length), kept_sha256 (null where nothing is removed); with_text, also kept (without cut characters)."""
    spans = repeated_spans(docs, lengths, anchor or min(ANCHOR, lengths[0] // 3))
    lost = stash(_losses(spans, len(lengths) - 1), "losses")
    drop_stash(spans)
    less = lost.filter("n_removed > 0")
    texts = pick(keyed(docs), less.select(*KEYS), KEYS).dropDuplicates(list(KEYS))
    schema = "id long, mark int, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, sha, texts_ = batch.slice(at, 200), [], []
                for text, x, y in zip(*(part.column(k) for k in (2, 3, 4))):
                    kept = cut(text.as_py().encode(), x.as_py(), y.as_py())
                    sha.append(hashlib.sha256(kept).hexdigest())
                    texts_.append(kept.decode("utf-8", "ignore") if with_text else "")
                cols = [part.column(0), part.column(1), pa.array(sha, pa.string()), pa.array(texts_, pa.string())][: 3 + with_text]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "mark", "kept_sha256", "kept"][: 3 + with_text])

    kept = texts.join(less, list(KEYS)).select("id", "mark", "text", "x", "y").mapInArrow(run, schema)
    return lost.drop("x", "y").join(kept, list(KEYS), "left")


def shared_passages(docs: DataFrame, passage: int = PASSAGE, shared: int = SHARED) -> DataFrame:
    """id, mark, n_shared of the documents that share passages: how many of its content-defined strings of `shared` bytes stand in another
    document, too. Each `passage` bytes of a text hold one such string at least, at the same place in any document, so none is shared
    only where no passage of this length is. A document's own repetitions don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_views(batch):
                doc, key, *_ = runs_of(data, offsets, passage, passage, shared)
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                at = pa.array(lo + doc[new])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key[new])], names=["id", "mark", "string"])

    rows = stash(keyed(docs).mapInArrow(run, "id long, mark int, string long"), "strings")
    several = rows.groupBy("string").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("mark").alias("c"), F.max("mark").alias("d")).filter("a != b or c != d").select("string")
    return rows.join(stash(several, "shared-strings"), "string").groupBy(*KEYS).agg(F.count("*").alias("n_shared"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared (see shared_passages: told beside, and not removed) of all documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"), row_id(docs).alias("id"), row_mark(docs).alias("mark"))
    lost = losses(docs, (length,)).select(*KEYS, "n_removed", "n_spans", "kept_sha256")
    shared = shared_passages(docs)
    found = stash(lost.join(shared, list(KEYS), "full"), "results")
    drop_stash(shared)
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return base.join(found, list(KEYS), "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), zero("n_shared"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs, all columns, with repeated passages cut out of text; rows of which nothing is left go. A character of which a
    byte is cut goes as a whole. Null and empty texts stay as they are."""
    lost = stash(losses(docs, (length,), with_text=True).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "kept"), "kept")
    same = (row_id(docs) == F.col("_id")) & (row_mark(docs) == F.col("_mark"))
    whole = docs.join(lost.select("_id", "_mark"), same, "left_anti")
    texts = docs.join(lost.withColumnRenamed("kept", "_kept"), same).filter("_kept != ''")
    return whole.unionByName(texts.select(*(F.col("_kept").alias("text") if c == "text" else F.col(c) for c in docs.columns)))
