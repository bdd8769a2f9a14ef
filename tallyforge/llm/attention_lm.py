"""Language-model scoring: a small causal self-attention model, trained and run in numpy on subword ids.

The next subword comes from one distribution, a mixture that the attention weights make. Each place of the context has a query and a
key, looked up by its subword; a weight goes to every earlier place of the window and votes for the subword that followed there, and
one weight, of a gate that learns when to copy and when not, goes to the corpus' n-gram statistics: subwords, pairs and triples, each
smoothed by the shorter one. All weights of a place add up to one, so a text's probability is one over all texts.

Statistics: all subwords, pairs and triples of the training text are counted, and all counts are used. No task holds them: texts are read in
pieces, a piece's distinct triples are dealt by their first two subwords to parts, where all of a context meet, are summed and
answered; the answers are put beside the piece's subwords. The driver gets a few numbers for each subword of the vocabulary.

Training: every training document is tiled with windows, so each of its subwords and its end is predicted in just one of them, in one
of ROUNDS rounds in turn; a subword's own occurrence is taken out of the counts there. Each task streams the documents of its part of
the stored table and trains the shared weights; the tasks' weights are averaged in a tree of tasks (FAN_IN), so the driver gets a few
sets of a fixed size however many tasks there are, and more data means more tasks.

Scoring: overlapping windows of SPAN places, STRIDE of them scored, so each subword is scored once and has at least BACK subwords of
history but for its document's first ones. Attention is masked and batched. Texts of any length go through in pieces of PIECE subwords,
each with its history.

Word counts of the base score: the most frequent words (a fixed number) are looked up where the text is read; words that occur once in
all documents are told by a bitmap of the others of a fixed size; the rest goes through a join.

Defined results: null and empty texts have the end alone; without training documents counts are zero and all subwords are equally
likely; repeated rows give a row each and count each; a null doc_id counts as training text and keeps its rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod5, drop_stash, stash, text_views
from .components import FILTER_BITS, bitmap
from .decontaminate import words
from .encoder import encoder, word_table
from .minmax_dedup import _WORD

BACK, STRIDE = 8, 24
SPAN = BACK + STRIDE
#: Subwords with a query and a key of their own, the most frequent ones; the others share as many more. The last number is no subword.
OWN = 4_096
NOTHING = 2 * OWN
WIDTH = 16
#: A step follows PER_STEP batches; a task goes through few windows again until STEPS batches are done.
ROUNDS, BATCH, PER_STEP, RATE, STEPS = 2, 128, 3, 0.1, 300
#: Averages are taken of so many tasks' weights at a time.
FAN_IN = 16
#: Pairs and triples that are kept, at most; and slots of their tables.
PAIRS, PAIR_BITS, TRIPLES, TRIPLE_BITS = 1 << 19, 20, 1 << 20, 21
PIECE = STRIDE * 8_000
#: Training words to a part of the n-gram counts.
WORDS_PER_PART = 2_000_000
#: Words that are looked up without a join, the most frequent ones.
FREQUENT, FREQUENT_BITS = 1 << 17, 18
#: A context's n-grams weigh as its count, the shorter statistics as its kinds of followers times this: pairs, triples.
PAIR_SHARE, TRIPLE_SHARE = 1.0, 2.0


# --- statistics ----------------------------------------------------------------------------------------------------------

#: 2**64 over the golden ratio, as in multiplicative hashing.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Numbers by 64-bit key: a slot each by the key's hash; of keys that meet, the one with the largest number is in. A key of -1, which
    no code of subwords and one word hash in 2**64 has, isn't found."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int):
        keys, values = keys[keys != -1], values[keys != -1]
        order = np.lexsort((keys, -values))
        keys, values = keys[order], values[order]
        self.bits = bits
        slots = self.slots(keys)
        first = np.sort(np.unique(slots, return_index=True)[1])
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float64)
        self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and whether the key is in it."""
        slots = self.slots(keys)
        return slots, self.keys.take(slots) == keys


class Rows(Table):
    """A table's keys and numbers with more numbers by slot, side by side, so that a look-up reads one place of memory."""

    def __init__(self, table: Table, **more: np.ndarray):
        self.bits = table.bits
        columns = {"n": table.values} | more
        names = ["key", *columns]
        self.rows = np.zeros(1 << self.bits, np.dtype({"names": names, "formats": ["<i8"] + ["<f4"] * len(columns), "offsets": [0] + [8 + 4 * k for k in range(len(columns))], "itemsize": 16 if len(columns) < 3 else 32}))
        self.rows["key"] = table.keys
        for name, values in columns.items():
            self.rows[name] = values

    def __getstate__(self) -> tuple:
        """What a broadcast writes: the columns of slots with a key, and one without (these are all alike)."""
        held = self.keys != -1
        return self.bits, self.rows.dtype, {name: self.rows[name][held] for name in self.rows.dtype.names}, self.rows[~held][:1]

    def __setstate__(self, state: tuple):
        self.bits, kind, columns, blank = state
        self.rows = np.empty(1 << self.bits, kind)
        if len(blank):
            self.rows[:] = blank[0]
        slots = self.slots(columns["key"])
        for name, values in columns.items():
            self.rows[name][slots] = values

    @property
    def keys(self) -> np.ndarray:
        return self.rows["key"]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row in the slot of each key, and whether the key is in it."""
        rows = self.rows.take(self.slots(keys))
        return rows, rows["key"] == keys


class Ngrams:
    """Probability of a subword after the two before it. Ids lie below `size`; the end of a text is size - 1."""

    def __init__(self, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray]):
        self.size, self.counts = len(counts), counts.astype(np.float32)
        self.total = float(counts.sum())
        two = Table(*pairs, PAIR_BITS)
        held = two.keys >= 0
        before = two.keys[held] // self.size
        self.held2 = np.bincount(before, two.values[held], self.size).astype(np.float32)
        self.kinds2 = np.maximum(np.bincount(before, minlength=self.size), 1).astype(np.float32)
        slots, known = two.find(triples[0] // self.size)
        three = Table(triples[0][known], triples[1][known], TRIPLE_BITS)
        held = three.keys >= 0
        slots = two.find(three.keys[held] // self.size)[0]
        held3 = np.bincount(slots, three.values[held], 1 << PAIR_BITS)
        self.two = Rows(two, held=held3, kinds=np.maximum(np.bincount(slots, minlength=1 << PAIR_BITS), 1))
        self.three = Rows(three)

    def __call__(self, ids: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """ids: rows of subwords that follow each other. Of all but each row's first two the probability after the two before, and the
        logarithm of how often these were seen. less: 1 takes the subwords' own occurrences out of the counts."""
        less = np.float32(less)
        b, w = ids[:, 1:-1], ids[:, 2:]
        p = (np.maximum(self.counts.take(w) - less, 0) + np.float32(0.5)) / np.float32(max(self.total - less, 0) + 0.5 * self.size)
        pairs = ids[:, :-1] * self.size + ids[:, 1:]
        row, known = self.two.look_up(pairs)
        times = row["n"] * known
        held = self.held2.take(b)
        p = _smoothed(times[:, 1:], known[:, 1:] * less, np.maximum(self.counts.take(b), held), less, held, self.kinds2.take(b) * np.float32(PAIR_SHARE), p)
        seen, context = times[:, :-1], row[:, :-1]
        held = context["held"] * known[:, :-1]
        row, hit = self.three.look_up(pairs[:, :-1] * self.size + w)
        p = _smoothed(row["n"] * hit, hit * less, np.maximum(seen, held), less * known[:, :-1], held, context["kinds"] * np.float32(TRIPLE_SHARE), p)
        return p, np.log(np.maximum(seen - less, 0) + np.float32(1))


def contexts(ids: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' ids, one after the other, with an end after each: the two before (as a number), the one before, and the subword."""
    end, lens = size - 1, lens.astype(np.int64) + 1
    w = np.full(int(lens.sum()), end, np.int64)
    inside = np.ones(len(w), bool)
    inside[np.cumsum(lens) - 1] = False
    w[inside] = ids
    b = np.concatenate([[end], w[:-1]])
    a = np.concatenate([[end], b[:-1]])
    first = np.cumsum(lens) - lens
    a[first + (lens > 1)] = a[first] = end
    return a * size + b, b, w


class Shares:
    """As Ngrams over all n-grams: what is known of each subword is here, what is known of triples and their contexts comes with the text."""

    def __init__(self, counts: np.ndarray, last: np.ndarray, kinds: np.ndarray):
        """By subword: how often it is there, how often it ends a text, and how many kinds of subwords follow it."""
        self.size, self.total = len(counts), float(counts.sum())
        self.counts, self.last, self.kinds = counts.astype(np.float32), last.astype(np.float32), np.maximum(kinds, 1).astype(np.float32)

    def __call__(self, ids: np.ndarray, lens: np.ndarray, values: np.ndarray, less: int) -> tuple[np.ndarray, np.ndarray]:
        """values: of each subword of the texts and of their ends how often its triple is there, how often its context, and how many kinds
        follow that. less: 1 takes the subwords' own occurrences out of the counts."""
        _, b, w = contexts(ids, lens, self.size)
        triple, context, kinds = values.astype(np.float32)
        less, end = np.float32(less), self.size - 1
        p = (np.maximum(self.counts.take(w) - less, 0) + np.float32(0.5)) / np.float32(max(self.total - less, 0) + 0.5 * self.size)
        pair = np.where(w == end, self.last.take(b), np.append(context[1:], np.float32(0)))  # a pair is the next subword's context
        more = self.kinds.take(b) * np.float32(PAIR_SHARE)
        p = (np.maximum(pair - less, 0) + more * p) / (np.maximum(self.counts.take(b) - less, 0) + more)
        more, seen = np.maximum(kinds, 1) * np.float32(TRIPLE_SHARE), np.maximum(context - less, 0)
        return (np.maximum(triple - less, 0) + more * p) / (seen + more), np.log(seen + np.float32(1))


def _smoothed(n, less_n, seen, less_seen, held, kinds, p):
    """Of a context seen so often, with followers held of so many occurrences: the share of one with n of them, p being what the shorter
    context says. What isn't held, and `kinds` more, go to the shorter context."""
    seen = np.maximum(seen - less_seen, held - less_n)
    return (n - less_n + (seen - (held - less_n) + kinds) * p) / (seen + kinds)


# --- the model -----------------------------------------------------------------------------------------------------------

#: Queries, keys and gates by number as read, weights of distances, and how a gate follows the context's count.
SHAPES = {"q": (NOTHING + 1, WIDTH), "k": (NOTHING + 1, WIDTH), "gate": (NOTHING + 1,), "near": (SPAN - 1,), "seen": (1,)}
_AHEAD = np.arange(BACK, SPAN)[:, None] - np.arange(SPAN)
_DISTANCE = np.clip(_AHEAD - 1, 0, SPAN - 2)
_CAUSAL = np.where(_AHEAD >= 1, 0, -1e4).astype(np.float32)
_BEFORE = _AHEAD >= 1
_ONES = np.ones(SPAN, np.float32)
_PLACES = np.arange((NOTHING + 1) * WIDTH // 2).reshape(NOTHING + 1, -1)
#: Bounds of weights; so no exponential overflows, and none needs its row's maximum.
_MOST = 1.4
BOUNDS = {"q": (-_MOST, _MOST), "k": (-_MOST, _MOST), "near": (-12, 4), "gate": (-8, 8), "seen": (-1, 1)}


def first_weights(seed: int = 7) -> dict[str, np.ndarray]:
    """Queries and keys of a subword begin equal: places that read the same attend to each other."""
    q = np.random.default_rng(seed).standard_normal(SHAPES["q"]).astype(np.float32) * np.float32(0.6)
    return {"q": np.clip(q, -_MOST, _MOST), "k": np.clip(q, -_MOST, _MOST), "gate": np.full(SHAPES["gate"], 2, np.float32), "near": np.full(SHAPES["near"], -4, np.float32), "seen": np.full(1, 0.2, np.float32)}


def to_flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in SHAPES])


def from_flat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, s in SHAPES.items():
        out[n] = v[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


@dataclass
class Windows:
    """Windows x SPAN places: numbers as read, and ids that follow (-1 outside of the text); for the last STRIDE of them the n-grams' share."""

    read: np.ndarray
    follows: np.ndarray
    gram: np.ndarray
    seen: np.ndarray
    text: np.ndarray  # of each window

    def take(self, at) -> "Windows":
        return Windows(self.read[at], self.follows[at], self.gram[at], self.seen[at], self.text[at])

    def __len__(self) -> int:
        return len(self.read)


def joined(parts: list[Windows]) -> Windows:
    return Windows(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("read", "follows", "gram", "seen", "text")))


def windows(texts: list[np.ndarray], grams: "Ngrams | Shares", reads: np.ndarray, less: int, turn: int = 0, turns: int = 1, shares: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[Windows]:
    """Windows of the texts, about PIECE subwords at a time; of turns' ones only this turn's. shares: of each text what grams would say."""
    end, lead = grams.size - 1, BACK + 2
    parts, owner, size, said = [], [], 0, []
    for k, ids in enumerate(texts):
        n = len(ids) + 1
        whole = np.full(lead + n + -n % STRIDE, -1, np.int32)
        whole[lead : lead + n - 1] = ids
        whole[lead + n - 1] = end
        if shares is not None:
            beside = np.zeros((2, len(whole)), np.float32)
            beside[0] = 1
            beside[:, lead : lead + n] = shares[k]
        for x in range(0, n, PIECE):
            parts.append(whole[x : x + lead + PIECE])
            if shares is not None:
                said.append(beside[:, x : x + lead + PIECE])
            owner.append(k)
            size += lead + min(PIECE, n - x)
            if size >= PIECE:
                yield _windows(parts, owner, grams, reads, less, turn, turns, said)
                parts, owner, size, said = [], [], 0, []
    if parts:
        yield _windows(parts, owner, grams, reads, less, turn, turns, said)


def _windows(parts: list[np.ndarray], owner: list[int], grams: "Ngrams | Shares", reads: np.ndarray, less: int, turn: int, turns: int, said: list[np.ndarray]) -> Windows:
    end = grams.size - 1
    sizes = np.array([len(p) for p in parts])
    n = (sizes - BACK - 2) // STRIDE
    flat = np.concatenate(parts).astype(np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes + 2, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    text = np.repeat(np.array(owner), n)
    first, text = first[turn::turns], text[turn::turns]
    at = first[:, None] + np.arange(SPAN)
    follows = flat.take(at)
    here = flat.take(at - 1)
    here[here < 0] = end
    if said:
        gram, seen = (v.take(at[:, BACK:]) for v in np.concatenate(said, 1))
    else:
        before = flat.take(at[:, BACK : BACK + 1] - 2)
        before[before < 0] = end
        gram, seen = grams(np.concatenate([before, here[:, BACK:], np.maximum(follows[:, -1:], 0)], 1), less)
    read = reads.take(here)
    read[follows < 0] = NOTHING
    return Windows(read, follows.astype(np.int32), gram, seen, text)


def _few(on: np.ndarray) -> np.ndarray:
    """Where it is true, in order; eight places are skipped at a time where none of them is."""
    eight = np.flatnonzero(on.view(np.uint64))
    at = np.flatnonzero(on.reshape(-1, 8).take(eight, 0))
    return (eight.take(at >> 3) << 3) + (at & 7)


def attend(w: dict, x: Windows) -> tuple[np.ndarray, ...]:
    """Unnormalised weights of the places before and of the n-grams, their sum, and the part of it that votes for what follows. The votes,
    which are few, also singly: their places in the weights, the places they are asked at, and their weights."""
    q, k = w["q"].take(x.read[:, BACK:], 0), w["k"].take(x.read, 0)
    a = q @ k.transpose(0, 2, 1)
    a += w["near"][_DISTANCE] + _CAUSAL
    outside = x.read == NOTHING
    some = np.flatnonzero(outside.any(1))
    a[some] += np.where(outside[some], np.float32(-1e4), np.float32(0))[:, None]
    np.exp(a, out=a)
    gram = np.exp(w["gate"].take(x.read[:, BACK:]) + w["seen"] * x.seen)
    vote = x.follows[:, None, :] == x.follows[:, BACK:, None]
    vote &= _BEFORE
    at = _few(vote.ravel())
    asked, weight = at // SPAN, a.ravel().take(at)
    voted = np.bincount(asked, weight, gram.size).astype(a.dtype).reshape(gram.shape)
    return q, k, a, gram, a @ _ONES + gram, voted, (at, asked, weight)


def log_probabilities(w: dict, x: Windows) -> np.ndarray:
    """Of what follows at the last STRIDE places of each window; 0 outside of the text."""
    *_, gram, total, voted, _ = attend(w, x)
    return np.where(x.follows[:, BACK:] >= 0, np.log((voted + gram * x.gram) / total), 0)


def _add_rows(to: np.ndarray, rows: np.ndarray, values: np.ndarray):
    """Add values to rows of to, which may repeat. Two numbers at a time, as one complex number."""
    kind = np.dtype(f"c{2 * to.itemsize}")
    np.add.at(to.ravel().view(kind), _PLACES.take(rows.ravel(), 0).ravel(), np.ascontiguousarray(values, to.dtype).ravel().view(kind))


def gradient(w: dict, x: Windows, to: dict) -> tuple[np.ndarray, np.ndarray]:
    """Adds the gradient of the mean negative log probability to what is in `to`. Part and sum of weights at each place."""
    q, k, d, gram, total, voted, (at, asked, weight) = attend(w, x)
    on = x.follows[:, BACK:] >= 0
    n = max(int(on.sum()), 1)
    right = voted + gram * x.gram
    by_total, by_right = (np.where(on, 1 / (v * n), 0).astype(d.dtype) for v in (total, right))
    d *= by_total[..., None]
    d.ravel()[at] -= by_right.ravel().take(asked) * weight
    d_gate = gram * (by_total - by_right * x.gram)
    asks = x.read[:, BACK:]
    _add_rows(to["q"], asks, d @ k)
    _add_rows(to["k"], x.read, d.transpose(0, 2, 1) @ q)
    to["near"] += np.bincount(_DISTANCE.ravel(), d.reshape(len(x), -1).sum(0), SPAN - 1).astype(np.float32)
    to["gate"] += np.bincount(asks.ravel(), d_gate.ravel(), NOTHING + 1).astype(np.float32)
    to["seen"] += (d_gate * x.seen).sum()
    return right, total


def loss_and_gradient(w: dict, x: Windows, to: dict | None = None) -> tuple[float, dict]:
    """Mean negative log probability, and its gradient, added to what is in `to`."""
    to = to or {n: np.zeros(s, np.float32) for n, s in SHAPES.items()}
    right, total = gradient(w, x, to)
    on = x.follows[:, BACK:] >= 0
    return -float(np.log(right[on] / total[on]).sum()) / max(int(on.sum()), 1), to


def _enough(parts: Iterable[Windows], seed: int) -> Iterator[Windows]:
    """The windows in batches, each once; windows that are too few for STEPS batches are gone through again in whole passes. No more
    than these are held."""
    rng = np.random.default_rng(seed)

    def dealt(x: Windows) -> Iterator[Windows]:
        x = x.take(rng.permutation(len(x)))
        for at in range(0, len(x), BATCH):
            yield x.take(slice(at, at + BATCH))

    held, n, parts = [], 0, iter(parts)
    for part in parts:
        held.append(part)
        n += len(part)
        if n > STEPS * BATCH:
            break
    if not n:
        return
    first = joined(held)
    del held
    for _ in range(max(1, -(-STEPS * BATCH // n))):
        yield from dealt(first)
    del first
    for part in parts:
        yield from dealt(part)


def learn(w: dict, parts: Iterable[Windows], seed: int) -> tuple[dict, int]:
    """Weights after steps with rates that follow from the gradients so far (Adagrad); and the number of windows seen."""
    seen = 0

    def counted() -> Iterator[Windows]:
        nonlocal seen
        for part in parts:
            seen += len(part)
            yield part

    w = {n: v.copy() for n, v in w.items()}
    squares = {n: np.full_like(v, 1e-9) for n, v in w.items()}
    total = {n: np.zeros_like(v) for n, v in w.items()}

    spare = {n: np.empty_like(v) for n, v in w.items()}

    def step() -> None:
        for n, g in total.items():
            root = np.multiply(g, g, out=spare[n])
            squares[n] += root
            np.sqrt(squares[n], out=root)
            g *= np.float32(RATE)
            g /= root
            w[n] -= g
            np.clip(w[n], *BOUNDS[n], out=w[n])
            g[:] = 0

    met = 0
    for met, x in enumerate(_enough(counted(), seed), 1):
        gradient(w, x, total)
        if met % PER_STEP == 0:
            step()
    if met % PER_STEP:
        step()
    return w, seen


@dataclass
class Model:
    weights: dict
    grams: "Ngrams | Shares"
    reads: np.ndarray

    def scores(self, texts: list[np.ndarray], shares: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Natural log probability of each text's ids and its end. shares: of each text what grams would say."""
        out = np.zeros(len(texts))
        for x in windows(texts, self.grams, self.reads, 0, shares=shares):
            for at in range(0, len(x), BATCH):
                part = x.take(slice(at, at + BATCH))
                out += np.bincount(part.text, log_probabilities(self.weights, part).sum(1, dtype=np.float64), len(texts))
        return out


def reads_of(counts: np.ndarray) -> np.ndarray:
    """Numbers as read: by frequency the first OWN ids have their own, the others share the next OWN in turn."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return np.where(rank < OWN, rank, OWN + rank % OWN).astype(np.int16)


# --- Spark ---------------------------------------------------------------------------------------------------------------

def _held_out() -> "F.Column":
    return F.coalesce(crc32_mod5(F.col("doc_id")) == 1, F.lit(False))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", _held_out())


class Tally:
    """Sums of numbers by code. Held are about `most` codes; when more are different, they are given away."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.codes, self.numbers, self.n = most, [], [], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes in order, and their sums (a row each)."""
        code, numbers = np.concatenate(self.codes), np.concatenate(self.numbers)
        order = np.argsort(code, kind="stable")
        code = code[order]
        new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        self.codes, self.numbers, self.n = [], [], 0
        return code[new], np.add.reduceat(numbers[order], new, axis=0)

    def add(self, code: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.codes.append(code)
        self.numbers.append(numbers)
        self.n += len(code)
        if self.n > self.most:
            code, numbers = self.merged()
            if len(code) > self.most // 2:
                yield code, numbers
            else:
                self.codes, self.numbers, self.n = [code], [numbers], len(code)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.n:
            yield self.merged()


def word_counts(docs: DataFrame) -> DataFrame:
    """h (a word's hash), total, train: occurrences in all documents and in training ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def out(made: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for code, n in made:
                for at in range(0, len(code), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(code[at : at + 100_000]), pa.array(n[at : at + 100_000, 0]), pa.array(n[at : at + 100_000, 1])], names=["h", "total", "train"])

        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_views(batch):
                hashes, bounds, _ = words(data, offsets, _WORD)
                seen, which, total = np.unique(hashes, return_inverse=True, return_counts=True)
                train = np.bincount(which[np.repeat(~held[lo:hi], np.diff(bounds))], minlength=len(seen))
                yield from out(tally.add(seen.view(np.int64), np.stack([total, train], 1)))
        yield from out(tally.rest())

    return _rows(docs).mapInArrow(run, "h long, total long, train long").groupBy("h").agg(F.sum("total").alias("total"), F.sum("train").alias("train"))


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest n, at most so many: a histogram of few rows gives the bound, ties of which are all left out or all in.
    Nothing is sorted."""
    level = F.floor(F.log2(F.col(n)) * _LEVELS)
    bound, held = None, 0
    for r in sorted(counts.filter(F.col(n) > 0).groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if held + r["count"] > most:
            break
        bound, held = r["level"], held + r["count"]
    return counts.filter(F.lit(False)) if bound is None else counts.filter((F.col(n) > 0) & (level >= bound))


#: A row for each piece: documents of about PIECE_IDS subwords, or one. lens: subwords of its documents; at, h, times: words that a join looks up, each with its document's place.
DOCS = "piece long, doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, known array<bigint>, logs array<double>, lens array<int>, ids binary"
READ_ROWS = DOCS + ", at array<int>, h array<bigint>, times array<int>"
PIECE_IDS = 1 << 22
#: Bytes of rows that Spark hands to a Python worker at a time: pieces are some 10 MB.
BATCH_BYTES = 8 << 20


def _listed(values) -> pa.Array:
    """All of them as the list of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _read(docs: DataFrame, shared, tokenizer_path: str, kind: str) -> DataFrame:
    """One pass over the text: words, what most of them add to the base score, the other ones with their counts, and subword ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoder(tokenizer_path), word_table(tokenizer_path, kind)
        frequent, several = shared.value
        logs, known = np.log10(frequent.values + 0.5), frequent.values > 0
        parts, n, docs, piece = [], 0, 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            *lists, ids = zip(*parts)
            return pa.RecordBatch.from_arrays([pa.array([piece]), *(_listed(pa.concat_arrays(map(pa.array, x))) for x in lists[:6]), pa.array([packed_ids(np.concatenate(ids), kind)], pa.binary()), *(_listed(np.concatenate(x)) for x in lists[6:])], names=[x.split()[0] for x in READ_ROWS.split(", ")])

        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_views(batch):
                hashes, bounds, starts = words(data, offsets, _WORD)
                n_words = np.diff(bounds)
                doc = np.repeat(np.arange(hi - lo), n_words)
                at, hit = frequent.find(hashes.view(np.int64))
                bit = (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                once = ~hit & ((several[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) == 0)  # here, and nowhere else
                own = ~held[lo:hi][doc[once]]
                value = (np.bincount(doc[hit], logs[at[hit]], hi - lo) + np.bincount(doc[once], np.log10(own + 0.5), hi - lo)).astype(np.float64)
                seen = np.bincount(doc[hit], known[at[hit]], hi - lo).astype(np.int64) + np.bincount(doc[once], own, hi - lo).astype(np.int64)
                rest = ~hit & ~once
                rare_doc, rare = doc[rest], hashes[rest]
                order = np.lexsort((rare, rare_doc))
                rare_doc, rare = rare_doc[order], rare[order]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1])])) if len(rare) else np.zeros(0, np.int64)
                ids = table.ids(data, offsets, hashes, bounds, starts) if table else [enc.ids(t.as_py() or "").astype(kind) for t in batch.column(1).slice(lo, hi - lo)]
                parts.append((
                    batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), (n_words + 1).astype(np.int64), seen, value, np.array([len(v) for v in ids], np.int32),
                    (docs + rare_doc[new]).astype(np.int32), rare[new].view(np.int64), np.diff(np.append(new, len(rare))).astype(np.int32), np.concatenate(ids)))
                n, docs = n + sum(map(len, ids)), docs + hi - lo
                if n > PIECE_IDS:
                    yield out()
                    parts, n, docs, piece = [], 0, 0, piece + 1
        if parts:
            yield out()

    return _rows(docs).mapInArrow(run, READ_ROWS)


def _ids(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer(), kind) for x in column)


PACKED = "part int, n_ids int, codes binary, times binary"
_LEVELS = 16  # of a count, for each doubling


def most_of(n: np.ndarray, most: int) -> np.ndarray:
    """Which counts are among the largest, at most so many: whole levels of counts, so equal ones are all in or all out."""
    level = np.floor(np.log2(n) * _LEVELS).astype(np.int64)
    seen, times = np.unique(level, return_counts=True)
    fits = np.cumsum(times[::-1])[::-1] <= most
    return level >= seen[fits][0] if fits.any() else np.zeros(len(n), bool)


def to_planes(v: np.ndarray) -> bytes:
    """Sorted int64 numbers, byte by byte: the high bytes of all of them first, so that they compress well."""
    return v.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def ngram_counts(rows: DataFrame, size: int, kind: str, parts: int, piece: int = 1 << 20) -> DataFrame:
    """PACKED: n_ids (1, 2 or 3), codes and times (as planes) of ids, pairs and triples in the training texts with their ends; all of a code
    in one row, and none left out. For tables of a stated size (most_frequent_packed); the query's model takes all counts (placed). Tasks sum up what they read; then codes are dealt to `parts` parts by their hash, as arrays, so that Spark moves few rows."""
    def coded(texts: list[np.ndarray]) -> list[np.ndarray]:
        before, b, w = contexts(np.concatenate(texts), np.array([len(t) for t in texts]), size)
        return [w, b * size + w, before * size + w]

    def dealt(n_ids: int, made: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for code, n in made:
            part = ((code.view(np.uint64) * _SPREAD >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            code, n = code[order], n[order]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            on = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays(
                [pa.array(on.astype(np.int32)), pa.array(np.full(len(on), n_ids, np.int32)), *(pa.array([to_planes(v[a:b]) for a, b in zip(edges[on], edges[on + 1])], pa.binary()) for v in (code, n))],
                names=["part", "n_ids", "codes", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Tally(3 << 20) for _ in range(3)]
        texts: list[np.ndarray] = []
        held = 0

        def add() -> Iterator[pa.RecordBatch]:
            for k, code in enumerate(coded(texts)):
                yield from dealt(k + 1, tallies[k].add(*np.unique(code, return_counts=True)))

        for batch in batches:
            for ids in _ids(batch.column(0), kind):
                texts.append(ids)
                held += len(ids) + 1
                if held > piece:
                    yield from add()
                    texts, held = [], 0
        if texts:
            yield from add()
        for k, tally in enumerate(tallies):
            yield from dealt(k + 1, tally.rest())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[tuple[int, int], Tally] = {}
        for batch in batches:
            for part, n_ids, *both in zip(*(c.to_pylist() for c in batch.columns)):
                tally = whole.setdefault((part, n_ids), Tally())
                for code, n in tally.add(*map(from_planes, both)):  # merged, and held on to
                    tally.codes, tally.numbers, tally.n, tally.most = [code], [n], len(code), 4 * len(code)
        for (part, n_ids), tally in sorted(whole.items()):
            for code, n in tally.rest():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_ids], pa.int32()), pa.array([to_planes(code)]), pa.array([to_planes(n)])], names=["part", "n_ids", "codes", "times"])

    return rows.filter("not held_out").select("ids").mapInArrow(count, PACKED).repartitionById(parts, F.col("part")).mapInArrow(merge, PACKED)


def most_frequent_packed(counts: DataFrame, n_ids: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the most frequent ones, at most so many; as most_frequent."""
    counts = counts.filter(F.col("n_ids") == n_ids).select("codes", "times")
    level = lambda n: np.floor(np.log2(n) * _LEVELS).astype(np.int64)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for times in batch.column(1):
                seen, n = np.unique(level(from_planes(times.as_buffer())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], names=["level", "n"])

    bound, held = None, 0
    for r in sorted(counts.mapInArrow(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["level"]):
        if held + r["n"] > most:
            break
        bound, held = r["level"], held + r["n"]
    if bound is None:
        return np.zeros(0, np.int64), np.zeros(0)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, times in zip(*batch.columns):
                n = from_planes(times.as_buffer())
                on = level(n) >= bound
                yield pa.RecordBatch.from_arrays([pa.array(from_planes(codes.as_buffer())[on]), pa.array(n[on])], names=["code", "n"])

    got = counts.mapInArrow(chosen, "code long, n long").toArrow()
    return got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy().astype(np.float64)


def packed_ids(ids: np.ndarray, kind: str) -> bytes:
    """Byte by byte and compressed."""
    return zstandard.compress(ids.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes(), 1)


def _texts(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """The ids of each piece."""
    return (np.ascontiguousarray(np.frombuffer(zstandard.decompress(x.as_buffer()), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() for x in column)


def _planes(*numbers: np.ndarray) -> np.ndarray:
    """32-bit numbers byte by byte, a row for each byte."""
    return np.concatenate([v.astype("<u4").view(np.uint8).reshape(-1, 4).T for v in numbers])


def _numbers(planes: np.ndarray) -> np.ndarray:
    """A row of 32-bit numbers for each four planes."""
    return np.ascontiguousarray(planes.reshape(-1, 4, planes.shape[-1]).transpose(0, 2, 1)).view("<u4")[..., 0]


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and which of them each is."""
    bits = int(len(x)).bit_length()
    if not len(x) or int(x.max()) >> (63 - bits):
        return np.unique(x, return_inverse=True)
    both = x << bits | np.arange(len(x))  # one sort of plain numbers
    both.sort()
    at, x = both & (1 << bits) - 1, both >> bits
    new = np.concatenate([[True], x[1:] != x[:-1]])
    which = np.empty(len(x), np.int64)
    which[at] = np.cumsum(new) - 1
    return x[new], which


#: Cells of a table of all pairs of a piece's subwords, at most; with more different subwords, contexts are sorted.
PAIR_CELLS = 1 << 23


def _numbered_contexts(before: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As _numbered. before: the two before each subword, b: the one."""
    there = np.bincount(b, minlength=size) > 0
    there[size - 1] = True
    own = np.flatnonzero(there)
    if len(own) ** 2 > PAIR_CELLS:
        return _numbered(before)
    local = (np.cumsum(there) - 1).astype(np.int32)
    at = local.take((before - b) // size) * np.int32(len(own)) + local.take(b)
    hit = np.zeros(len(own) ** 2, bool)
    hit[at] = True
    found = np.flatnonzero(hit)
    number = np.empty(len(hit), np.int32)
    number[found] = np.arange(len(found))
    return own[found // len(own)] * size + own[found % len(own)], number.take(at)


class Deal:
    """A piece's distinct triples in the order in which they are dealt to parts: by part, context and subword. Also its contexts."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, size: int, parts: int):
        before, b, w = contexts(ids, lens, size)
        context, which = _numbered_contexts(before, b, size)
        part = ((context.view(np.uint64) * _SPREAD >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        rank = np.empty(len(part), np.int64)
        rank[self.order] = np.arange(len(part))
        bits = size.bit_length()
        codes, self.which = _numbered(rank[which] << bits | w)
        self.of, self.w = codes >> bits, codes & (1 << bits) - 1
        self.context, part = context[self.order][self.of], part[self.order][self.of]
        self.edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        self.parts = part[self.edges[:-1]]


def placed(rows: DataFrame, size: int, kind: str, parts: int) -> DataFrame:
    """rows: DOCS. With triples: of each distinct triple of the piece how often it is in the training texts; and with seen: of each distinct context
    (the two before) how often it is there, and how many kinds follow it. In order, in planes. The distinct triples of a piece move to their part and back once."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            for piece, lens, held, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), _texts(batch.column(3), kind)):
                lens = lens.values.to_numpy()
                deal = Deal(ids, lens, size, parts)
                train = np.repeat(~held.values.to_numpy(zero_copy_only=False), lens + 1)
                times = np.bincount(deal.which[train], minlength=len(deal.w))
                gap = np.diff(deal.context, prepend=0)
                gap[deal.edges[:-1]] = deal.context[deal.edges[:-1]]
                planes = _planes(gap & 0xFFFFFFFF, gap >> 32, deal.w, times)
                sent = [shrink(planes[:, a:b].tobytes()) for a, b in zip(deal.edges, deal.edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(deal.parts.astype(np.int32)), pa.array(np.full(len(sent), piece)), pa.array(sent, pa.binary())], names=["part", "piece", "values"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}  # of a task's parts, mostly one
        for batch in batches:
            for part, piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                low, high, w, times = _numbers(np.frombuffer(zstandard.decompress(raw.as_buffer()), np.uint8).reshape(16, -1)).astype(np.int64)
                whole.setdefault(part, []).append((piece, np.cumsum(low + (high << 32)) * size + w, times.astype(np.uint32)))
        shrink = zstandard.ZstdCompressor(1).compress
        for part in sorted(whole):
            own = whole.pop(part)
            codes, which = np.unique(np.concatenate([c for _, c, _ in own]), return_inverse=True)
            times = np.bincount(which, np.concatenate([t for *_, t in own])).astype(np.int64)
            context = codes // size
            new = np.concatenate([[True], context[1:] != context[:-1]])
            first, number = np.flatnonzero(new), np.cumsum(new) - 1
            seen, kinds = np.add.reduceat(times, first), np.add.reduceat((times > 0).astype(np.int64), first)
            at = 0
            for piece, c, _ in own:
                mine = which[at : at + len(c)]
                at += len(c)
                its = number[mine]
                its = its[np.concatenate([[True], its[1:] != its[:-1]])]
                raw = b"".join(_planes(v).tobytes() for v in (times[mine], seen[its], kinds[its]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece]), pa.array([shrink(raw)], pa.binary())], names=["part", "piece", "values"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DOCS.split(", ")]
        row, got = None, []

        def out() -> pa.RecordBatch:
            ids, lens = next(_texts(row.column("ids"), kind)), row.column("lens")[0].values.to_numpy()
            deal = Deal(ids, lens, size, parts)
            if len(got) != len(deal.parts):
                raise ValueError("answers are missing")
            triples, by_context = np.zeros(len(deal.w), np.uint32), np.zeros((2, len(deal.order)), np.uint32)
            for raw, a, b in zip(got, deal.edges, deal.edges[1:]):
                raw = np.frombuffer(zstandard.decompress(raw), np.uint8)
                triples[a:b] = _numbers(raw[: 4 * (b - a)].reshape(4, -1))[0]
                by_context[:, deal.order[deal.of[a] : deal.of[b - 1] + 1]] = _numbers(raw[4 * (b - a) :].reshape(8, -1))
            packed = [pa.array([zstandard.compress(v.tobytes(), 1)], pa.binary()) for v in (_planes(triples[np.argsort(deal.order[deal.of] << size.bit_length() | deal.w)]), _planes(*by_context))]
            return pa.RecordBatch.from_arrays([*(row.column(n) for n in names), *packed], names=[*names, "triples", "seen"])

        for batch in batches:
            for k, part in enumerate(batch.column("part").to_pylist()):
                if part < 0:
                    if row is not None:
                        yield out()
                    row, got = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(k, 1)]) for c in batch.columns], names=batch.schema.names), []
                else:
                    got.append(batch.column("values")[k].as_py())
        if row is not None:
            yield out()

    answers = rows.select("piece", "lens", "held_out", "ids").mapInArrow(asked, "part int, piece long, values binary").repartitionById(parts, F.col("part")).mapInArrow(answered, "part int, piece long, values binary")
    pieces = rows.select(*(x.split()[0] for x in DOCS.split(", ")), F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("values"))
    return pieces.unionByName(answers, allowMissingColumns=True).repartition("piece").sortWithinPartitions("piece", "part").mapInArrow(beside, DOCS + ", triples binary, seen binary")


def values_of(ids: np.ndarray, lens: np.ndarray, size: int, triples, seen) -> np.ndarray:
    """Of each subword and each end: its triple's count, its context's, and the kinds after that."""
    before, b, w = contexts(ids, lens, size)
    _, which = _numbered_contexts(before, b, size)
    _, triple = _numbered(which.astype(np.int64) << size.bit_length() | w)
    one, two = (_numbers(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(n, -1)) for x, n in ((triples, 4), (seen, 8)))
    return np.concatenate([one.take(triple, 1), two.take(which, 1)])


def _placed_rows(batches: Iterable[pa.RecordBatch], size: int, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From lens, held_out, ids, triples and seen: ids, lens, which texts are for training, and values."""
    for batch in batches:
        for lens, held, ids, triples, seen in zip(batch.column(0), batch.column(1), _texts(batch.column(2), kind), batch.column(3), batch.column(4)):
            lens = lens.values.to_numpy()
            yield ids, lens, ~held.values.to_numpy(zero_copy_only=False), values_of(ids, lens, size, triples.as_buffer(), seen.as_buffer())


def statistics(rows: DataFrame, size: int, kind: str) -> Shares:
    """rows: as placed gives them. To the driver come three numbers for each subword. Each occurrence of a pair is its share of one kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
        for lens, held, ids, raw in ((x.values.to_numpy(), *y) for batch in batches for x, *y in zip(batch.column(0), batch.column(1), _texts(batch.column(2), kind), batch.column(3))):
            before, b, w = contexts(ids, lens, size)
            own, seen = ~held.values.to_numpy(zero_copy_only=False), _numbers(np.frombuffer(zstandard.decompress(raw.as_buffer()), np.uint8).reshape(8, -1))[0].take(_numbered_contexts(before, b, size)[1])
            train = np.repeat(own, lens + 1)
            goes_on = np.flatnonzero(train & (w != size - 1))
            n += np.bincount(w[train], minlength=size)
            last += np.bincount(b[train & (w == size - 1)], minlength=size)
            kinds += np.bincount(b[goes_on], 1 / seen.take(goes_on + 1), size)
        on = np.flatnonzero(n + last)
        yield pa.RecordBatch.from_arrays([pa.array(on), *(pa.array(v[on]) for v in (n, last, kinds))], names=["code", "n", "last", "kinds"])

    got = rows.select("lens", "held_out", "ids", "seen").mapInArrow(run, "code long, n long, last long, kinds double").groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n", "last", "kinds"))).toArrow()
    code, n, last, kinds = (c.to_numpy() for c in got.columns)
    made = np.zeros((3, size))
    made[:, code.astype(np.int64)] = n, last, np.round(kinds) + (last > 0)
    return Shares(*made)


def _split(ids: np.ndarray, lens: np.ndarray, shares: tuple[np.ndarray, np.ndarray]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """By text."""
    edges = np.cumsum(lens)[:-1]
    return np.split(ids, edges), list(zip(*(np.split(v, edges + np.arange(1, len(lens))) for v in shares)))


def averaged(made: DataFrame) -> np.ndarray | None:
    """made: part, n, weights of the tasks. Their mean by n: groups of FAN_IN are averaged by tasks, again and again; the driver gets a group."""

    def mean(rows: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
        total = sum(n for n, _ in rows)
        return total, sum(np.frombuffer(v, "<f4").astype(np.float64) * (n / total) for n, v in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for part, n, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
                total, x = rows.get(part // FAN_IN, (0, 0.0))
                rows[part // FAN_IN] = total + n, x + np.frombuffer(v, "<f4").astype(np.float64) * n
        for part, (n, x) in rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([(x / n).astype("<f4").tobytes()], pa.binary())], names=["part", "n", "weights"])

    made = stash(made, "weights")
    while made.count() > FAN_IN:
        made = stash(made.repartition(F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("part").mapInArrow(run, made.schema), "weights")
    rows = [(r["n"], r["weights"]) for r in made.orderBy("part").collect()]
    return mean(rows)[1] if rows else None


def train(rows: DataFrame, size: int, kind: str) -> tuple[Broadcast, Broadcast]:
    """rows: as placed gives them. Of a Model: its statistics and numbers as read, and its weights, flat. The end of a text is the id after the
    vocabulary's last."""
    sc = rows.sparkSession.sparkContext
    grams = statistics(rows, size + 1, kind)
    reads = reads_of(grams.counts)
    shared = sc.broadcast((grams, reads))
    w = first_weights()
    for r in range(ROUNDS):
        now = sc.broadcast(to_flat(w))

        def run(batches: Iterator[pa.RecordBatch], now=now, r=r) -> Iterator[pa.RecordBatch]:
            g, as_read = shared.value
            part = TaskContext.get().partitionId()

            def made() -> Iterator[Windows]:
                for ids, lens, own, values in _placed_rows(batches, size + 1, kind):
                    texts, shares = _split(ids, lens, g(ids, lens, values, 1))
                    on = np.flatnonzero(own).tolist()
                    yield from windows([texts[k] for k in on], g, as_read, 1, r, ROUNDS, [shares[k] for k in on])

            learned, n = learn(from_flat(now.value), made(), part + r)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([to_flat(learned).astype("<f4").tobytes()], pa.binary())], names=["part", "n", "weights"])

        mean = averaged(rows.select("lens", "held_out", "ids", "triples", "seen").mapInArrow(run, "part int, n long, weights binary"))
        w = w if mean is None else from_flat(mean)
    return shared, sc.broadcast(to_flat(w))


def score_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    size = encoder(tokenizer_path).tokenizer.get_vocab_size()
    kind = "<u2" if size < 65_535 else "<u4"
    counts = stash(word_counts(docs), "words")
    n_train = _rows(docs).filter("not held_out").count()
    sums = counts.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    n, v = sums["n"] + n_train, sums["v"] + (n_train > 0)
    top = most_frequent(counts, "total", FREQUENT).select("h", "train").toArrow()
    frequent = Table(top.column(0).to_numpy().astype(np.int64), top.column(1).to_numpy().astype(np.float64), FREQUENT_BITS)
    several = bitmap(counts.filter("total > 1").select(F.pmod("h", F.lit(1 << FILTER_BITS)).alias("bit")))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    rows = stash(_read(docs, spark.sparkContext.broadcast((frequent, several)), tokenizer_path, kind), "read", "zstd")
    texts = stash(placed(rows, size + 1, kind, 1 + n // WORDS_PER_PART), "placed", "zstd")
    rare = stash(rows.select("piece", "at", "h", "times"), "rare", "zstd")
    drop_stash(rows)
    rest = (
        rare.select("piece", F.explode(F.arrays_zip("at", "h", "times")).alias("w")).select("piece", "w.*")
        .join(counts.select("h", "train"), "h")
        .groupBy("piece", "at").agg(F.sum(F.col("times") * F.log10(F.col("train") + 0.5)).alias("more"), F.sum(F.when(F.col("train") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    )
    shared, weights = train(texts, size, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(from_flat(weights.value), *shared.value)
        for batch in batches:
            for k, (ids, lens, _, values) in enumerate(_placed_rows([batch.select(["lens", "held_out", "ids", "triples", "seen"])], size + 1, kind)):
                score = model.scores(*_split(ids, lens, model.grams(ids, lens, values, 0)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lens), batch.column(0)[k].as_py())), pa.array(np.arange(len(lens), dtype=np.int32)), *(batch.column(c)[k].values for c in range(1, 6)), pa.array(score / np.log(10))],
                    names=["piece", "at", "doc_id", "held_out", "n_tokens", "known", "logs", "score"])

    scored = texts.select("piece", "doc_id", "held_out", "n_tokens", "known", "logs", "ids", "lens", "triples", "seen").mapInArrow(run, "piece long, at int, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double")
    base = F.col("logs") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(n_train + 0.5))) - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    return scored.join(rest, ["piece", "at"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_train > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
