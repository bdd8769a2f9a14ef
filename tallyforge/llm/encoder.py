"""Whole-text encoding with a public tokenizer file, one model call for each distinct word."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: The word pattern of byte-level pre-tokenisation, as published with the vocabulary.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The words of the other vocabulary: none of them holds white space, and the text is lower-cased before.
SPACELESS_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts with other characters than these go to the library whole: Unicode versions may differ there, and lower case may leave the range.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ſ]")


_PLAIN_END = 0x180


def _spelled_out(pattern: str) -> re.Pattern:
    """The pattern with its letter and number classes written as ranges of plain characters: re is several times as fast as regex."""
    for name in ("L", "N"):
        own = regex.compile(rf"\p{{{name}}}")
        spans: list[list[int]] = []
        for c in filter(lambda c: own.match(chr(c)), range(_PLAIN_END)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        ranges = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)
        pattern = re.sub(rf"(\[[^\]]*)\\p\{{{name}\}}", lambda m, r=ranges: m[1] + r, pattern)  # within a class
        pattern = pattern.replace(rf"\p{{{name}}}", f"[{ranges}]")
    return re.compile(pattern)


def _byte_letters() -> dict[int, str]:
    """Byte to letter of the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """word -> its ids as uint32 bytes. A word is kept from its second look-up on; when full, the words become the old ones and those
    before are forgotten, so memory stays bounded and words in use stay."""

    def __init__(self, model, most: int):
        super().__init__()
        self.model, self.most, self.letters = model, most, _byte_letters()
        self.space = self.letters[32]
        self.old: dict[str, bytes] = {}
        self.met = bytearray(1 << 20)

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.made(word)
            at = hash(word) & 0xFFFFF
            if not self.met[at]:
                self.met[at] = 1
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.met = bytearray(1 << 20)
        self[word] = out
        return out

    def made(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalnum() and (word[0] == " " or word[0].isalnum()):  # these letters stand for themselves
            spelled = self.space + word[1:] if word[0] == " " else word
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()


class Encoder:
    """ids(text) equals Tokenizer.encode(text, add_special_tokens=False).ids. Texts that hold the string of an added token, in any case,
    go to the library whole."""

    def __init__(self, path: str, most_words: int = 80_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words, self.pattern, self.lower, self.spaceless = None, None, False, False
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", []) if t["content"]) or "(?!)", re.IGNORECASE)
        self.added_heads = "".join({c for t in spec.get("added_tokens", []) for c in (t["content"][:1].lower(), t["content"][:1].upper())})
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = pre.get("pretokenizers", [pre])
        if norm is None and [s.get("type") for s in steps] == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
            self.pattern = _spelled_out(BYTE_LEVEL_WORDS)
        elif norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            self.pattern, self.lower = _spelled_out(steps[0]["pattern"]["Regex"]), True
            plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
            self.spaceless = steps[0]["pattern"]["Regex"] == SPACELESS_WORDS and spec["model"]["type"] == "BPE" and all(spec["model"].get(k) == v for k, v in plain.items())
        if self.pattern is not None:
            self.words = _Words(self.tokenizer.model, most_words)

    def ids(self, text: str) -> np.ndarray:
        if self.pattern is None or _PLAIN.search(text) or (any(c in text for c in self.added_heads) and self.added.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower() if self.lower else text))), np.uint32)


class Merges:
    """Byte pair merges of many pieces at once: as the library, each piece takes its best pair, the first of equal ones, until none is left."""

    NONE = np.int64(1 << 40)

    def __init__(self, spec: dict, bits: int = 19):
        vocab, suffix, letters = spec["vocab"], spec["end_of_word_suffix"], _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.size, self.bits = len(vocab), bits
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE)
        mask = (1 << bits) - 1
        for rank, key in enumerate(vocab[a] * self.size + vocab[b] for a, b in merges):
            slot = int(self._slots(np.array([key]))[0])
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & mask
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        held = self.keys.take(slots)
        out = np.where(held == keys, self.ranks.take(slots), self.NONE)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys.take(slots[left])
            hit = held == keys[left]
            out[left[hit]] = self.ranks[slots[left[hit]]]
            left = left[~hit & (held != -1)]
        return out

    def __call__(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: the bytes of the pieces, of `sizes` (1 at least) each. Their ids, and how many each piece has."""
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        ids = self.inner.take(data)
        ids[ends - 1] = self.last.take(data[ends - 1])
        rank = np.full(len(ids), self.NONE)
        rank[:-1] = self._ranks(ids[:-1] * self.size + ids[1:])
        rank[ends - 1] = self.NONE
        piece, n, done = np.arange(len(sizes)), sizes.astype(np.int64), []
        while len(piece):
            best = np.minimum.reduceat(rank, np.cumsum(n) - n)
            over = best == self.NONE
            if over.any():
                out, on = np.repeat(over, n), ~over
                done.append((np.repeat(piece[over], n[over]), ids[out]))
                ids, rank, piece, n, best = ids[~out], rank[~out], piece[on], n[on], best[on]
                if not len(piece):
                    break
            owner = np.repeat(np.arange(len(piece)), n)
            at = np.flatnonzero(rank == best[owner])
            at = at[np.diff(owner[at], prepend=-1) != 0]
            ids[at] = self.made.take(best)
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, owner, rank = ids[stays], owner[stays], rank[stays]
            n -= 1
            at -= np.arange(len(at))
            for x in (at, at[at > 0] - 1):
                x = x[x + 1 < len(ids)]
                same = owner[x] == owner[x + 1]
                rank[x[~same]] = self.NONE
                x = x[same]
                rank[x] = self._ranks(ids[x] * self.size + ids[x + 1])
            if at[-1] == len(ids) - 1:
                rank[-1] = self.NONE
        which, ids = (np.concatenate(v) for v in zip(*done))
        return ids[np.argsort(which, kind="stable")], np.bincount(which, minlength=len(sizes))


class WordTable:
    """Ids of many texts at once, for an encoder whose pieces hold no white space: each word between white space has ids of its own,
    whatever its case, and is looked up by the 64-bit hash of its lower-cased bytes. A word has a slot by its hash, where the last one that
    came is in; the others are encoded again. When `most` ids are held, all are forgotten."""

    #: Longer words go to the library: merges take a step for each byte of the longest.
    LONG = 64

    def __init__(self, path: str, kind: str, bits: int = 21, most: int = 1 << 23):
        self.enc, self.shift, self.most = encoder(path), np.uint64(64 - bits), most
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.hashes, self.at, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.flat, self.used = np.zeros(most, kind), 0
        self.heads = [c.encode() for c in self.enc.added_heads]

    def made(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without added tokens, and how many each has."""
        text, odd = " ".join(words), {}
        if _PLAIN.search(text) or max(map(len, words)) > self.LONG:
            odd = {k: self.enc.tokenizer.encode(w, add_special_tokens=False).ids for k, w in enumerate(words) if len(w) > self.LONG or _PLAIN.search(w)}
            text = " ".join(w for k, w in enumerate(words) if k not in odd)
        pieces = self.enc.pattern.findall(text := text.lower())
        data = np.frombuffer("".join(pieces).encode(), np.uint8)
        ids, n = self.merges(data, np.array([len(p) for p in pieces] if text.isascii() else [len(p.encode()) for p in pieces], np.int64))
        # Pieces leave nothing of a word out: it ends where they have as many letters.
        ends = np.cumsum([len(w) for w in text.split(" ")]) if text else np.zeros(0, np.int64)
        edges = np.append(0, np.cumsum(n))[np.searchsorted(np.cumsum([len(p) for p in pieces]), ends) + 1] if len(ends) else ends
        sizes = np.diff(edges, prepend=0)
        if odd:
            parts, even = np.split(ids, edges[:-1]) if len(edges) else [], iter(range(len(edges)))
            parts = [np.array(odd[k], np.int64) if k in odd else parts[next(even)] for k in range(len(words))]
            ids, sizes = np.concatenate(parts), np.array([len(v) for v in parts])
        return ids.astype(self.flat.dtype), sizes

    def ids(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Of each text from offsets to the next. hashes, bounds, starts: of its words, as `words` gives them."""
        raw = data.tobytes()
        slots = (hashes >> self.shift).astype(np.int64)
        at, n = self.at.take(slots).astype(np.int64), self.n.take(slots)
        new = np.flatnonzero((self.hashes.take(slots) != hashes) | (n == 0))
        flat = self.flat
        if len(new):
            distinct, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            first = new[first]
            ends = np.append(starts, len(raw))[first + 1]
            more, sizes = self.made([raw[a:b].rstrip().decode() for a, b in zip(starts[first].tolist(), ends.tolist())])
            places = self.used + np.cumsum(sizes) - sizes
            at[new], n[new] = places[which], sizes[which]
            if self.used + len(more) <= self.most:
                flat[self.used : self.used + len(more)] = more
                self.used += len(more)
                one = np.unique(slots[first], return_index=True)[1]
                to = slots[first][one]
                self.hashes[to], self.at[to], self.n[to] = distinct[one], places[one], sizes[one]
            else:
                flat = np.concatenate([flat[: self.used], more])
                self.n[:], self.used = 0, 0
        edges = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        flat = flat.take(np.repeat(at - edges[:-1], n) + np.arange(edges[-1]))
        cuts = edges[bounds].tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        if any(h in raw for h in self.heads):
            for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                if any(h in raw[a:b] for h in self.heads) and self.enc.added.search(text := raw[a:b].decode()):
                    out[k] = self.enc.ids(text).astype(flat.dtype)
        return out


_TABLES: dict[tuple[str, str], WordTable] = {}


def word_table(path: str, kind: str) -> WordTable | None:
    """One table a worker process, file and kind of numbers, of some 50 MB at most; none where words can't be encoded alone."""
    if encoder(path).spaceless and (path, kind) not in _TABLES:
        _TABLES[path, kind] = WordTable(path, kind)
    return _TABLES.get((path, kind))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most_words: int = 80_000) -> Encoder:
    """One encoder a worker process, file and number of words; a word takes some 250 bytes, and twice as many are held at most."""
    if (path, most_words) not in _ENCODERS:
        _ENCODERS[path, most_words] = Encoder(path, most_words)
    return _ENCODERS[path, most_words]
