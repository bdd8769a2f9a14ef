"""Many names in one pass over a text: an Aho-Corasick automaton, built once a worker, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters of the patterns of one automaton, some 100 bytes of a worker's memory each; more patterns are dealt to several passes.
MOST_CHARS = 1_000_000

FOUND = "array<struct<i:int,n:int>>"


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _border(text: str, at: int) -> bool:
    return (at > 0 and _is_word(text[at - 1])) != (at < len(text) and _is_word(text[at]))


def build(patterns: Sequence[tuple[int, str, bool]]) -> ahocorasick.Automaton | None:
    """patterns: number, text in lower case, whether it must stand as words. Several may have one text."""
    by_text: dict[str, list[tuple[int, bool]]] = {}
    for i, p, words in patterns:
        if p:
            by_text.setdefault(p, []).append((i, words))
    if not by_text:
        return None
    machine = ahocorasick.Automaton()
    for p, owners in by_text.items():
        machine.add_word(p, (len(p), owners))
    machine.make_automaton()
    return machine


def count(machine: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """How often each pattern stands in the text, in any case; hits of one pattern don't overlap, the leftmost count."""
    low, ends, counts = text.lower(), {}, {}
    for last, (size, owners) in machine.iter(low):
        begin = last + 1 - size
        for i, words in owners:
            if begin >= ends.get(i, 0) and (not words or (_border(low, begin) and _border(low, last + 1))):
                ends[i] = last + 1
                counts[i] = counts.get(i, 0) + 1
    return counts


def occurrences(spark: SparkSession, text: Column, patterns: Sequence[tuple[int, str, bool]]) -> Column:
    """An array of (i, n): the patterns that stand in the text and how often. patterns as in build, in any case."""
    parts, now, size = [], [], 0
    for i, p, words in patterns:
        if now and size + len(p) > MOST_CHARS:
            parts.append(now)
            now, size = [], 0
        now.append((i, p.lower(), words))
        size += len(p)
    parts.append(now)

    def one(part: list[tuple[int, str, bool]]) -> Column:
        shared = spark.sparkContext.broadcast(part)

        @F.pandas_udf(FOUND)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            machine = build(shared.value)
            for texts in batches:
                yield texts.map(lambda t: [] if machine is None or not t else [{"i": i, "n": n} for i, n in sorted(count(machine, t).items())])

        return run(text)

    return F.concat(*map(one, parts))
