"""Plug-ins for SQL: the cuts of texts as table functions (T1, T2, T4), and registries of row extractors and rule sets by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunk import packed


@udtf(returnType="section int, sub_account string, section_text string")
class CutByBoundary:
    """cut_by_boundary(text, pattern): a section from each match to the next; what precedes the first is dropped."""

    def eval(self, text: str, pattern: str) -> Iterator[tuple[int, str | None, str]]:
        marks = list(re.finditer(pattern, text or ""))
        for i, m in enumerate(marks):
            end = marks[i + 1].start() if i + 1 < len(marks) else len(text)
            yield i + 1, m.group(1) if m.re.groups else None, text[m.start() : end]


@udtf(returnType="section int, section_name string, section_text string")
class CutByMarkers:
    """cut_by_markers(text, markers, a | between them): a section from each marker to the next, named by it."""

    def eval(self, text: str, markers: str) -> Iterator[tuple[int, str, str]]:
        names = [m for m in (markers or "").split("|") if m]
        marks = list(re.finditer("|".join(map(re.escape, names)), text or "")) if names else []
        for i, m in enumerate(marks):
            end = marks[i + 1].start() if i + 1 < len(marks) else len(text)
            yield i + 1, m.group(0).replace("---", "").strip().lower(), text[m.start() : end]


@udtf(returnType="part int, part_text string")
class CutBySize:
    """T4: cut_by_size(text, most): paragraphs packed while they fit, then lines, then cuts."""

    def eval(self, text: str, most: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(packed(text or "", most))


TABLE_FUNCTIONS = {"cut_by_boundary": CutByBoundary, "cut_by_markers": CutByMarkers, "cut_by_size": CutBySize}

Extractor = Callable[[DataFrame], DataFrame]
EXTRACTORS: dict[str, Extractor] = {}


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    """Register a function from documents (doc_id, text) to rows under a name that `extract` and its view know."""
    def add(f: Extractor) -> Extractor:
        if name in EXTRACTORS:
            raise ValueError(f"there is an extractor {name} already")
        EXTRACTORS[name] = f
        return f

    return add


def extract(docs: DataFrame, name: str) -> DataFrame:
    if name not in EXTRACTORS:
        raise LookupError(f"no extractor {name}; there are {', '.join(sorted(EXTRACTORS)) or 'none'}")
    return EXTRACTORS[name](docs)


def register(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """Make the table functions callable from SQL and, given documents, each extractor's rows a view rows_<name>."""
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    for name in EXTRACTORS if docs is not None else ():
        extract(docs, name).createOrReplaceTempView(f"rows_{name}")
