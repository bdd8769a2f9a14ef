"""Reading heterogeneous files (S1-S21, P1-P5, P15): directories, delimited text, workbooks, mail, word-processor files, page words.

Files are scanned as binaryFile rows and parsed where they are read; only metadata comes to the driver. What needs a layout engine or
OCR (PDF text, scanned pages) is a provider: a function from bytes to pages of words, registered by extension."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import chain, islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import DATES, INTEGERS, MONEY

#: extension -> bytes to page texts; PDF extraction is registered here by whoever has an engine for it.
TEXT_PROVIDERS: dict[str, Callable[[bytes], list[str]]] = {}
# Names of files that are results, not input.
RESULT_NAMES = ["inventory file", "inventory_file", "_wip_"]
STRUCTURED = [".xlsx", ".xls", ".csv"]
#: Rows that a header is looked for in, and rows of a table that Python holds at a time.
HEADER_WITHIN, SLICE_ROWS = 5, 1_000


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """Path, file_name, ext, size, content of a directory's files, without hidden ones and results of earlier runs."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("file_name", name)
    return files.filter(~F.col("file_name").startswith(".") & ~X.any_of([F.lower("file_name").contains(n) for n in RESULT_NAMES])).select("path", "file_name", extension(F.col("file_name")).alias("ext"), F.col("length").alias("size"), "content")


def content_hash(content: Column) -> Column:
    """K5."""
    return F.sha2(content, 256)


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, so 007 keeps its zeros; quoted fields may hold line ends."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"')


def is_structured(name: Column) -> Column:
    """P15."""
    return extension(name).isin(STRUCTURED)


def route(name: Column, processing_path: Column | None = None) -> Column:
    """By extension, then as the format says, else as raw text."""
    ext = extension(name)
    out = F.when(ext.isin(".xlsx", ".xls", ".csv", ".tsv"), "structured").when(ext.isin(".eml", ".msg"), "email").when(ext == ".docx", "docx")
    return out.otherwise(F.coalesce(processing_path, F.lit("raw_text")) if processing_path is not None else F.lit("raw_text"))


def workbook_rows(raw: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of a sheet (the first, or by name) as text, from the open workbook format's XML parts."""
    return list(each_workbook_row(raw, sheet))


def each_workbook_row(raw: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The same row by row: of the sheet one row at a time is in memory, beside the shared strings."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(rel)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", ns)]
        target = next((t for n, t in sheets if sheet is None or n == sheet), None)
        if target is None:
            return
        n, above = 0, []
        for event, row in ElementTree.iterparse(z.open("xl/" + target.removeprefix("/xl/")), ("start", "end")):
            if event == "start":
                above.append(row)
                continue
            above.pop()
            if row.tag != f"{{{ns['m']}}}row":
                continue
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", ns):
                at = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(ch) - 64
                v = c.find("m:v", ns)
                kind = c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                cells[at - 1] = text
            for _ in range(n, int(row.get("r", n + 1)) - 1):
                n += 1
                yield []
            n += 1
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
            if above:
                above[-1].clear()  # rows that were read leave the tree


def each_table_row(name: str, raw: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    if name.lower().endswith(".xlsx"):
        yield from each_workbook_row(raw, sheet)
        return
    text = raw.decode("utf-8-sig", "replace")
    yield from ([c if c != "" else None for c in r] for r in csv.reader(io.StringIO(text), delimiter="\t" if name.lower().endswith(".tsv") else ","))


def table_rows(name: str, raw: bytes, sheet: str | None = None) -> list[list[str | None]]:
    return list(each_table_row(name, raw, sheet))


def mail_text(raw: bytes) -> str:
    """Subject and body of an .eml; HTML bodies without tags."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    part = m.get_body(preferencelist=("plain", "html"))
    body = part.get_content() if part else ""
    if part is not None and part.get_content_type() == "text/html":
        body = re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(style|script)[^>]*>.*?</\1>", " ", body))
        body = re.sub(r"\s+", " ", body).strip()
    return f"Subject: {m['subject'] or ''}\n\n{body}"


def word_text(raw: bytes) -> str:
    """Paragraphs, and rows of tables with their cells between bars."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body:
        if e.tag == f"{w}p" and words(e).strip():
            out.append(words(e))
        elif e.tag == f"{w}tbl":
            out += [" | ".join(words(c).strip() for c in r.findall(f"{w}tc")) for r in e.findall(f"{w}tr")]
    return "\n".join(out)


def file_texts(files: DataFrame, first_lines: int | None = None) -> DataFrame:
    """doc_id, page, text of all files: provider pages, mail, word-processor files, tables as lines, else plain text. With
    first_lines, no more lines of each page (the sniff that classification reads)."""
    providers = dict(TEXT_PROVIDERS)

    def pages(name: str, raw: bytes) -> list[str]:
        ext = re.search(r"(\.[^./]+)$", name.lower())
        ext = ext[1] if ext else ""
        try:
            if ext in providers:
                return providers[ext](raw)
            if ext == ".eml":
                return [mail_text(raw)]
            if ext == ".docx":
                return [word_text(raw)]
            if ext in (".xlsx", ".csv", ".tsv"):
                return ["\n".join(" ".join(c or "" for c in r) for r in table_rows(name, raw))]
        except (zipfile.BadZipFile, KeyError, ValueError):
            return [""]
        return [raw.decode("utf-8", "replace")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, i, "\n".join(t.split("\n")[:first_lines]) if first_lines else t) for p, n, raw in zip(pdf["path"], pdf["file_name"], pdf["content"]) for i, t in enumerate(pages(n, bytes(raw)))]
            yield pd.DataFrame(rows, columns=["doc_id", "file_name", "page", "text"])

    return files.select("path", "file_name", "content").mapInPandas(run, "doc_id string, file_name string, page int, text string")


def is_scanned(pages: DataFrame) -> DataFrame:
    """Pages and whether none has text."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), (F.max(F.length(F.trim("text"))) == 0).alias("scanned"))


def resolve_columns(headers: list[str | None], mapping: dict[str, str], overlay: dict[str, str] | None = None) -> dict[int, str]:
    """Column number -> field; the first column of a field wins, a carrier's own mapping goes before the common one."""
    table = mapping | (overlay or {})
    out: dict[int, str] = {}
    for i, h in enumerate(headers):
        norm = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", str(h or "").strip().lower())).strip()
        name = table.get(norm) or table.get(norm.replace("_", " ").replace("-", " "))
        if norm and name and name not in out.values():
            out[i] = name
    return out


def cell(field: str, c: Column) -> Column:
    """A text cell as its field's type; null if it doesn't fit."""
    s = X.blank_to_null(c)
    if field in DATES:
        return X.parsed_date(s, ("yyyy-MM-dd", "M/d/yyyy"))
    if field in INTEGERS:
        return s.try_cast("double").cast("int")
    return F.regexp_replace(s, "[$,]", "").try_cast("decimal(12,2)") if field in (*MONEY, "rate") else X.without_point_zero(s)


def structured_rows(files: DataFrame, mapping: dict[str, str], sheet: str | None = None, overlay: dict[str, str] | None = None) -> DataFrame:
    """doc_id, row_seq, cells (field -> text) of tables with a known header: the first row, or the next one where the first
    is a title. Rows with fewer than two fields go."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, name, raw in zip(pdf["path"], pdf["file_name"], pdf["content"]):
                rows = each_table_row(name, bytes(raw), sheet)
                head = list(islice(rows, 2))
                at = next((i for i, r in enumerate(head) if resolve_columns(r, mapping, overlay)), None)
                if at is None:
                    continue
                cols = resolve_columns(head[at], mapping, overlay)
                cells = ({f: r[i].strip() for i, f in cols.items() if i < len(r) and r[i] is not None and r[i].strip()} for r in chain(head[at + 1 :], rows))
                told = ((path, n, got) for n, got in enumerate(cells) if len(got) >= 2)
                while out := list(islice(told, SLICE_ROWS)):
                    yield pd.DataFrame(out, columns=["doc_id", "row_seq", "cells"])

    return files.select("path", "file_name", "content").mapInPandas(run, "doc_id string, row_seq int, cells map<string,string>")


def typed_cells(rows: DataFrame, fields: list[str]) -> DataFrame:
    """P4 over the cells of structured_rows."""
    return rows.select("doc_id", "row_seq", *(cell(f, F.try_element_at("cells", F.lit(f))).alias(f) for f in fields))


def golden_rows(files: DataFrame, mapping: dict[str, str], carriers: list[str] | None = None, sheet: str = "Baseline") -> DataFrame:
    """Names stand in the third row of a golden workbook, data from the fourth."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                rows = each_workbook_row(bytes(raw), sheet)
                head = list(islice(rows, 3))
                cols = resolve_columns(head[2], mapping) if len(head) > 2 else {}
                told = ((path, n, got) for n, r in enumerate(rows) if (got := {f: r[i].strip() for i, f in cols.items() if i < len(r) and r[i] and r[i].strip()}))
                while out := list(islice(told, SLICE_ROWS)):
                    yield pd.DataFrame(out, columns=["doc_id", "row_seq", "cells"])

    out = files.select("path", "content").mapInPandas(run, "doc_id string, row_seq int, cells map<string,string>")
    return out if carriers is None else out.filter(X.carrier(F.try_element_at("cells", F.lit("carrier_name"))).isin(carriers))


def header_row(rows: list[list[str | None]], labels: set[str], least: int = 3, within: int = HEADER_WITHIN) -> int | None:
    """The first of the first rows that has at least three known labels."""
    return next((i for i, r in enumerate(rows[:within]) if sum((c or "").strip() in labels for c in r) >= least), None)


def correction_rows(files: DataFrame, labels: dict[str, str], sheet: str = "Extracted Data") -> DataFrame:
    """doc_id, row_seq (from 0 below the header), cells (field -> text, '' where a cell is blank) of correction workbooks. The header is
    found by its labels; columns without a known one are ignored, and books without a header give no rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                rows = each_workbook_row(bytes(raw), sheet)
                head = list(islice(rows, HEADER_WITHIN))
                at = header_row(head, set(labels))
                if at is None:
                    continue
                cols = {i: labels[(c or "").strip()] for i, c in enumerate(head[at]) if (c or "").strip() in labels}
                told = ((path, n, {f: (r[i] or "").strip() if i < len(r) else "" for i, f in cols.items()}) for n, r in enumerate(chain(head[at + 1 :], rows)) if any(c and c.strip() for c in r))
                while out := list(islice(told, SLICE_ROWS)):
                    yield pd.DataFrame(out, columns=["doc_id", "row_seq", "cells"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, row_seq int, cells map<string,string>")


def reflow(words: DataFrame, share: float = 0.2, apart: float = 5.0, margin: float = 20.0) -> DataFrame:
    """doc_id, page, text of pages given as words: doc_id, page, width, text, x, y (down). A line takes the words that start less than `apart`
    below its first. Where at least a fifth of a page's lines has words well left and well right of the middle, each run of lines with words
    in both halves is read left half first; other lines, and pages, are read across.

    Words without a text or a place are left out; pages without a width are read across. A page is one group: all steps share one shuffle."""
    page = ["doc_id", "page"]
    w = words.filter("text is not null and x is not null and y is not null").repartition(*page)
    begins = F.aggregate(F.array_sort(F.collect_set(F.col("y").cast("double"))), F.array().cast("array<double>"), lambda a, y: F.when((F.size(a) == 0) | (y - F.try_element_at(a, F.lit(-1)) >= apart), F.concat(a, F.array(y))).otherwise(a))
    w = w.join(w.groupBy(*page).agg(begins.alias("_begins")), page).withColumn("line", F.size(F.filter("_begins", lambda b: b <= F.col("y"))))
    mid = F.col("width") / 2
    across = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("x", "y", "text")))), lambda t: t["text"]), " ")
    lines = w.groupBy(*page, "line").agg(
        across(F.col("x") < mid).alias("left"), across(F.col("x") >= mid).alias("right"), across(F.lit(True)).alias("whole"),
        F.coalesce(F.bool_or(F.col("x") < mid) & F.bool_or(F.col("x") >= mid), F.lit(False)).alias("both"),
        F.coalesce(F.bool_or(F.col("x") < mid - margin) & F.bool_or(F.col("x") > mid + margin), F.lit(False)).alias("wide"))
    all_lines, so_far = Window.partitionBy(*page), Window.partitionBy(*page).orderBy("line")
    lines = lines.withColumn("split", F.col("both") & (F.count_if("wide").over(all_lines) >= share * F.count("*").over(all_lines)))
    lines = lines.withColumn("_new", (F.col("split") != F.lag("split", 1, False).over(so_far)).cast("int")).withColumn("run", F.sum("_new").over(so_far))
    down = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.col(c).alias("t")))), lambda t: t["t"]), "\n")
    runs = lines.groupBy(*page, "run", "split").agg(down("left").alias("left"), down("right").alias("right"), down("whole").alias("whole"))
    part = F.when(F.col("split"), F.concat_ws("\n", "left", "right")).otherwise(F.col("whole"))
    return runs.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", part.alias("t")))), lambda t: t["t"]), "\n").alias("text"))


def blocks_above(words: DataFrame, marks: DataFrame, across: float = 50.0, up: float = 60.0) -> DataFrame:
    """Words and marks: doc_id, page, text, x, y (down). The words at most 60 above and 50 beside each mark, as lines. Both are keyed by
    bands of the height, so a mark meets its own band and the one above only."""
    band = lambda y: F.floor(y / up)
    m = marks.select("doc_id", "page", F.col("text").alias("mark"), F.col("x").alias("mx"), F.col("y").alias("my")).withColumn("band", F.explode(F.array(band(F.col("my")), band(F.col("my")) - 1)))
    near = words.withColumn("band", band(F.col("y"))).join(m, ["doc_id", "page", "band"]).filter((F.abs(F.col("x") - F.col("mx")) <= across) & (F.col("y") < F.col("my")) & (F.col("my") - F.col("y") < up))
    return near.groupBy("doc_id", "page", "mark").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda w: w["text"]), "\n").alias("block"))
