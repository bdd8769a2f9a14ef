"""Writing results."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms


def write_inventory(df: DataFrame, path: str) -> None:
    """K2: rows by upload; writing an upload again replaces it and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(path)


def write_cache(df: DataFrame, path: str) -> None:
    """What was extracted, by carrier and kind."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("carrier", "doc_type").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """K6."""
    df.write.mode("overwrite").json(path)


def export_columns(df: DataFrame, template: Sequence[tuple[str, str]]) -> DataFrame:
    """K1: (field, label) in the template's order; flags as text."""
    return df.select(*((terms.flags_text(df[f]) if f == "compliance_flags" else df[f]).alias(label) for f, label in template))


def export_csv(df: DataFrame, path: str, template: Sequence[tuple[str, str]]) -> None:
    """K1 at any size: one directory of CSV parts."""
    export_columns(df, template).write.mode("overwrite").csv(path, header=True)


def _column(i: int) -> str:
    out = ""
    while True:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
        if i < 0:
            return out


def workbook(sheets: dict[str, Iterable[Sequence[object]]]) -> bytes:
    """K1: an open-format workbook of text and number cells; for exports of one upload, which a person opens. Rows are written as they come."""
    def sheet(rows: Iterable[Sequence[object]]) -> Iterator[str]:
        cells = lambda r, i: "".join(f'<c r="{_column(k)}{i}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{_column(k)}{i}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for k, v in enumerate(r) if v is not None)
        yield '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        for i, r in enumerate(rows, 1):
            yield f'<row r="{i}">{cells(r, i)}</row>'
        yield "</sheetData></worksheet>"

    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                for said in sheet(rows):
                    part.write(said.encode())
    return out.getvalue()


def spans(areas: Sequence[str]) -> list[tuple[str, int, int]]:
    """Runs of equal areas in a header: name, first and last column."""
    out: list[tuple[str, int, int]] = []
    for i, a in enumerate(areas):
        if out and out[-1][0] == a:
            out[-1] = (a, out[-1][1], i)
        else:
            out.append((a, i, i))
    return out


def area_spans(columns: DataFrame, template: str = "template") -> DataFrame:
    """W7 of many templates: template, area, first, last of the runs of equal areas; columns: template, position, area (null: none, '')."""
    by = Window.partitionBy(template).orderBy("position")
    c = columns.withColumn("area", F.coalesce("area", F.lit("")))
    runs = c.withColumn("_new", F.coalesce((F.col("area") != F.lag("area").over(by)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(by))
    return runs.groupBy(template, "_run", "area").agg(F.min("position").alias("first"), F.max("position").alias("last")).drop("_run")
