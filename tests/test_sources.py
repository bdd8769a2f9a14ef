"""Reading and writing files, and files as a stream."""

import io
import tracemalloc
import zipfile

from pyspark.sql import functions as F

from tallyforge.sources import files, sinks

MAP = {"account id": "carrier_account_number", "service name": "component_or_feature_name", "mrc": "monthly_recurring_cost", "status": "status"}


def test_tables(spark, tmp_path):
    head = ["Account ID", "Service-Name", "MRC", "mrc"]
    (tmp_path / "a.csv").write_text("title,,\nAccount ID,Service Name,MRC\n007,Line,\"$1,200.50\"\n008,,\n")
    (tmp_path / "b.xlsx").write_bytes(sinks.workbook({"Sheet": [["Account ID", "Service Name", "MRC"], ["12.0", "Fee", 3.5]]}))
    (tmp_path / "x_WIP_y.csv").write_text("result\n")
    (tmp_path / ".hidden").write_text("x")
    found = files.scan_directory(spark, f"file://{tmp_path}")
    assert sorted(r.file_name for r in found.select("file_name").collect()) == ["a.csv", "b.xlsx"]
    rows = files.typed_cells(files.structured_rows(found, MAP), ["carrier_account_number", "component_or_feature_name", "monthly_recurring_cost"]).collect()
    assert sorted((r.carrier_account_number, r.component_or_feature_name, float(r.monthly_recurring_cost)) for r in rows) == [("007", "Line", 1200.5), ("12", "Fee", 3.5)]
    assert files.resolve_columns(head, MAP) == {0: "carrier_account_number", 2: "monthly_recurring_cost"}
    assert files.header_row([["x"], ["A", "B", "C"]], {"A", "B", "C"}) == 1


def test_mail_and_words(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(b"Subject: Bill\nContent-Type: text/html\n\n<style>x</style><p>Hello <b>there</b></p>")
    buf = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "d.docx").write_bytes(buf.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r.file_name: r.text for r in files.file_texts(files.scan_directory(spark, f"file://{tmp_path}")).collect()}
    assert got == {"m.eml": "Subject: Bill\n\nHello there", "d.docx": "Para\na | b", "bad.docx": ""}
    assert files.is_scanned(files.file_texts(files.scan_directory(spark, f"file://{tmp_path}"))).filter("scanned").count() == 1


def test_columns_and_blocks(spark):
    pages = {
        0: [("HEAD", 10, 0), ("L1", 10, 10), ("R1", 300, 10), ("more", 340, 13), ("L2", 10, 20), ("R2", 300, 24), ("foot", 10, 40), ("L3", 10, 50), ("R3", 300, 50)],
        1: [("b", 40, 10), ("a", 10, 14), ("c", 10, 15)],  # 14 is of the line that begins at 10, 15 isn't
        2: [("near", 190, 10), ("middle", 210, 10), ("x", 10, 20)],  # both halves, but nothing well apart
        3: [(None, 10, 10), ("only", None, 10)],
        4: [(f"{i}", 10, 10 * i) for i in range(9)] + [("far", 300, 0)],  # one line of nine
    }
    made = spark.createDataFrame([("d", p, None if p == 1 else 400.0, t, x, y, "clash") for p, ws in pages.items() for t, x, y in ws], "doc_id string, page int, width double, text string, x int, y int, line string")
    got = {r.page: r.text for r in files.reflow(made).collect()}
    assert got == {0: "HEAD\nL1\nL2\nR1 more\nR2\nfoot\nL3\nR3", 1: "a b\nc", 2: "near middle\nx", 4: "0 far\n" + "\n".join("12345678")}
    assert files.reflow(made.limit(0)).count() == 0
    w = spark.createDataFrame([("d", 0, "ACME", 100.0, 70.0), ("d", 0, "MAIN", 110.0, 80.0), ("d", 0, "far", 300.0, 80.0), ("d", 0, "high", 100.0, 10.0)], "doc_id string, page int, text string, x double, y double")
    m = spark.createDataFrame([("d", 0, "Account", 100.0, 100.0)], "doc_id string, page int, text string, x double, y double")
    assert files.blocks_above(w, m).first().block == "ACME\nMAIN"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u1", 1), ("u2", 2)], "upload_id string, v int")
    path = f"file://{tmp_path}/inv"
    sinks.write_inventory(df, path)
    sinks.write_inventory(df.filter("upload_id = 'u1'").withColumn("v", F.lit(9)), path)
    assert {(r.upload_id, r.v) for r in spark.read.parquet(path).collect()} == {("u1", 9), ("u2", 2)}
    assert sinks.spans(["a", "a", "b"]) == [("a", 0, 1), ("b", 2, 2)]
    heads = spark.createDataFrame([("t", 1, "a"), ("t", 2, "a"), ("t", 3, None), ("t", 4, ""), ("t", 5, "a"), ("u", 1, None)], "template string, position int, area string")
    assert sorted(map(tuple, sinks.area_spans(heads).collect())) == [("t", "", 3, 4), ("t", "a", 1, 2), ("t", "a", 5, 5), ("u", "", 1, 1)]


def test_stream(spark, tmp_path):
    from tallyforge import schema, streaming

    src, out = tmp_path / "in", []
    spark.createDataFrame([tuple({"row_seq": 1, "phone_number": "12"}.get(f.name) for f in schema.RECORD)], schema.RECORD).write.parquet(f"file://{src}")
    q = streaming.audited(streaming.arriving_rows(spark, f"file://{src}"), lambda df, n: out.extend(df.select("row_seq", F.size("issues").alias("n")).collect()), f"file://{tmp_path}/cp", "2024-01-01")
    q.awaitTermination(60)
    assert [(r.row_seq, r.n) for r in out] == [(1, 3)]


def test_workbooks_row_by_row():
    """A sheet was held as one string and one tree, and its rows as one list."""
    made = sinks.workbook({"S": ([f"name {i}", i] for i in range(60_000))})
    tracemalloc.start()
    rows = files.each_workbook_row(made, "S")
    assert next(rows) == ["name 0", "0"] and sum(1 for _ in rows) == 59_999
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    assert files.workbook_rows(sinks.workbook({"S": [["a", None, "b"], [], [None, 5]]})) == [["a", None, "b"], [], [None, "5"]]
