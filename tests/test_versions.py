"""Versions keep their rows, a failed commit changes nothing, unchanged buckets aren't written again; table functions in SQL."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import tables
from tallyforge.operators import chunk
from tallyforge.sources.versions import Conflict, Versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, tmp_path):
    kept = Versions(spark, f"file://{tmp_path}/t", ["id"], buckets=8)
    assert kept.live() == 0 and kept.numbers() == []
    with pytest.raises(LookupError):
        kept.read()
    one = spark.createDataFrame([(i, f"v{i}", None if i % 5 == 0 else i / 2) for i in range(200)] + [(3, "v3", 1.5), (None, None, None)], "id int, name string, cost double")
    assert kept.commit(one, note="first") == 1 and rows(kept.read()) == rows(one)
    two = one.withColumn("name", F.when(F.col("id") == 7, "changed").otherwise(F.col("name")))
    assert kept.commit(two, seen=1) == 2
    assert rows(kept.read()) == rows(two) and rows(kept.read(1)) == rows(one)
    assert kept.commit(two.limit(0), seen=2, note="all gone") == 3
    assert kept.read().count() == 0 and kept.read().columns == ["id", "name", "cost"] and rows(kept.read(2)) == rows(two)
    told = [tuple(r) for r in kept.history().orderBy("version").collect()]
    assert [t[:3] for t in told] == [(1, "first", 202), (2, "", 202), (3, "all gone", 0)] and told[0][3] == 8 and told[1][3] == 1
    other = kept.read(2).withColumn("more", F.lit(1))  # another schema
    assert kept.commit(other) == 4 and rows(kept.read()) == rows(other) and rows(kept.read(1)) == rows(one)


def test_failed_commits_change_nothing(spark, tmp_path):
    kept = Versions(spark, f"file://{tmp_path}/t", ["id"], buckets=4)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    kept.commit(one)
    with pytest.raises(Conflict):
        kept.commit(one, seen=0)
    broken = one.withColumn("s", F.raise_error(F.lit("no"))).select("id", F.col("s").cast("string").alias("s"))
    with pytest.raises(Exception, match="no"):
        kept.commit(broken)
    assert kept.numbers() == [1] and rows(kept.read()) == rows(one)
    # Two commits from one version: the second finds its number taken
    kept.live = lambda: 0
    with pytest.raises(Conflict):
        kept.commit(one)
    del kept.live
    assert kept.numbers() == [1] and rows(kept.read()) == rows(one)


def test_table_functions(spark):
    tables.register(spark)
    text = "head\nACTIVITY FOR ACCOUNT - 123\na\nACTIVITY FOR ACCOUNT - 456\nb"
    df = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id int, text string")
    got = spark.sql("SELECT doc_id, s.* FROM {df} d, LATERAL cut_by_boundary(d.text, 'ACTIVITY FOR ACCOUNT - ([0-9]+)') s", df=df)
    assert rows(got.select("doc_id", "sub_account", "section_text")) == rows(chunk.by_boundary(df, r"ACTIVITY FOR ACCOUNT - (\d+)").select("doc_id", "sub_account", "section_text"))
    marks = spark.createDataFrame([("x ---BILL--- a ---LISTINGS--- b",)], "text string")
    assert rows(spark.sql("SELECT s.section_name, s.section_text FROM {m}, LATERAL cut_by_markers(text, '---BILL---|---LISTINGS---') s", m=marks)) == [("bill", "---BILL--- a "), ("listings", "---LISTINGS--- b")]
    assert rows(spark.sql("SELECT s.* FROM (SELECT 'aaaa\n\nbbbb\n\ncccc' AS t), LATERAL cut_by_size(t, 10) s")) == [(0, "aaaa\n\nbbbb"), (1, "cccc")]


def test_extractors(spark):
    @tables.extractor("first_words")
    def first_words(docs):
        return docs.select("doc_id", F.split("text", " ")[0].alias("word"))

    df = spark.createDataFrame([(1, "one two")], "doc_id int, text string")
    try:
        tables.register(spark, df)
        assert rows(spark.sql("SELECT * FROM rows_first_words")) == [(1, "one")]
        with pytest.raises(ValueError):
            tables.extractor("first_words")(first_words)
        with pytest.raises(LookupError):
            tables.extract(df, "other")
    finally:
        tables.EXTRACTORS.clear()
