"""What reviewers' corrections teach (A9-A12, D1, J32, U1). corrections: carrier, field_name, extracted_value, corrected_value, root_cause."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import numbered


def hints(corrections: DataFrame, least: int = 2, most: int = 20, only_extraction: bool = True) -> DataFrame:
    """Corrections that at least two reviewers agree on, the commonest first. Without a cause they count too unless only_extraction."""
    ok = F.upper("root_cause") == "EXTRACTION"
    rows = corrections.filter(ok if only_extraction else ok | F.col("root_cause").isNull())
    found = rows.groupBy("field_name", "corrected_value").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("extracted_value")).alias("wrong_values")).filter(F.col("n") >= least)
    return found.orderBy(F.desc("n"), "field_name", "corrected_value").limit(most)


def patterns(corrections: DataFrame, least: int = 3) -> DataFrame:
    """Suggestions: by value for extraction causes, by field for merge causes and gaps in the data."""
    c = corrections.withColumn("cause", F.upper("root_cause"))
    values = c.groupBy("cause", "field_name", "corrected_value").agg(F.count("*").alias("n"))
    one = values.filter((F.col("cause") == "EXTRACTION") & (F.col("n") >= least)).select(
        F.when(F.col("field_name").isin("service_type", "charge_type"), F.col("field_name")).otherwise("prompt_hint").alias("suggestion"), "field_name", F.col("corrected_value").alias("top_value"), F.col("n").alias("count"))
    by_field = values.filter(F.col("cause").isin("MERGE", "DATA_GAP")).groupBy("cause", "field_name").agg(F.sum("n").alias("count"), F.max_by("corrected_value", F.struct("n", "corrected_value")).alias("top_value")).filter(F.col("count") >= least)
    return one.unionByName(by_field.select(F.when(F.col("cause") == "MERGE", "merge_rule").otherwise("data_gap").alias("suggestion"), "field_name", "top_value", "count")).orderBy(F.desc("count"), "field_name", "top_value")


def _parts(c: Column) -> Column:
    """All substrings."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(c, i, n)))))


def containing_accounts(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: pairs of accounts (strings of digits, columns a and b) of which one is part of the other. Each side's distinct accounts are spread
    to their parts, so both joins are of equals; equal accounts come once."""
    a, b = a.select("a").filter("a != ''").distinct(), b.select("b").filter("b != ''").distinct()
    inside = a.select("a", F.explode(_parts(F.col("a"))).alias("b")).join(b, "b").select("a", "b")
    around = b.select("b", F.explode(_parts(F.col("b"))).alias("a")).filter("a != b").join(a, "a").select("a", "b")
    return inside.unionByName(around)


def diagnose(corrections: DataFrame, raw: DataFrame) -> DataFrame:
    """Where a wrong value came from. corrections: id, field_name, extracted_value, corrected_value, account, phone; raw: extracted values
    before the merge in long form: doc_id, account, phone, field_name, value. Where both have a carrier, only its documents count.

    The right value in a row of the same line: MERGE; another one: EXTRACTION if it is the wrong value, else MERGE; the right value
    elsewhere only: ENRICHMENT; nowhere: DATA_GAP. Rows are of the same line if their phones end in the same seven digits or one account is
    part of the other. Values are counted by line before they are met, so a line may hold any share of the rows; what lines say is put together for
    each account that is asked for, and corrections meet it by account, field and value: no row for each correction and line."""
    up = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    keys = ["field_name", *(["carrier"] if "carrier" in corrections.columns and "carrier" in raw.columns else [])]
    c = corrections.select("id", *keys, up("extracted_value").alias("was"), up("corrected_value").alias("right"), X.digits(F.coalesce("account", F.lit(""))).alias("a"), F.right(X.digits(F.coalesce("phone", F.lit(""))), F.lit(7)).alias("p"))
    values = raw.select("doc_id", *keys, up("value").alias("v"), X.digits(F.coalesce("account", F.lit(""))).alias("b"), F.right(X.digits(F.coalesce("phone", F.lit(""))), F.lit(7)).alias("p"))
    pairs = containing_accounts(c, values)

    def of(by: str) -> tuple[DataFrame, DataFrame]:
        """Of the lines named by `by`: the first value of each field, and the distinct values."""
        r = values.filter(F.col(by) != "")
        return r.groupBy(by, *keys).agg(F.min(F.when(F.col("v") != "", F.struct("doc_id", "v"))).alias("first")), r.select(by, *keys, F.col("v").alias("right")).distinct()

    first_b, said_b = of("b")
    first_p, said_p = of("p")
    first_a = pairs.join(first_b, "b").groupBy("a", *keys).agg(F.min("first").alias("first_a"))
    asked = c.filter("a != ''").select("a", *keys, "right").distinct()
    said_a = asked.join(pairs, "a").join(said_b, ["b", *keys, "right"], "left_semi").select("a", *keys, "right").distinct()
    known = values.select(*keys, F.col("v").alias("right")).distinct().withColumn("elsewhere", F.lit(True))
    out = c.join(first_a, ["a", *keys], "left").join(said_a.withColumn("in_a", F.lit(True)), ["a", *keys, "right"], "left")
    out = out.join(first_p.withColumnRenamed("first", "first_p"), ["p", *keys], "left").join(said_p.withColumn("in_p", F.lit(True)), ["p", *keys, "right"], "left")
    out = out.join(known, [*keys, "right"], "left").withColumn("had_right", F.col("in_a").isNotNull() | F.col("in_p").isNotNull()).withColumn("first_value", F.least("first_a", "first_p")["v"])
    cause = F.when(F.col("had_right"), "MERGE").when(F.col("first_value") == F.col("was"), "EXTRACTION").when(F.col("first_value").isNotNull(), "MERGE").when(F.col("elsewhere"), "ENRICHMENT").otherwise("DATA_GAP")
    return out.select("id", "field_name", cause.alias("root_cause"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    return dot / (norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], most: int = 10, ident: str = "vec_id") -> DataFrame:
    """The nearest by exact cosine."""
    return vectors.withColumn("similarity", F.round(cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), 6)).orderBy(F.desc("similarity"), ident).limit(most)


#: Rows of a block of corrections and of one of questions; a task multiplies one by the other.
BLOCK_ROWS, QUESTION_ROWS = 4_096, 512


def _packed(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """carrier and blocks of at most `size` rows: arrays of the keys and of the vectors. Rows are dealt by ranges, so a carrier may hold any share."""
    at = numbered(rows, ["carrier"], keys, "_n").withColumn("_block", F.floor((F.col("_n") - 1) / size))
    return at.groupBy("carrier", "_block").agg(F.collect_list(F.struct(*keys, "embedding")).alias("rows"))


def similar_corrections(corrections: DataFrame, questions: DataFrame, most: int = 10) -> DataFrame:
    """Corrections: corr_id, carrier, field_name, extracted_value, corrected_value, root_cause, embedding. questions: q_id, carrier, embedding.
    q_id, corr_id, similarity: of each question the `most` nearest corrections of its carrier with an extraction cause, by cosine (six
    places, of equals the lower id). Vectors of zeros or null are near nothing.

    Blocks of corrections meet blocks of questions of their carrier; a task multiplies the two matrices and keeps the best of each question,
    which are then merged: work is questions times corrections, the rows between tasks are `most` a question and block."""
    known = corrections.filter((F.col("root_cause") == "EXTRACTION") & F.col("embedding").isNotNull()).select("carrier", F.col("corr_id").cast("long").alias("corr_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = questions.filter("embedding is not null").select("carrier", F.col("q_id").cast("long").alias("q_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    pairs = _packed(known, ["corr_id"], BLOCK_ROWS).select("carrier", F.col("rows").alias("k")).join(_packed(asked, ["q_id"], QUESTION_ROWS).select("carrier", F.col("rows").alias("q")), "carrier")

    def unit(block: list[dict]) -> np.ndarray:
        m = np.array([r["embedding"] for r in block], float)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size > 0, size, np.nan)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, q in zip(batch.column(0), batch.column(1), strict=True):
                k, q = k.as_py(), q.as_py()
                ids, likeness = np.array([r["corr_id"] for r in k]), np.round(unit(q) @ unit(k).T, 6)
                for i, row in enumerate(likeness):
                    order = np.lexsort((ids, -row))[:most]
                    order = order[~np.isnan(row[order])]
                    if len(order):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), q[i]["q_id"])), pa.array(ids[order]), pa.array(row[order])], names=["q_id", "corr_id", "similarity"])

    near = pairs.select("k", "q").mapInArrow(best, "q_id long, corr_id long, similarity double")
    at = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("similarity"), "corr_id"))
    return near.withColumn("_at", at).filter(F.col("_at") <= most).drop("_at")


def similar_hints(corrections: DataFrame, questions: DataFrame, most: int = 10, least: int = 2) -> DataFrame:
    """q_id, field_name, correct_value, wrong_value, n: what at least two of a question's nearest corrections agree on; the wrong value is that of
    the nearest."""
    near = similar_corrections(corrections, questions, most)
    told = near.join(corrections.select(F.col("corr_id").cast("long").alias("corr_id"), "field_name", "extracted_value", "corrected_value"), "corr_id")
    groups = told.groupBy("q_id", "field_name", F.col("corrected_value").alias("correct_value")).agg(F.min_by(F.coalesce("extracted_value", F.lit("")), F.struct(-F.col("similarity"), "corr_id")).alias("wrong_value"), F.count("*").alias("n"))
    return groups.filter(F.col("n") >= least)


def top_fields(corrections: DataFrame, most: int = 15) -> DataFrame:
    """A9."""
    return corrections.groupBy("field_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field_name").limit(most)


def by_carrier(corrections: DataFrame) -> DataFrame:
    """A10."""
    return corrections.groupBy("carrier").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "carrier")


# Kind of master data that a corrected field teaches.
MASTER_KIND = {
    "service_address_1": "address",
    "service_address_2": "address",
    "city": "address",
    "state": "address",
    "zip": "address",
    "country": "address",
    "billing_name": "address",
    "carrier_account_number": "account_alias",
    "master_account": "account_alias",
    "carrier_circuit_number": "circuit",
    "service_type": "service",
    "usoc": "service",
}


def apply_corrections(rows: DataFrame, corrections: DataFrame, fields: list[str]) -> DataFrame:
    """Corrections: row_id, field_name, corrected_value, ts. The last correction of a field stands; values that don't fit its type are ignored."""
    last = corrections.groupBy("row_id").pivot("field_name", fields).agg(F.max_by("corrected_value", "ts"))
    out = rows.join(last.select("row_id", *(F.col(f).alias(f"_new_{f}") for f in fields)), "row_id", "left")
    return out.select(*(F.coalesce(F.col(f"_new_{c}").try_cast(dict(rows.dtypes)[c]), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def master_entries(corrections: DataFrame) -> DataFrame:
    """What corrections teach: kind, account, phone, values; the last one of a kind and key stands."""
    kind = X.literal_map(MASTER_KIND)
    c = corrections.withColumn("kind", F.try_element_at(kind, F.col("field_name"))).filter("kind is not null")
    last = c.groupBy("kind", "account", "phone", "field_name").agg(F.max_by("corrected_value", "ts").alias("v"))
    return last.groupBy("kind", "account", "phone").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "v")))).alias("values"))
