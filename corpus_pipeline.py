"""From documents to packed training sequences in five stages, each over all that the one before kept.

1. quality: documents that the classifier rejects go.      2. near_duplicates: one document of each group stays.
3. repeated_passages: passages that repeat are cut out.     4. decontamination: documents with benchmark passages go.
5. packing: what is left is packed into sequences of 2048 tokens.

All but the last return the columns of `documents`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import documents, drop_stash, small_batches, stash
from tallyforge.llm.decontaminate import keep_clean
from tallyforge.llm.minmax_dedup import keep_one
from tallyforge.llm.packing import pack_documents
from tallyforge.llm.quality import keep_good
from tallyforge.llm.suffix_dedup import without_repeats

#: Bytes of a passage of somewhat over 50 short words.
PASSAGE_BYTES = 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    kept = without_repeats(docs, PASSAGE_BYTES)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", packing)]
#: No stage but the last can be said in SQL; tests hold the pipeline against a plain model on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_stash(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
