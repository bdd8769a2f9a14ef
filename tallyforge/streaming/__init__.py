"""Files as a stream: classified, cut and checked as they arrive. The batch functions are used as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as X
from ..schema import RECORD


def arriving_files(spark: SparkSession, path: str, per_trigger: int = 1_000) -> DataFrame:
    """Text files as they arrive: file_name, doc_type, text."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).load(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(name.alias("file_name"), X.document_type(name).alias("doc_type"), F.col("value").alias("text"))


def arriving_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RECORD).parquet(path)


def audited(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, today: str) -> StreamingQuery:
    """Each batch of rows is audited and handed to the sink with its number, so a sink that replaces by number writes each once."""
    from ..operators.quality import audit

    return rows.writeStream.foreachBatch(lambda df, n: sink(audit(df, F.to_date(F.lit(today))), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(rows: DataFrame, time: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    """W1 on a stream: the first of equal rows within a time."""
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Our own extension: events of each kind by window, closed when no later ones are awaited."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
