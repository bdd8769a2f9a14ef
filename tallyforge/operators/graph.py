"""Connected components by contraction, ranks and running sums by ranges; rows stay on the executors, and no key is gathered in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write and read back, in the folder that driver and executors share; zstd takes fewer bytes than the default. Only where all of Spark runs in one process, as in tests, an unset
    spark.checkpoint.dir becomes a folder of this machine."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tallyforge/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges: a, b (strings). id, root: of each id the shortest, then least, id that it reaches.

    Each round maps an id to its least neighbour's mapping and renames the links; those within one id go. Ids at least halve a round."""
    name = lambda c: F.struct(F.length(c).alias("n"), F.col(c).alias("s"))
    links = cut(edges.filter("a is not null and b is not null").select("a", "b").distinct())
    state = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().select("id", F.col("id").alias("root"))
    links = links.filter("a != b")
    for _ in range(max_rounds):
        if links.isEmpty():
            return state
        both = links.union(links.select("b", "a"))
        up = both.groupBy("a").agg(F.min(name("b")).alias("m")).select("a", F.least(F.col("m"), name("a")).alias("m")).select("a", F.col("m.s").alias("p"))
        jump = cut(up.join(up.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p", "left").select("a", F.coalesce("pp", "p").alias("to")))
        links = cut(
            links.join(jump.withColumnRenamed("to", "x"), "a").join(jump.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        state = cut(state.join(jump.select(F.col("a").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
    raise RuntimeError("links are left after the last round")


def _by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with _range: rows of a key in ascending order lie in ascending ranges of about the same size. Written, so that ranges stay what they are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in (*keys, *order))).withColumn("_range", F.spark_partition_id()))


def _before(sums: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Sums of the ranges before, for each key: as many rows a key as it has ranges."""
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum(what).over(w), F.lit(0))).drop(what)


def _add(rows: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = before.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.col("_range").alias("_of"), "_before")
    on = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return rows.join(named, on).drop("_of", *(f"_key_{i}" for i in range(len(keys))))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """df with each row's number from 1 within its keys, by the order, which tells rows of a key apart. One key may hold any share of the rows."""
    rows = _by_ranges(df, keys, order)
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    before = _before(rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n")), keys, "_n")
    return _add(rows.withColumn("_own", own), before, keys).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def running(df: DataFrame, order: Sequence[str], what: str, name: str) -> DataFrame:
    """df with the sum of `what` over the rows before, in the order, which tells rows apart."""
    rows = _by_ranges(df, (), order)
    w = Window.partitionBy("_range").orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(F.sum(what).alias("_sum")).withColumn("_all", F.lit(0))  # a row a range: few
    kind = sums.schema["_sum"].dataType  # wider decimals would lose places
    before = _before(sums, ("_all",), "_sum").select("_range", F.col("_before").cast(kind).alias("_before"))
    return _add(rows, before, ()).withColumn(name, F.coalesce(F.sum(what).over(w), F.lit(0)) + F.col("_before")).drop("_before", "_range")
