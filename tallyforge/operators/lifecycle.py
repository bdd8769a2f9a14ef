"""Master data, versions, imports and deletions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _entry_value(key: Column, value: Column) -> Column:
    """Phones and accounts by their digits, other identifiers in lower case."""
    return F.when(key.endswith("phone") | (key == "phone_number") | key.endswith("account_number"), X.digits(value)).otherwise(F.lower(value))


def apply_master_data(rows: DataFrame, entries: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Entries: entry_seq, carrier, account_number, key_fields map, values map. An entry fits a row if its scopes do and any of its
    identifiers is the row's; later entries overwrite. Values that don't fit a field's type are ignored (Q-24).

    Identifiers are exploded on both sides and joined as equal (kind, value), then scopes are checked."""
    keys = ["phone_number", "btn", "carrier_account_number", "sub_account_number_1", "carrier_circuit_number"]
    keys = [k for k in keys if k in rows.columns]
    mine = rows.select("row_id", "carrier_name", "carrier_account_number", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in keys))).alias("i")).select("row_id", "carrier_name", "carrier_account_number", F.col("i.k").alias("k"), _entry_value(F.col("i.k"), F.col("i.v")).alias("v")).filter("v != ''")
    theirs = entries.select("entry_seq", F.col("carrier").alias("_c"), F.col("account_number").alias("_a"), "values", F.explode("key_fields").alias("k", "raw")).withColumn("v", _entry_value(F.col("k"), F.col("raw"))).filter("v != ''")
    fits = (F.col("_c").isNull() | (F.lower("_c") == F.lower("carrier_name"))) & (F.col("_a").isNull() | (X.digits(F.col("_a")) == X.digits(F.col("carrier_account_number"))))
    hits = mine.join(theirs, ["k", "v"]).filter(fits).select("row_id", "entry_seq", F.explode("values").alias("field", "value"))
    last = hits.groupBy("row_id").pivot("field", list(fields)).agg(F.max_by("value", "entry_seq"))
    out = rows.join(last.select("row_id", *(F.col(f).alias(f"_m_{f}") for f in fields)), "row_id", "left")
    return out.select(*(F.coalesce(F.col(f"_m_{c}").try_cast(dict(rows.dtypes)[c]), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones whose keys are equal, nulls included."""
    cond = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new, _all(cond), "left_anti").unionByName(new)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def find_or_create(clients: DataFrame, names: DataFrame) -> DataFrame:
    """Clients (name) and those of `names` that no client has, in any case."""
    new = names.withColumn("_k", F.lower(F.trim("name"))).filter("_k != ''").groupBy("_k").agg(F.min(F.trim("name")).alias("name"))
    return clients.select("name").unionByName(new.join(clients.select(F.lower("name").alias("_k")), "_k", "left_anti").select("name"))


def file_versions(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files: file_name, content. existing: file_name, content_hash. An equal hash is a duplicate, else an equal name a new version."""
    f = files.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    by_hash = existing.select("content_hash").distinct().withColumn("_dup", F.lit(True))
    by_name = existing.select("file_name").distinct().withColumn("_name", F.lit(True))
    out = f.join(by_hash, "content_hash", "left").join(by_name, "file_name", "left")
    return out.withColumn("verdict", F.when(F.col("_dup"), "duplicate").when(F.col("_name"), "new_version").otherwise("new")).drop("_dup", "_name", "content")


def orphans(folders: DataFrame, uploads: DataFrame) -> DataFrame:
    """J30."""
    return folders.join(uploads.select("short_id"), "short_id", "left_anti")


def values_match(a: Column, b: Column) -> Column:
    """Blanks are equal, numbers to half a cent, dates as dates, else trimmed text."""
    x, y = X.blank_to_null(a.cast("string")), X.blank_to_null(b.cast("string"))
    num = F.abs(F.regexp_replace(x, "[$,]", "").try_cast("double") - F.regexp_replace(y, "[$,]", "").try_cast("double")) < 0.005
    day = X.parsed_date(x) == X.parsed_date(y)
    return F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), False).otherwise(F.coalesce(num, F.lit(False)) | F.coalesce(day, F.lit(False)) | (x == y))


def diff(rows: DataFrame, imported: DataFrame, fields: Sequence[str], key: str = "row_seq") -> DataFrame:
    """Row, field, old and new of cells that an import changes; a blank cell never clears."""
    both = rows.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields)).join(imported.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields)), key)
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("old"), F.col(f"b_{f}").alias("new")) for f in fields))
    long = both.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    return long.filter(X.blank_to_null(F.col("new")).isNotNull() & ~values_match(F.col("old"), F.col("new")))


def approve(rows: DataFrame, ids: DataFrame, status: str = "approved") -> DataFrame:
    """U2."""
    hit = ids.select("row_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "row_id", "left").withColumn("review_status", F.when(F.col("_hit"), status).otherwise(F.col("review_status"))).drop("_hit")


def snapshot(rows: DataFrame, versions: DataFrame, key: str = "upload_id") -> DataFrame:
    """Versions with a new one for each upload whose rows aren't what its last version holds. rows: upload_id, row_seq, payload.

    An upload's hash is of the number of its rows and two sums of their hashes, so rows are never gathered."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "row_seq", "payload").cast("decimal(20,0)")).cast("string")
    now = rows.groupBy(key).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), total("a"), total("b")), 256).alias("content_hash"))
    last = versions.groupBy(key).agg(F.max("version").alias("v"), F.max_by("content_hash", "version").alias("h"))
    new = now.join(last, key, "left").filter(F.col("h").isNull() | (F.col("h") != F.col("content_hash"))).select(key, (F.coalesce("v", F.lit(-1)) + 1).cast("int").alias("version"), "content_hash")
    return versions.select(key, "version", "content_hash").unionByName(new)


def at_version(snapshots: DataFrame, upload_id: str, version: int | None = None) -> DataFrame:
    """Rows of a version, or of the last one."""
    own = snapshots.filter(F.col("upload_id") == upload_id)
    if version is not None:
        return own.filter(F.col("version") == version)
    return own.withColumn("_last", F.max("version").over(Window.partitionBy("upload_id"))).filter("version = _last").drop("_last")


def soft_delete(uploads: DataFrame, ids: Sequence[str], when: Column) -> DataFrame:
    """U5."""
    return uploads.withColumn("deleted_at", F.when(F.col("short_id").isin(*ids) & F.col("deleted_at").isNull(), when).otherwise(F.col("deleted_at")))


def restore(uploads: DataFrame, ids: Sequence[str]) -> DataFrame:
    return uploads.withColumn("deleted_at", F.when(F.col("short_id").isin(*ids), None).otherwise(F.col("deleted_at")))


def sweep_stuck(uploads: DataFrame) -> DataFrame:
    """Runs that a restart left behind."""
    return uploads.withColumn("status", F.when(F.col("status").isin("extracting", "merging", "classifying"), "interrupted").otherwise(F.col("status")))


def listed(uploads: DataFrame, only_deleted: bool = False) -> DataFrame:
    """Live ones, or the bin, newest first."""
    gone = F.col("deleted_at").isNotNull()
    return uploads.filter(gone if only_deleted else ~gone).orderBy(F.desc("created_at"), "short_id")


# Which states an action is possible in.
POSSIBLE = {"cancel": ["extracting"], "merge": ["done"]}
IMPOSSIBLE = {"retry": ["extracting", "classifying", "merging"], "delete": ["extracting"], "purge": ["extracting"]}


def guard(uploads: DataFrame, action: str) -> DataFrame:
    """Allowed, and why not."""
    ok = F.col("status").isin(POSSIBLE[action]) if action in POSSIBLE else ~F.col("status").isin(IMPOSSIBLE[action])
    return uploads.withColumn("allowed", ok).withColumn("reason", F.when(~ok, F.concat(F.lit(f"cannot {action} while "), "status")))


def patch(uploads: DataFrame, changes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Changes: short_id and a map; unknown keys are ignored."""
    out = uploads.join(changes.select("short_id", F.col("changes").alias("_c")), "short_id", "left")
    return out.select(*(F.when(F.map_contains_key("_c", f), F.try_element_at(F.col("_c"), F.lit(f)).try_cast(dict(uploads.dtypes)[f])).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in uploads.columns))


def purge(uploads: DataFrame, rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U8: without the uploads and their rows."""
    return uploads.join(ids, "short_id", "left_anti"), rows.join(ids.withColumnRenamed("short_id", "upload_id"), "upload_id", "left_anti")


def first_of_equals(df: DataFrame, fields: Sequence[str], order: Sequence[str] = ("row_seq",)) -> DataFrame:
    """The first of rows that agree in all fields, nulls included."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*fields).orderBy(*order))).filter("_n = 1").drop("_n")


def extraction_order(df: DataFrame) -> DataFrame:
    """W2."""
    return df.withColumn("extraction_order", F.row_number().over(Window.partitionBy("upload_id").orderBy("file_seq", "section_seq", "row_seq")) - 1)


def backfill(done: DataFrame, have: DataFrame, key: str = "upload_id") -> DataFrame:
    """Typed rows of finished uploads that the typed table doesn't have yet; doing it again adds nothing. done: upload_id, status, results
    (array of row structs)."""
    rows = done.filter("status = 'done'").select(key, F.posexplode("results").alias("row_seq", "r")).select(key, "row_seq", "r.*")
    return rows.join(have.select(key).distinct(), key, "left_anti")


def lookup(table: DataFrame, column: str, value: object) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return table.filter(F.col(column) == F.lit(value))


def row_sources(rows: DataFrame, documents: DataFrame, row_id: object) -> DataFrame:
    """A row's documents: files_used holds their names, separated by commas or semicolons."""
    names = lookup(rows, "row_id", row_id).select("row_id", F.explode(F.split(F.coalesce("files_used", F.lit("")), r"\s*[,;]\s*")).alias("file_name")).filter("file_name != ''")
    return names.join(documents, "file_name", "left")
