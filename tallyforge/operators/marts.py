"""Dashboards and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as X
from .graph import running

ACTIVE, FAILED = ("extracting", "classifying", "cancel_requested", "merging"), ("error", "interrupted", "cancelled")


def run_totals(runs: DataFrame, sums: Sequence[str]) -> DataFrame:
    """A1."""
    return runs.agg(F.count("*").alias("runs"), *(F.coalesce(F.round(F.sum(c), 2), F.lit(0.0)).alias(c) for c in sums))


def review_totals(rows: DataFrame, status: str = "review_status", cost: str = "monthly_recurring_cost") -> DataFrame:
    """A2: reviewed: those whose status isn't pending."""
    return rows.agg(F.count("*").alias("n_rows"), F.round(F.sum(cost), 2).alias("total_mrc"), F.count(F.nullif(status, F.lit("pending"))).alias("reviewed"))


def counts(rows: DataFrame, by: Column, name: str, keep_null: bool = True) -> DataFrame:
    """A3, A4."""
    out = rows.groupBy(by.alias(name)).agg(F.count("*").alias("n"))
    return out if keep_null else out.filter(F.col(name).isNotNull())


def by_carrier(rows: DataFrame, carrier: str = "carrier_name", cost: str = "monthly_recurring_cost") -> DataFrame:
    """A5."""
    return rows.filter(F.col(carrier).isNotNull()).groupBy(carrier).agg(F.count("*").alias("n_rows"), F.round(F.sum(cost), 2).alias("total_mrc")).orderBy(F.desc("n_rows"), carrier)


def live(uploads: DataFrame) -> DataFrame:
    """Uploads: status, deleted_at, created_at, n_files. Deleted ones count as bin only."""
    here = F.col("deleted_at").isNull()
    return uploads.agg(
        F.count_if(here).alias("uploads"), F.count_if(~here).alias("bin"), F.count_if(here & F.col("status").isin(*ACTIVE)).alias("active"), F.count_if(here & F.col("status").isin(*FAILED)).alias("failed"),
        F.min(F.when(here & F.col("status").isin(*ACTIVE), F.col("created_at"))).alias("oldest_active"), F.coalesce(F.sum(F.when(here, F.col("n_files"))), F.lit(0)).alias("files"))


def fill_rates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Field, filled, rate: one scan and one aggregate for all fields."""
    kinds = dict(df.dtypes)
    filled = lambda f: F.count(F.when(F.col(f) != "", 1) if kinds[f] == "string" else F.col(f))
    one = df.agg(F.count("*").alias("_n"), *(filled(f).alias(f) for f in fields))
    long = one.select("_n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields))).alias("x"))
    return long.select("x.field", "x.filled", terms.percent(F.col("x.filled"), F.col("_n")).alias("rate"))


def category_fill(rates: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The mean of the rounded rates."""
    return rates.join(F.broadcast(catalogue), "field").groupBy("category").agg(F.round(F.avg("rate"), 1).alias("rate"))


def upload_stats(rows: DataFrame) -> DataFrame:
    """Per upload. issues: array of (severity)."""
    return rows.groupBy("upload_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.size("issues") > 0).alias("with_issues"), F.count_if(F.exists("issues", lambda i: i["severity"] == "error")).alias("with_errors"),
        F.countDistinct("carrier_account_number").alias("accounts"), F.array_sort(F.collect_set("carrier_name")).alias("carriers"))


def footer(rows: DataFrame, shown: Column) -> DataFrame:
    """Sums of the rows shown, and confidence counts of all."""
    return rows.agg(
        F.round(F.sum(F.when(shown, F.col("monthly_recurring_cost"))), 2).alias("total_mrc"), F.countDistinct(F.when(shown, F.col("carrier_account_number"))).alias("accounts"),
        *(F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")))


def merge_rates(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fill rates of fields before and after a merge."""
    return fill_rates(before, fields).select("field", F.col("rate").alias("before")).join(fill_rates(after, fields).select("field", F.col("rate").alias("after")), "field").withColumn("gain", F.round(F.col("after") - F.col("before"), 1))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both, in one only."""
    both = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))


def ledger(calls: DataFrame, order: Sequence[str], cap: float = 100.0, warn_share: float = 0.8) -> DataFrame:
    """Calls: backend, tier, tokens_in, tokens_out and the columns that order them. Adds cost, total (spent before the call) and state: a call is
    blocked from the one on that finds the cap reached, and costs nothing then; a warning from the share on. No cap (0): never blocked.

    The total runs over all calls in ranges of their order: sums of ranges first, then rows within a range; no window holds all calls."""
    cost = F.greatest(terms.token_cost(F.col("tier"), F.col("tokens_in"), F.col("tokens_out")), F.lit(0.0)).cast("decimal(18,8)")
    told = running(calls.withColumn("cost", cost), order, "cost", "total")
    if cap <= 0:
        return told.withColumn("state", F.lit("ok"))
    state = F.when(F.col("total") >= cap, "blocked").when(F.col("total") >= cap * warn_share, "warning").otherwise("ok")
    return told.withColumn("state", state).withColumn("cost", F.when(F.col("state") == "blocked", F.lit(0)).otherwise(F.col("cost")).cast("decimal(18,8)"))


def spend(calls: DataFrame, order: Sequence[str], cap: float = 100.0, warn_share: float = 0.8) -> DataFrame:
    """What was spent by backend, and in total (backend null), with calls made and blocked, to six places."""
    rows = ledger(calls, order, cap, warn_share)
    by = rows.groupBy("backend").agg(F.sum("cost").alias("cost"), F.count_if(F.col("state") != "blocked").alias("made"), F.count_if(F.col("state") == "blocked").alias("blocked"))
    total = by.agg(F.lit(None).cast("string").alias("backend"), F.sum("cost").alias("cost"), F.sum("made").alias("made"), F.sum("blocked").alias("blocked"))
    return by.unionByName(total).withColumn("cost", F.round(F.col("cost"), 6).cast("double"))


def upload_cards(uploads: DataFrame) -> DataFrame:
    """Sizes of nested arrays; carriers as computed, else as classified, without Unknown."""
    named = F.filter(F.array_distinct(F.coalesce("carriers", "classified")), lambda c: c != "Unknown")
    return uploads.select("short_id", F.size(F.coalesce("files", F.array())).alias("n_files"), F.size(F.coalesce("results", F.array())).alias("n_rows"), named.alias("carriers"))


def registry_counts(carriers: DataFrame, formats: DataFrame) -> DataFrame:
    """A25."""
    return carriers.join(formats.groupBy("key").agg(F.count("*").alias("formats")), "key", "left").withColumn("formats", F.coalesce("formats", F.lit(0)))


def error_reason(section: Column, account: Column, message: Column) -> Column:
    """One line: too many tokens with both numbers, a timeout with its account, or the message's first line."""
    name, numbers = F.concat(F.lit("section '"), F.coalesce(section, F.lit("None")), F.lit("'")), r"input token count \((\d+)\) exceeds the maximum.*?\((\d+)\)"
    n = lambda i: F.format_number(F.regexp_extract(message, numbers, i).try_cast("decimal(38,0)"), 0)
    large = F.concat(name, F.lit(" too large for the model ("), n(1), F.lit(" input tokens > "), n(2), F.lit(" max). Pre-parser cap should have prevented this — check carrier config."))
    late = F.concat(name, F.lit(" (sub_account="), F.coalesce(account, F.lit("None")), F.lit(") timed out"))
    short = F.left(F.split(F.coalesce(message, F.lit("")), r"\r\n|[\n\r]")[0], F.lit(200))
    is_large = message.contains("INVALID_ARGUMENT") & message.contains("token count") & message.rlike(numbers)
    return F.when(is_large, large).when(message.contains("TimeoutError") | message.contains("timed out"), late).otherwise(F.concat(name, F.lit(": "), short))


def error_reasons(errors: DataFrame, most: int = 3) -> DataFrame:
    """Errors: file, at, section, sub_account, message. The first three reasons of a file in one line, which says if there are more."""
    told = errors.select("file", "at", error_reason(F.col("section"), F.col("sub_account"), F.col("message")).alias("reason"))
    first = told.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("at", "reason"))).filter(F.col("_n") <= most + 1)
    lines = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("_n", "reason"))), lambda x: x["_n"] <= most), lambda x: x["reason"])
    return first.groupBy("file").agg(F.concat(F.array_join(lines, "; "), F.when(F.max("_n") > most, " …").otherwise("")).alias("summary"))


def client_counts(clients: DataFrame, uploads: DataFrame, entries: DataFrame) -> DataFrame:
    """Each client's uploads and reference entries; counts are grouped before they are joined."""
    n = lambda d, name: d.groupBy("client_id").agg(F.count("*").alias(name))
    return clients.join(n(uploads, "uploads"), "client_id", "left").join(n(entries, "entries"), "client_id", "left").fillna(0, ["uploads", "entries"])


def search(rows: DataFrame, words: str, columns: Sequence[str]) -> DataFrame:
    """Rows that hold the words in any column."""
    return rows.filter(F.lower(F.concat_ws("\x01", *(F.col(c).cast("string") for c in columns))).contains(words.lower()))


def review_filter(rows: DataFrame, status: str | None = None, confidence: str | None = None) -> DataFrame:
    """P10: by review status and the overall level in a JSON column."""
    out = rows if status is None else rows.filter(F.col("review_status") == status)
    return out if confidence is None else out.filter(terms.json_field(F.col("field_confidence"), "overall") == confidence)


def needs_review() -> Column:
    """Low confidence, a flag or a status that says so; 'clean' is its complement."""
    return F.coalesce((F.col("confidence") == "low") | (F.size("compliance_flags") > 0) | (F.col("status") == "Needs Review"), F.lit(False))


def merge_trigger(files: DataFrame) -> DataFrame:
    """Uploads with a contract and something to hold against it."""
    return files.groupBy("upload_id").agg((F.bool_or(F.col("doc_type") == "contract") & F.bool_or(F.col("doc_type").isin("invoice", "csr", "report", "subscription"))).alias("merge"))


def natural_order(c: Column) -> Column:
    """L3: runs of digits compare as numbers: each is padded, the rest is in lower case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def page(rows: DataFrame, by: Column, descending: bool = False, size: int = 500, tie: str = "row_id") -> DataFrame:
    """L1-L4: the first rows of an order that has no ties."""
    key = natural_order(by.cast("string"))
    return rows.orderBy(key.desc() if descending else key.asc(), tie).limit(size)
