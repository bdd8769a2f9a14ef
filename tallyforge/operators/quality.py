"""Validation, compliance and confidence of inventory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as X
from ..schema import ACCOUNTS, CONTRACT, FUZZY, INTEGERS, MONEY, PHONES, SEMI_STRUCTURED, STRUCTURED

PHONE_FORM, ZIP_FORM = r"^[\d\s\-().+]{7,20}$", r"^\d{5}(-\d{4})?$"


def _issue(test: Column, field: str, severity: str | Column, message: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(test, F.struct(F.lit(field).alias("field"), sev.alias("severity"), message.alias("message")))


def issues() -> Column:
    """V1-V5 as an array of (field, severity, message)."""
    qty, unit, mrc = F.col("quantity"), F.col("cost_per_unit"), F.col("monthly_recurring_cost")
    begin, end = F.col("contract_begin_date"), F.col("contract_expiration_date")
    found = [
        _issue(X.truthy(qty, True) & X.truthy(unit, True) & X.truthy(mrc, True) & (F.abs(qty.cast("double") * unit.cast("double") - mrc.cast("double")) > 0.02), "monthly_recurring_cost", "warning",
               F.concat(F.lit("qty("), qty, F.lit(") x unit($"), unit, F.lit("), but MRC = $"), mrc)),
        *(_issue(X.truthy(F.col(f)) & ~F.col(f).rlike(PHONE_FORM), f, "warning", F.concat(F.lit("Unusual phone format: "), F.col(f))) for f in PHONES),
        *(_issue(X.truthy(F.col(f)) & ~F.col(f).rlike(ZIP_FORM), f, "info", F.concat(F.lit("Non-standard zip: "), F.col(f))) for f in ("zip", "z_zip")),
        _issue(begin >= end, "contract_expiration_date", F.when(begin == end, "info").otherwise("error"), F.concat(F.lit("Begin "), begin.cast("string"), F.when(begin == end, " == ").otherwise(" > "), F.lit("Expiration "), end.cast("string"))),
        *(_issue(~X.truthy(F.col(f)), f, "warning", F.lit(f"Required field missing: {f}")) for f in ("carrier_name", "carrier_account_number")),
    ]
    return F.filter(F.array(*found), lambda i: i.isNotNull())


def is_valid(found: Column) -> Column:
    """V7."""
    return ~F.exists(found, lambda i: i["severity"] == "error")


def reconcile(rows: DataFrame, summary: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Summary: account, expected. Accounts whose rows don't add up to it."""
    acct = F.coalesce(F.nullif("sub_account_number_1", F.lit("")), "carrier_account_number")
    totals = rows.groupBy(acct.alias("account")).agg(F.sum("monthly_recurring_cost").cast("double").alias("extracted"))
    out = summary.join(totals, "account", "left").withColumn("extracted", F.coalesce("extracted", F.lit(0.0)))
    return out.filter(F.abs(F.col("extracted") - F.col("expected")) > tolerance).withColumn("delta", F.round(F.col("extracted") - F.col("expected"), 2))


def _flag(test: Column, check: str, severity: str | Column, message: Column, details: dict[str, Column]) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(test, F.struct(F.lit(check).alias("check"), sev.alias("severity"), message.alias("message"), F.create_map(*(x for k, v in details.items() for x in (F.lit(k), v.cast("string")))).alias("details")))


def rate_severity(bill: Column, mrc: Column) -> Column:
    """Error above 10 % off the contract's rate, warning above 1 %; nothing within half a dollar or without a rate."""
    said, rate = F.lower(F.trim(bill)), X.dollar(bill)
    off = F.abs(mrc - rate)
    share = off / rate * 100
    usable = X.truthy(mrc, True) & X.truthy(bill) & ~said.isin("yes", "n/a", "na", "none", "") & ~said.startswith("n/a") & (rate > 0) & (off > 0.5)
    return F.when(usable & (share > 10), "error").when(usable & (share > 1), "warning")


def flags(today: Column) -> Column:
    """C1-C5 as an array of flags."""
    c = F.col
    mrc, end = c("monthly_recurring_cost"), c("contract_expiration_date")
    low = lambda f: F.lower(F.trim(F.coalesce(c(f), F.lit(""))))
    bill, mtm, auto = c("billing_per_contract"), low("currently_month_to_month"), low("auto_renew")
    severity = rate_severity(bill, mrc)
    billed = F.coalesce(mrc > 0, F.lit(False))
    expired = terms.is_expired(end, today)
    excused = (mtm == "yes") | (auto == "yes")
    begin, months = c("contract_begin_date"), c("contract_term_months")
    expected = F.add_months(begin, months)
    none = F.coalesce(*(c(f).cast("string") for f in ("contract_term_months", "contract_begin_date", "contract_expiration_date", "contract_number", "currently_month_to_month", "auto_renew"))).isNull()
    found = [
        _flag(severity.isNotNull(), "rate_mismatch", severity, F.concat(F.lit("MRC $"), mrc, F.lit(" vs contract rate $"), X.dollar(bill)), {"invoice_mrc": mrc, "contract_rate": X.dollar(bill), "billing_per_contract_raw": bill}),
        _flag(billed & expired, "expired_contract", F.when(excused, "info").otherwise("warning"), F.concat(F.lit("Contract expired "), end.cast("string")), {"expiration_date": end, "currently_mtm": mtm, "auto_renew": auto, "mrc": mrc}),
        _flag((mtm == "yes") & end.isNotNull() & ~expired, "mtm_inconsistency", "warning", F.concat(F.lit("Month to month, but active until "), end.cast("string")), {"expiration_date": end, "currently_mtm": F.lit("yes")}),
        _flag(X.truthy(months, True) & ~terms.term_matches(begin, months, end), "term_date_mismatch", "info", F.concat(F.lit("Expected "), expected.cast("string"), F.lit(", expires "), end.cast("string")), {"begin_date": begin, "term_months": months, "expected_expiration": expected, "actual_expiration": end}),
        _flag(billed & none, "no_contract", "info", F.lit("Active billing without contract fields"), {"mrc": mrc, "phone": F.coalesce(c("phone_number"), F.lit("")), "account": F.coalesce(c("carrier_account_number"), F.lit(""))}),
    ]
    return F.filter(F.array(*found), lambda i: i.isNotNull())


def flag_summary(rows: DataFrame) -> DataFrame:
    """Counts by check:severity."""
    return rows.select(F.explode("compliance_flags").alias("f")).groupBy(F.concat_ws(":", "f.check", "f.severity").alias("kind")).agg(F.count("*").alias("n"))


def audit(df: DataFrame, today: Column) -> DataFrame:
    """Issues and flags; C6: rows without a status that have an error need review."""
    out = df.withColumn("issues", issues()).withColumn("compliance_flags", flags(today))
    error = F.exists("issues", lambda i: i["severity"] == "error") | F.exists("compliance_flags", lambda i: i["severity"] == "error")
    return out.withColumn("status", F.when(X.blank_to_null(F.col("status")).isNull() & error, "Needs Review").otherwise(F.col("status")))


def billing_sidecars(df: DataFrame, invoice: str = "_invoice_") -> DataFrame:
    """The invoice's address beside the service address; rows where they differ need review unless they have a status."""
    pairs = {"service_address_1": "billing_address_1", "city": "billing_city", "state": "billing_state", "zip": "billing_zip", "billing_name": "billing_name_from_invoice"}
    norm = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    out = df
    for own, side in pairs.items():
        if f"{invoice}{own}" in df.columns:
            out = out.withColumn(side, F.coalesce(X.blank_to_null(F.col(side)), X.blank_to_null(F.col(f"{invoice}{own}"))))
    apart = X.any_of([(norm(F.col(a)) != "") & (norm(F.col(b)) != "") & (norm(F.col(a)) != norm(F.col(b))) for a, b in pairs.items()])
    return out.withColumn("status", F.when(apart & ~X.truthy(F.col("status")), "Needs Review").otherwise(F.col("status")))


def _well_formed(field: str) -> Column:
    c = F.col(field)
    if field in PHONES:
        return c.rlike(PHONE_FORM)
    if field in (*MONEY, "rate", *INTEGERS):
        return F.lit(True)  # the column's type says so
    if field in ("zip", "z_zip"):
        return c.rlike(ZIP_FORM)
    return F.length(c) >= 3 if field in ACCOUNTS else F.lit(True)


def confidence() -> Column:
    """Q1: field -> high, medium or missing."""
    def level(f: str) -> Column:
        if f in STRUCTURED:
            return F.when(_well_formed(f), "high").otherwise("medium")
        return F.when(X.truthy(F.col(f)), "high").otherwise("medium") if f in SEMI_STRUCTURED else F.lit("medium")

    return F.create_map(*(x for f in [*STRUCTURED, *SEMI_STRUCTURED, *FUZZY, *CONTRACT] for x in (F.lit(f), F.when(F.col(f).isNull(), "missing").otherwise(level(f)))))


def overall_confidence(levels: Column, order: list[str]) -> Column:
    """The commonest level that isn't missing; of equals the one that comes first in the order of fields."""
    seen = F.filter(F.transform(F.array(*(F.lit(f) for f in order)), lambda f: F.try_element_at(levels, f)), lambda v: v.isNotNull() & (v != "missing"))
    score = F.transform(F.array_distinct(seen), lambda v: F.struct(F.size(F.filter(seen, lambda s: s == v)).alias("n"), (-F.array_position(seen, v)).alias("at"), v.alias("level")))
    return F.coalesce(F.array_max(score)["level"], F.lit("missing"))
