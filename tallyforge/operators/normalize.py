"""Rules that make values uniform (N1-N20, F24, F25, A26). Rules are data; each compiles into one expression, and rules that a carrier
doesn't configure add nothing to the plan."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import terms
from ..functions import text as X
from ..schema import INTEGERS, MONEY

FUZZY_RATIO = 0.92


@dataclass
class Rules:
    """A carrier's rules, as its configuration has them."""

    account_from_filename: str | None = None  # pattern whose first group is the account
    location_to_sub_account: bool = False
    promote_master_account: bool = False
    service_type: dict[str, str] = field(default_factory=dict)
    usoc_service_type: dict[str, str] = field(default_factory=dict)
    usoc_component: dict[str, str] = field(default_factory=dict)
    service_type_inference: list[tuple[str, str]] = field(default_factory=list)  # (pattern, service type), the first that fits
    row_type: dict[str, str] = field(default_factory=dict)
    charge_type: dict[str, str] = field(default_factory=dict)
    billing_name_placeholders: list[str] = field(default_factory=list)
    derive_month_to_month: bool = True
    derive_billing_per_contract: bool = True
    derive_cost_per_unit: bool = False


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's value, or the value itself; exact and case-sensitive."""
    return F.coalesce(F.try_element_at(X.literal_map(table), c), c) if table else c


def before_merge(df: DataFrame, r: Rules) -> DataFrame:
    """N1-N3."""
    out = df
    acct = X.blank_to_null(F.col("carrier_account_number"))
    if r.account_from_filename:
        out = out.withColumn("carrier_account_number", F.coalesce(acct, F.nullif(F.regexp_extract("doc_id", r.account_from_filename, 1), F.lit(""))))
    if r.location_to_sub_account:
        out = out.withColumn("sub_account_number_1", F.coalesce(X.blank_to_null(F.col("sub_account_number_1")), X.blank_to_null(F.col("z_location_name"))))
    if r.promote_master_account:
        master, own = X.blank_to_null(F.col("master_account")), F.col("carrier_account_number")
        moves = master.isNotNull() & (master != F.coalesce(own, F.lit("")))
        out = out.withColumns({"sub_account_number_1": F.when(moves & X.blank_to_null(F.col("sub_account_number_1")).isNull(), own).otherwise(F.col("sub_account_number_1")), "carrier_account_number": F.when(moves, master).otherwise(own)})
    if r.row_type:
        new = F.try_element_at(X.literal_map(r.row_type), F.col("charge_type"))
        out = out.withColumn("row_type", F.when(new.isin("S", "C"), new).when(new.isNotNull(), F.lit(None)).otherwise(F.col("row_type")))
    return out


def after_merge(df: DataFrame, r: Rules, today: Column) -> DataFrame:
    """N4-N14 in their order."""
    c = F.col
    out = df.withColumn("service_type", mapped(c("service_type"), r.service_type))
    if r.usoc_service_type:
        out = out.withColumn("service_type", F.coalesce(X.blank_to_null(c("service_type")), F.try_element_at(X.literal_map(r.usoc_service_type), F.upper(F.trim("usoc")))))
        phone = X.digits(c("phone_number"))  # rows without a phone give and take nothing
        given = out.filter((phone != "") & X.blank_to_null(c("service_type")).isNotNull()).groupBy(phone.alias("_phone")).agg(F.min_by("service_type", F.struct("doc_seq", "row_seq")).alias("_given"))
        out = out.join(given, phone == F.col("_phone"), "left").withColumn("service_type", F.coalesce(X.blank_to_null(c("service_type")), c("_given"))).drop("_phone", "_given")
    if r.usoc_component:
        code = c("component_or_feature_name")
        out = out.withColumn("component_or_feature_name", F.when((F.length(code) <= 10) & (code == F.upper(code)), mapped(code, r.usoc_component)).otherwise(code))
    if r.service_type_inference:
        out = out.withColumn("service_type", F.coalesce(X.blank_to_null(c("service_type")), *(F.when(c("component_or_feature_name").rlike(f"(?i){p}"), v) for p, v in r.service_type_inference)))
    if r.row_type:
        out = out.withColumn("row_type", F.coalesce(F.try_element_at(X.literal_map(r.row_type), c("charge_type")), c("row_type")))
    out = out.withColumn("charge_type", mapped(c("charge_type"), r.charge_type))
    if r.billing_name_placeholders:
        out = out.withColumn("billing_name", F.when(F.lower(F.trim("billing_name")).isin([p.lower() for p in r.billing_name_placeholders]), None).otherwise(c("billing_name")))
    if r.derive_month_to_month:
        out = out.withColumn("currently_month_to_month", month_to_month(today))
    if r.derive_billing_per_contract:
        out = out.withColumn("billing_per_contract", billed_as_agreed(today))
    if r.derive_cost_per_unit:
        out = out.withColumn("cost_per_unit", unit_cost())
    return out


def month_to_month(today: Column) -> Column:
    """By the expiry date, where nothing is said."""
    end = F.col("contract_expiration_date")
    return F.coalesce(X.blank_to_null(F.col("currently_month_to_month")), F.when(end < today, "Yes").when(end.isNotNull(), "No"))


def billed_as_agreed(today: Column) -> Column:
    """Yes for active contracts with a cost, where nothing is said."""
    active = F.col("contract_expiration_date") >= today
    return F.coalesce(X.blank_to_null(F.col("billing_per_contract")), F.when(active & X.truthy(F.col("monthly_recurring_cost"), True), "Yes"))


def unit_cost() -> Column:
    """Cents, halves up."""
    qty = F.col("quantity")
    return F.coalesce("cost_per_unit", F.when(F.col("monthly_recurring_cost").isNotNull() & (qty > 0), F.round(F.col("monthly_recurring_cost").cast("decimal(18,6)") / qty, 2)).cast("decimal(12,2)"))


def contract_info(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Per upload: Yes with a contract, Email with e-mails only, else No; only blanks. Both have upload_id; documents doc_type."""
    said = documents.groupBy("upload_id").agg(F.when(F.bool_or(F.col("doc_type") == "contract"), "Yes").when(F.bool_or(F.col("doc_type") == "email"), "Email").otherwise("No").alias("_info"))
    return rows.join(said, "upload_id", "left").withColumn("contract_info_received", F.coalesce(X.blank_to_null(F.col("contract_info_received")), "_info")).drop("_info")


# What no carrier is called.
NOT_CARRIERS = [
    "voice", "internet", "data", "mobility", "wireless", "wireline", "broadband", "fiber", "ethernet", "service", "services", "telecom",
    "telecommunications", "carrier", "vendor", "supplier", "monthly charges", "equipment charges", "taxes", "surcharges", "fees", "unknown",
    "n/a", "na", "none", "null",
]


def plausible_carrier(c: Column) -> Column:
    """P14."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.length(s).between(3, 64) & ~F.lower(s).isin(NOT_CARRIERS) & s.rlike(r"\p{L}") & ~s.contains("$") & ~s.rlike(r"\d{3,}")


def register_carriers(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry: key, name. New plausible names are appended under their slug."""
    new = rows.filter(plausible_carrier(F.col("carrier_name"))).groupBy(X.slug(F.col("carrier_name")).alias("key")).agg(F.min(F.trim("carrier_name")).alias("name"))
    return registry.select("key", "name").unionByName(new.join(registry, "key", "left_anti"))


def backfill_phone(df: DataFrame) -> DataFrame:
    """A document none of whose rows has a phone takes the only phone it mentions (column document_phone)."""
    doc = Window.partitionBy("doc_id")
    none = F.max(X.blank_to_null(F.col("phone_number"))).over(doc).isNull()
    return df.withColumn("phone_number", F.when(none, F.col("document_phone")).otherwise(F.col("phone_number")))


def section_accounts(df: DataFrame) -> DataFrame:
    """A section's sub-account where a row has none; the master account leads."""
    c = F.col
    return df.withColumns({
        "sub_account_number_1": F.coalesce(X.blank_to_null(c("sub_account_number_1")), c("section_sub_account")),
        "carrier_account_number": F.coalesce(X.blank_to_null(c("section_master")), c("carrier_account_number"), c("section_sub_account"))})


def typed_rows(raw: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """JSON rows as typed ones, and those that are no objects. Money and whole numbers are cleaned; S or C goes to both type fields."""
    from ..schema import FIELDS, field_type

    parsed = raw.withColumn("_m", F.from_json(column, "map<string,string>"))
    bad = parsed.filter(F.col("_m").isNull()).drop("_m")
    get = lambda f: X.blank_to_null(F.try_element_at(F.col("_m"), F.lit(f)))
    cast = lambda f: (X.whole(F.regexp_replace(get(f), "[$,]", "")).cast("int") if f in INTEGERS else F.regexp_replace(get(f), "[$,]", "").try_cast("decimal(12,2)") if f in MONEY else X.parsed_date(get(f)) if f.endswith("_date") else get(f).try_cast(field_type(f).simpleString()))
    kind = F.coalesce(get("row_type"), get("service_or_component"))
    good = parsed.filter(F.col("_m").isNotNull()).select(*[c for c in raw.columns if c != column], *(cast(f).alias(f) for f in FIELDS), kind.alias("_kind"))
    both = F.col("_kind").isin("S", "C")
    return good.withColumns({"row_type": F.when(both, F.col("_kind")).otherwise(F.col("row_type")), "service_or_component": F.when(both, F.col("_kind")).otherwise(F.col("service_or_component"))}).drop("_kind"), bad


def fill_addresses(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks: account, block (text). Blank parts from the block of the same account."""
    parsed = blocks.dropDuplicates(["account"]).select(F.col("account").alias("_a"), X.address_block(F.col("block")).alias("_b"))
    out = rows.join(parsed, F.col("carrier_account_number") == F.col("_a"), "left")
    for f in ("billing_name", "service_address_1", "city", "state", "zip"):
        out = out.withColumn(f, F.coalesce(X.blank_to_null(F.col(f)), F.col(f"_b.{f}")))
    return out.drop("_a", "_b")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp, as difflib has it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def _letters(c: Column) -> Column:
    """Each character with how often it stood before: equal bags of letters are equal sets of these. Sorted, so that two texts have one order."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_sort(F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y == x)).cast("string"))))


def near_values(values: DataFrame, words: DataFrame, least: float = FUZZY_RATIO) -> DataFrame:
    """values: value, distinct. words: word and others. Each pair with a ratio of at least `least`: value, the words' columns, ratio.

    The ratio of texts with m and n characters is at most twice their common letters over m + n. So n lies between m * t / (2 - t) and its
    inverse, and at least m * t / (2 - t) letters are common: texts that are near share one of the first m - that + 1 of their sorted letters
    (prefix filter). Pairs meet by equality of such a letter and of length, common letters are counted, and only what may pass is
    compared: no pair is lost, and no value is compared with every word."""
    share = least / (2 - least)

    def prepared(d: DataFrame, c: str) -> DataFrame:
        d = d.filter(F.length(c) > 0).withColumns({f"_s_{c}": _letters(F.col(c)), f"_n_{c}": F.length(c)})
        need = F.ceil(F.col(f"_n_{c}") * F.lit(share) - F.lit(1e-9)).cast("int")
        return d.withColumn("_letter", F.explode(F.slice(f"_s_{c}", F.lit(1), F.col(f"_n_{c}") - need + 1)))

    ends = [F.ceil(F.col("_n_value") * F.lit(share) - F.lit(1e-9)).cast("int"), F.floor(F.col("_n_value") / F.lit(share) + F.lit(1e-9)).cast("int")]
    left = prepared(values, "value").withColumn("_n", F.explode(F.sequence(F.greatest(ends[0], F.lit(1)), F.greatest(ends[1], F.lit(1)))))
    met = left.join(prepared(words, "word").withColumnRenamed("_n_word", "_n"), ["_letter", "_n"])
    common = F.size(F.array_intersect("_s_value", "_s_word"))
    may = met.filter(2 * common >= F.lit(least) * (F.col("_n_value") + F.col("_n")) - F.lit(1e-9)).select("value", *words.columns).distinct()
    return may.withColumn("ratio", ratio("value", "word")).filter(F.col("ratio") >= least)


def vocabulary(df: DataFrame, column: str, allowed: list[str], synonyms: dict[str, str]) -> DataFrame:
    """column_how (exact, synonym, fuzzy, unknown, blank) and the value as the vocabulary spells it.

    Only distinct values that are neither exact nor synonyms are held against the vocabulary (near_values)."""
    low = F.lower(F.trim(F.col(column)))
    exact = F.try_element_at(X.literal_map({a.lower(): a for a in allowed}), low)
    other = F.try_element_at(X.literal_map({k.lower(): v for k, v in synonyms.items()}), low)
    words = df.sparkSession.createDataFrame([(a.lower(), a, i) for i, a in enumerate(allowed)], "word string, _word string, _i int")
    rest = df.filter(exact.isNull() & other.isNull() & (low != "")).select(low.alias("value")).distinct()
    near = near_values(rest, words).groupBy(F.col("value").alias("_low")).agg(F.max_by("_word", F.struct("ratio", -F.col("_i"))).alias("_near"))
    out = df.withColumn("_low", low).join(near, "_low", "left")
    how = F.when(F.coalesce(F.col("_low"), F.lit("")) == "", "blank").when(exact.isNotNull(), "exact").when(other.isNotNull(), "synonym").when(F.col("_near").isNotNull(), "fuzzy").otherwise("unknown")
    return out.withColumns({f"{column}_how": how, column: F.coalesce(exact, other, F.col("_near"), F.col(column))}).drop("_low", "_near")


def vocabulary_stats(df: DataFrame, column: str) -> DataFrame:
    """A26."""
    how = F.col(f"{column}_how")
    return df.agg(F.count_if(how.isin("synonym", "fuzzy")).alias("normalized"), F.count_if(how == "unknown").alias("warned"))


def expired_today(df: DataFrame, today: Column) -> Column:
    return terms.is_expired(df["contract_expiration_date"], today)
