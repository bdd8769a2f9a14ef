"""The inventory record: fields, types, categories, and the fixed tables of the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields by category, in the order of the record's catalogue.
STRUCTURED = [
    "carrier_account_number", "sub_account_number_1", "sub_account_number_2", "master_account", "btn", "phone_number", "carrier_circuit_number",
    "monthly_recurring_cost", "quantity", "cost_per_unit", "mrc_per_currency", "num_calls", "ld_minutes", "ld_cost", "rate", "ld_flat_rate", "zip",
    "z_zip",
]
SEMI_STRUCTURED = [
    "billing_name", "service_address_1", "service_address_2", "city", "state", "country", "carrier_name", "invoice_file_name", "z_location_name",
    "z_address_1", "z_address_2", "z_city", "z_state", "z_country", "currency", "point_to_number", "port_speed", "access_speed", "upload_speed",
]
FUZZY = [
    "service_type", "service_type_2", "usoc", "service_or_component", "component_or_feature_name", "charge_type", "additional_circuit_ids", "status",
    "notes", "files_used", "row_type",
]
CONTRACT = [
    "contract_info_received", "contract_term_months", "contract_begin_date", "contract_expiration_date", "billing_per_contract",
    "currently_month_to_month", "mtm_or_less_than_year", "contract_file_name", "contract_number", "contract_number_2", "auto_renew",
    "auto_renewal_notes", "conversion_rate",
]
SIDECARS = [
    "billing_address_1", "billing_city", "billing_state", "billing_zip", "billing_name_from_invoice",
]
CATEGORY = {f: c for c, fs in (("structured", STRUCTURED), ("semi_structured", SEMI_STRUCTURED), ("fuzzy", FUZZY), ("contract", CONTRACT)) for f in fs}
ANALYST_JUDGMENT = [
    "status", "notes", "contract_info_received", "files_used", "billing_per_contract", "contract_file_name", "mtm_or_less_than_year", "auto_renew",
    "auto_renewal_notes",
]
DERIVED = [
    "conversion_rate", "mrc_per_currency", "invoice_file_name",
]

MONEY = [
    "monthly_recurring_cost", "cost_per_unit", "mrc_per_currency", "ld_cost", "ld_flat_rate",
]
INTEGERS = [
    "quantity", "num_calls", "contract_term_months",
]
DATES = [
    "contract_begin_date", "contract_expiration_date",
]
PHONES = [
    "phone_number", "btn", "point_to_number",
]
ACCOUNTS = [
    "carrier_account_number", "sub_account_number_1", "sub_account_number_2", "master_account",
]
FIELDS = [*CATEGORY, *SIDECARS]


def field_type(name: str) -> T.DataType:
    if name in MONEY:
        return T.DecimalType(12, 2)
    if name in INTEGERS:
        return T.IntegerType()
    if name in DATES:
        return T.DateType()
    return {"conversion_rate": T.DecimalType(10, 4), "ld_minutes": T.DecimalType(10, 2), "rate": T.DecimalType(12, 6)}.get(name, T.StringType())


FLAG = T.StructType([T.StructField("check", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("message", T.StringType()), T.StructField("details", T.MapType(T.StringType(), T.StringType()))])
ISSUE = T.StructType([T.StructField("field", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("message", T.StringType())])
#: Where a row comes from: all "first wins" rules order by (doc_seq, row_seq).
ORIGIN = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("doc_type", T.StringType()), T.StructField("carrier", T.StringType()), T.StructField("doc_seq", T.IntegerType()), T.StructField("row_seq", T.IntegerType())])
RECORD = T.StructType([*ORIGIN, *(T.StructField(f, field_type(f)) for f in FIELDS), T.StructField("compliance_flags", T.ArrayType(FLAG))])


def field_catalogue(spark: SparkSession) -> DataFrame:
    """field, category, extractability (G1's defaults)."""
    kind = lambda f: "analyst_judgment" if f in ANALYST_JUDGMENT else "derived" if f in DERIVED else "extractable"
    return spark.createDataFrame([(f, c, kind(f)) for f, c in CATEGORY.items()], "field string, category string, extractability string")


def extractability(analyst: set[str] = frozenset(), derived: set[str] = frozenset(), extractable: set[str] = frozenset()) -> dict[str, str]:
    """G1: the defaults with a carrier's own fields added, then those taken out that it calls extractable."""
    out = {f: "analyst_judgment" for f in {*ANALYST_JUDGMENT, *analyst}} | {f: "derived" for f in {*DERIVED, *derived}}
    return {f: out.get(f, "extractable") if f not in extractable else "extractable" for f in CATEGORY}


def extractability_by_carrier(carriers: DataFrame, overrides: DataFrame) -> DataFrame:
    """G1 for many carriers: carrier, field, kind. overrides: carrier, field, kind; a field that a carrier calls extractable is, whatever else is said."""
    spark = carriers.sparkSession
    fields = F.array(*(F.struct(F.lit(r["field"]).alias("field"), F.lit(r["extractability"]).alias("usual")) for r in field_catalogue(spark).collect()))
    said = overrides.groupBy("carrier", "field").agg(F.collect_set("kind").alias("said"))
    every = carriers.select("carrier").distinct().select("carrier", F.inline(fields)).join(said, ["carrier", "field"], "left")
    says = lambda k: F.coalesce(F.array_contains("said", k), F.lit(False))
    kind = F.when(says("extractable"), "extractable").when((F.col("usual") == "analyst_judgment") | says("analyst_judgment"), "analyst_judgment").when(says("derived"), "derived").otherwise(F.col("usual"))
    return every.select("carrier", "field", kind.alias("kind"))


# Which document type wins a field; others count UNLISTED.
UNLISTED = 5
PRIORITY: dict[str, dict[str, int]] = {
    "monthly_recurring_cost": {"invoice": 10, "subscription": 6, "csr": 5, "contract": 7, "report": 6},
    "cost_per_unit": {"invoice": 10, "subscription": 6, "csr": 5, "contract": 7},
    "quantity": {"invoice": 10, "subscription": 8, "csr": 7, "contract": 8},
    "phone_number": {"csr": 10, "invoice": 7, "did_list": 9},
    "btn": {"csr": 10, "invoice": 7},
    "usoc": {"csr": 10, "invoice": 3, "subscription": 4},
    "service_type": {"csr": 9, "invoice": 7, "subscription": 8, "contract": 6},
    "component_or_feature_name": {"csr": 9, "invoice": 7, "subscription": 8},
    "billing_name": {"csr": 10, "contract": 8, "invoice": 6, "subscription": 5},
    "service_address_1": {"csr": 10, "contract": 8, "invoice": 6, "subscription": 5},
    "service_address_2": {"csr": 10, "contract": 8, "invoice": 6, "subscription": 5},
    "city": {"csr": 10, "contract": 8, "invoice": 6, "subscription": 5},
    "state": {"csr": 10, "contract": 8, "invoice": 6, "subscription": 5},
    "zip": {"csr": 10, "contract": 8, "invoice": 6, "subscription": 5},
    "country": {"csr": 10, "contract": 8, "invoice": 6, "subscription": 5},
    "contract_term_months": {"contract": 10, "csr": 8, "subscription": 7, "email": 6},
    "contract_begin_date": {"contract": 10, "csr": 8, "subscription": 7, "email": 6},
    "contract_expiration_date": {"contract": 10, "csr": 8, "subscription": 7, "email": 6},
    "auto_renew": {"contract": 10, "csr": 7, "email": 6},
    "contract_number": {"contract": 10, "csr": 5},
    "carrier_circuit_number": {"csr": 10, "invoice": 8, "report": 7},
    "access_speed": {"csr": 9, "invoice": 8, "contract": 7},
    "port_speed": {"csr": 9, "invoice": 8},
}
# Base order of document types; others count 1.
BASE_ORDER = {"invoice": 10, "csr": 8, "contract": 7, "report": 6, "did_list": 5, "subscription": 5, "email": 3, "service_guide": 2}
# Fields that are the same in all rows of an account.
_TERMS_OF_ACCOUNT = [
    "contract_term_months", "contract_begin_date", "contract_expiration_date", "contract_number", "contract_number_2", "currently_month_to_month",
    "mtm_or_less_than_year", "billing_per_contract", "auto_renew", "auto_renewal_notes",
]
_PLACE = [
    "billing_name", "service_address_1", "service_address_2", "city", "state", "zip", "country",
]
ACCOUNT_FIELDS = [*_PLACE, "carrier_name", "master_account", "carrier_account_number", "invoice_file_name", "contract_file_name", "currency", *_TERMS_OF_ACCOUNT, "contract_info_received"]
ACCOUNT_ENRICHMENT = [*_TERMS_OF_ACCOUNT, "contract_file_name", *_PLACE, "carrier_name", "master_account", "currency"]
#: Rows that agree in all of these are the same row.
FINGERPRINT = [
    "carrier_name", "carrier_account_number", "sub_account_number_1", "phone_number", "row_type", "component_or_feature_name", "usoc", "charge_type",
    "monthly_recurring_cost",
]
