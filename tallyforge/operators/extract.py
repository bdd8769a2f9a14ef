"""Rows as an extraction provider returns them, before they count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# What tells a line item from an account's total; sections without rows.
LINE_FIELDS = ["phone_number", "btn", "sub_account_number_1", "usoc", "service_type", "carrier_circuit_number", "quantity"]
DETAILED_NAME = 25
EMPTY_SECTIONS = ["index", "revenue amounts", "directory delivery"]


def is_line_item(df: DataFrame) -> Column:
    """A field of its own, or a detailed name."""
    kinds = dict(df.dtypes)
    own = [X.truthy(F.col(f), kinds[f] != "string") for f in LINE_FIELDS if f in kinds]
    return X.any_of(own) | (F.length(F.coalesce("component_or_feature_name", F.lit(""))) > DETAILED_NAME)


def keep_line_items(rows: DataFrame, section_type: str = "section_type") -> DataFrame:
    """Rows of scanned sections count only if they are line items."""
    return rows.filter(~F.coalesce(F.col(section_type) == "scanned", F.lit(False)) | is_line_item(rows))


def extractable(sections: DataFrame, section_type: str = "section_type") -> DataFrame:
    """P7."""
    return sections.filter(~F.coalesce(F.col(section_type).isin(EMPTY_SECTIONS), F.lit(False)))


def without_unavailable(rows: DataFrame, unavailable: Mapping[str, Sequence[str]], variant: str = "format_variant") -> DataFrame:
    """Unavailable: format -> fields that its documents can't tell; they are null there, but for contracts."""
    of: dict[str, list[str]] = {}
    for name, fields in unavailable.items():
        for f in fields:
            of.setdefault(f, []).append(name)
    blank = lambda f: F.when(F.col(variant).isin(of[f]) & ~F.coalesce(F.col("doc_type") == "contract", F.lit(False)), None).otherwise(F.col(f))
    return rows.withColumns({f: blank(f) for f in of if f in rows.columns})
