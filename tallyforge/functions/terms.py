"""Column functions on dates and costs (F26-F28, F34, F35) and on nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_expired(expiration: Column, today: Column) -> Column:
    """strictly before."""
    return F.coalesce(expiration < today, F.lit(False))


def term_matches(begin: Column, months: Column, expiration: Column, tolerance: int = 31) -> Column:
    """F27."""
    return F.abs(F.datediff(F.add_months(begin, months), expiration)) <= tolerance


def months_remaining(expiration: Column, today: Column) -> Column:
    """whole months, none below zero."""
    return F.greatest(F.lit(0), (F.year(expiration) - F.year(today)) * 12 + F.month(expiration) - F.month(today))


def percent(part: Column, of: Column, places: int = 1) -> Column:
    """by halves away from zero; a binary .x5 may differ from other roundings in the last place."""
    return F.when(of > 0, F.round(part * 100.0 / of, places)).otherwise(F.lit(0.0))


# Dollars a million tokens, in and out, by tier.
TOKEN_PRICES = {"flash": (0.15, 0.60), "pro": (1.25, 5.00), "sonnet": (3.0, 15.0), "opus": (15.0, 75.0)}


def token_cost(tier: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """F35."""
    out = F.lit(0.0)
    for name, (a, b) in TOKEN_PRICES.items():
        out = F.when(tier == name, (tokens_in * a + tokens_out * b) / 1e6).otherwise(out)
    return out


def json_field(c: Column, path: str) -> Column:
    """F36."""
    return F.get_json_object(c, f"$.{path}")


def _balanced(c: Column, opening: str, closing: str) -> Column:
    """From the first opening bracket to the one that closes it, by counting; null without."""
    rest = F.substr(c, F.instr(c, opening))
    pieces = F.split(rest, rf"(?<=[\{opening}\{closing}])")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.when(piece.endswith(opening), 1).when(piece.endswith(closing), -1).otherwise(0)
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), F.when((s["end"] == 0) & (depth == 0), s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(pieces, begin, step, lambda s: s["end"])
    return F.when(c.contains(opening) & (end > 0), F.array_join(F.slice(pieces, F.lit(1), end), ""))


def salvaged_json(c: Column, schema: str = "array<map<string,string>>") -> Column:
    """the text itself, else what the first code fence holds, else from the first [ to the ] that closes it, else likewise with braces. An
    object alone is a list of one."""
    tries = [c, F.regexp_extract(c, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1), _balanced(c, "[", "]"), _balanced(c, "{", "}")]

    def good(s: Column) -> Column:
        bare = F.trim(s)
        listed = F.when(bare.startswith("{"), F.concat(F.lit("["), bare, F.lit("]"))).when(bare.startswith("["), bare)
        return F.when(F.try_parse_json(listed).isNotNull(), F.from_json(listed, schema))

    return F.coalesce(*(good(s) for s in tries))


def flags_json(flags: Column) -> Column:
    """F38."""
    return F.to_json(flags)


def flags_text(flags: Column) -> Column:
    """F39."""
    return F.array_join(F.transform(flags, lambda f: F.concat(F.lit("["), f["severity"], F.lit("] "), f["check"], F.lit(": "), f["message"])), "; ")
