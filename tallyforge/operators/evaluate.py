"""Scoring an inventory against golden rows (J22-J25, E1-E4, A17-A19, P9). Rows are dicts of columns with a row id and row_seq."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as X
from ..schema import ACCOUNTS, CATEGORY, DATES, INTEGERS, MONEY, PHONES
from .graph import cut, numbered

ACCOUNT_LIKE = [*ACCOUNTS, "contract_number", "contract_number_2"]
AMOUNTS = [*MONEY, "rate", "ld_minutes"]
#: Rows that go to one task together, of all keys in one of so many buckets.
TOGETHER, BUCKETS = 100_000, 1 << 16


def comparable_rows(df: DataFrame, excluded_charges: Sequence[str] = ()) -> DataFrame:
    """Without excluded charge types, and without rows that have neither a charge type nor a row type."""
    c = lambda n: X.blank_to_null(F.col(n))
    out = df.filter(c("charge_type").isNotNull() | c("row_type").isNotNull())
    return out.filter(~F.upper(F.trim(F.coalesce("charge_type", F.lit("")))).isin([e.upper() for e in excluded_charges])) if excluded_charges else out


def match_key(strict: bool = True) -> Column:
    """account|sub-account|phone, and strictly also charge, row type and code."""
    acct = X.match_account(F.col("carrier_account_number"))
    phone = X.match_phone(F.coalesce(F.nullif("phone_number", F.lit("")), "btn"))
    phone = F.when((F.length(phone) == 7) & (F.length(acct) >= 3), F.concat(F.left(acct, F.lit(3)), phone)).otherwise(phone)
    parts = [acct, X.match_account(F.col("sub_account_number_1")), phone]
    if strict:
        parts += [X.charge_bucket(F.col("charge_type")), X.row_bucket(F.col("service_or_component"), F.col("row_type")), F.lower(F.trim(F.coalesce("usoc", F.lit(""))))]
    return F.concat_ws("|", *parts)


def candidate_keys() -> Column:
    """account|phone for every account a row names."""
    acct = F.array_distinct(F.filter(F.array(*(X.match_account(F.col(f)) for f in ("carrier_account_number", "sub_account_number_1", "sub_account_number_2"))), lambda a: a != ""))
    acct = F.when(F.size(acct) == 0, F.array(F.lit(""))).otherwise(acct)
    phone = X.match_phone(F.coalesce(F.nullif("phone_number", F.lit("")), "btn"))
    return F.transform(acct, lambda a: F.concat(a, F.lit("|"), F.when((F.length(phone) == 7) & (F.length(a) >= 3), F.concat(F.left(a, F.lit(3)), phone)).otherwise(phone)))


def pair_in_order(golden: DataFrame, extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """golden_id, extracted_id: the n-th row of a key with the n-th. A key may hold any share of the rows (numbered)."""
    both = golden.select(*keys, "row_seq", "row_id", F.lit("g").alias("side")).unionByName(extracted.select(*keys, "row_seq", "row_id", F.lit("e").alias("side")))
    at = numbered(both, [*keys, "side"], ("row_seq", "row_id"))
    golden_rows = at.filter("side = 'g'").select(*keys, "n", F.col("row_id").alias("golden_id"))
    return golden_rows.join(at.filter("side = 'e'").select(*keys, "n", F.col("row_id").alias("extracted_id")), [*keys, "n"]).select("golden_id", "extracted_id")


def content_steps() -> list[Column]:
    """By name as written, name with words apart, amount, charge, then in order."""
    name = F.coalesce("component_or_feature_name", F.lit(""))
    return [F.nullif(F.lower(F.trim(name)), F.lit("")), F.nullif(X.camel_split(name), F.lit("")), F.col("monthly_recurring_cost").cast("string"), X.charge_bucket(F.col("charge_type")), F.lit("any")]


def pair_by_content(rows: DataFrame, key: str, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """Rows have side (g, e), row_id, row_seq, the key and content_steps as _by0 and on. Within a key, step by step, the n-th row of a side
    that is left pairs with the n-th of the other; each row once. Pairs (golden_id, extracted_id), and the rows that are left.

    Keys are counted in BUCKETS: where those of a bucket have at most `together` rows, all rows of a key move to one task, once. Others
    are numbered by ranges, so a key may hold any share of the rows."""
    rows = rows.filter(F.col(key).isNotNull()).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    many = [r["_bucket"] for r in rows.groupBy("_bucket").count().filter(F.col("count") > together).collect()]
    made = cut(_paired_together(rows.filter(~F.col("_bucket").isin(many)), key).drop("_bucket"))
    pairs = made.filter("side = 'g' and extracted_id is not null").select(F.col("row_id").alias("golden_id"), "extracted_id")
    rest = made.filter("extracted_id is null").drop("extracted_id")
    if many:
        more, left = _paired_by_ranges(rows.filter(F.col("_bucket").isin(many)).drop("_bucket"), key)
        pairs, rest = pairs.unionByName(more), rest.unionByName(left)
    return pairs, rest


def _paired_together(rows: DataFrame, key: str) -> DataFrame:
    """rows with extracted_id: of the pair that a row is in."""
    kept = rows.columns
    steps = [c for c in kept if c.startswith("_by")]
    rows = rows.repartition(key).select("*", F.lit(None).cast("int").alias("_step"), F.lit(None).cast("int").alias("_n"), F.lit(None).cast("string").alias("_by"))
    for i, by in enumerate(steps):
        group = Window.partitionBy(key, by, "_free")  # all windows begin with the key, so rows stay where they are
        sides = [F.count_if(F.col("side") == x).over(group) for x in "ge"]
        now = F.col("_free") & (F.col("_at") <= F.col("_least"))
        rows = rows.withColumn("_free", F.col("_step").isNull() & F.col(by).isNotNull())
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key, by, "_free", "side").orderBy("row_seq", "row_id"))).withColumn("_least", F.least(*sides))
        rows = rows.withColumns({"_n": F.when(now, F.col("_at")).otherwise(F.col("_n")), "_by": F.when(now, F.col(by)).otherwise(F.col("_by")), "_step": F.when(now, i).otherwise(F.col("_step"))})
    other = F.max(F.when(F.col("side") == "e", F.col("row_id"))).over(Window.partitionBy(key, "_step", "_by", "_n"))
    return rows.select(*kept, F.when(F.col("_step").isNotNull(), other).alias("extracted_id"))


def _paired_by_ranges(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    pairs = None
    for by in [c for c in rows.columns if c.startswith("_by")]:
        asked = rows.filter(F.col(by).isNotNull())
        own = cut(pair_in_order(asked.filter("side = 'g'"), asked.filter("side = 'e'"), [key, by]))
        pairs = own if pairs is None else pairs.unionByName(own)
        rows = cut(rows.join(_taken(own), ["side", "row_id"], "left_anti"))
    return pairs, rows


def _taken(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lit("g").alias("side"), F.col("golden_id").alias("row_id")).unionByName(pairs.select(F.lit("e").alias("side"), F.col("extracted_id").alias("row_id")))


def pair_by_any_account(golden: DataFrame, extracted: DataFrame) -> DataFrame:
    """golden_id, extracted_id: rows left over meet under any account they name. Keys are taken in the order in which golden rows first name
    them; at its turn a key pairs its free rows, the n-th with the n-th.

    In rounds: a key has its turn as soon as none of its free rows names an earlier key that is still waiting, so keys that share no rows
    go at once, and pairs are those of the order. The first key that waits always has its turn. State is a written table a round;
    rows of a key are numbered by ranges, so one key may hold any share of them."""
    named = lambda d, side: d.select(F.lit(side).alias("side"), "row_id", "row_seq", candidate_keys().alias("_names"))
    return _pair_named(named(golden, "g").unionByName(named(extracted, "e")))


def _pair_named(rows: DataFrame) -> DataFrame:
    """rows: side, row_id, row_seq, _names."""
    both = cut(rows.select("side", "row_id", "row_seq", F.posexplode("_names").alias("place", "k")))
    first = both.groupBy("k").agg(F.min(F.when(F.col("side") == "g", F.struct("row_seq", "row_id", "place"))).alias("turn"), F.count_if(F.col("side") == "e").alias("n"))
    waiting = cut(both.drop("place").join(first.filter("turn is not null and n > 0").drop("n"), "k"))
    pairs: DataFrame | None = None
    while not waiting.isEmpty():
        least = waiting.groupBy("side", "row_id").agg(F.min("turn").alias("least"))
        ready = waiting.join(least, ["side", "row_id"]).groupBy("k").agg(F.bool_and(F.col("turn") <= F.col("least")).alias("ready")).filter("ready").select("k")
        ready = cut(ready)
        turn = waiting.join(ready, "k", "left_semi")
        own = cut(pair_in_order(turn.filter("side = 'g'"), turn.filter("side = 'e'"), ["k"]))
        pairs = own if pairs is None else pairs.unionByName(own)
        waiting = cut(waiting.join(ready, "k", "left_anti").join(_taken(own), ["side", "row_id"], "left_anti"))
    return both.select(F.col("row_id").alias("golden_id"), F.col("row_id").alias("extracted_id")).limit(0) if pairs is None else pairs


def match_rows(golden: DataFrame, extracted: DataFrame, together: int = TOGETHER) -> DataFrame:
    """golden_id, extracted_id, pass_: strict keys, relaxed keys on what is left, any account on the rest. What the passes compare is made
    once, and each pass hands on what it left."""
    compared = lambda d, side: d.select(
        F.lit(side).alias("side"), "row_id", "row_seq", match_key().alias("_strict"), match_key(False).alias("_relaxed"), candidate_keys().alias("_names"), *(c.alias(f"_by{i}") for i, c in enumerate(content_steps())))
    rows = cut(compared(golden, "g").unionByName(compared(extracted, "e")))
    one, rows = pair_by_content(rows, "_strict", together)
    two, rows = pair_by_content(rows.drop("_strict"), "_relaxed", together)
    passes = [one, two, _pair_named(rows.select("side", "row_id", "row_seq", "_names"))]
    return reduce(DataFrame.unionByName, (p.withColumn("pass_", F.lit(i)) for i, p in enumerate(passes, 1)))


def compare(field: str, e: Column, g: Column, usoc_names: dict[str, str] | None = None) -> Column:
    """E1 for one field: CORRECT, PARTIAL, WRONG, MISSING, EXTRA or BOTH_EMPTY."""
    a, b = X.comparable(e), X.comparable(g)
    if field in PHONES:
        x, y = X.judge_phone(e), X.judge_phone(g)
        right = (x == y) | ((F.length(x) == 7) & (F.length(y) == 10) & y.endswith(x)) | ((F.length(y) == 7) & (F.length(x) == 10) & x.endswith(y))
        part = F.lit(False)
    elif field in ACCOUNT_LIKE:
        x, y = X.digits(a), X.digits(b)
        right, part = (x == y) | ((F.length(x) >= 10) & (F.length(y) >= 10) & (x.contains(y) | y.contains(x))), F.lit(False)
    elif field in AMOUNTS:
        right, part = F.abs(X.amount(e) - X.amount(g)) <= 0.01, F.lit(False)
    elif field in DATES:
        x, y = (F.coalesce(X.parsed_date(v).cast("string"), v) for v in (a, b))
        right, part = x == y, F.lit(False)
    elif field in INTEGERS:
        right, part = X.whole(e) == X.whole(g), F.lit(False)
    elif field == "carrier_name":
        right, part = X.carrier(e) == X.carrier(g), F.lit(False)
    else:
        x, y = (X.component_name(e, usoc_names), X.component_name(g, usoc_names)) if field == "component_or_feature_name" else (F.lower(a), F.lower(b))
        least = 4 if field == "component_or_feature_name" else 3
        right, part = x == y, (F.length(x) > least) & (F.length(y) > least) & (x.contains(y) | y.contains(x))
    return (
        F.when((a == "") & (b == ""), "BOTH_EMPTY").when(a == "", "MISSING").when(b == "", "EXTRA")
        .when(F.coalesce(right, F.lit(False)), "CORRECT").when(F.coalesce(part, F.lit(False)), "PARTIAL").otherwise("WRONG"))


def root_cause(field: str, score: Column, e: Column, g: Column) -> Column:
    """E1's reason for WRONG."""
    if field in AMOUNTS:
        why = F.when(X.amount(e).isNull() | X.amount(g).isNull(), "parsing_error").when(F.length(F.regexp_extract(X.comparable(g), r"\.(\d+)$", 1)) > 4, "calculation")
    elif field in INTEGERS:
        why = F.when(X.whole(e).isNull() | X.whole(g).isNull(), "parsing_error")
    elif field in PHONES or field in ACCOUNT_LIKE or field == "carrier_name":
        why = F.lit("normalization")
    else:
        why = F.lit("domain_error") if field == "component_or_feature_name" else F.lit(None).cast("string")
    return F.when(score == "WRONG", why)


def score_pairs(pairs: DataFrame, fields: Sequence[str], extractable: dict[str, str] | None = None, e: str = "e_", g: str = "g_") -> DataFrame:
    """Pairs with columns e_<field> and g_<field>: one row a pair and field: field, category, score, cause."""
    def one(f: str) -> Column:
        skip = (extractable or {}).get(f, "extractable") != "extractable"
        score = F.lit("SKIPPED") if skip else compare(f, F.col(f"{e}{f}"), F.col(f"{g}{f}"))
        return F.struct(F.lit(f).alias("field"), F.lit(CATEGORY.get(f, "fuzzy")).alias("category"), score.alias("score"), root_cause(f, score, F.col(f"{e}{f}"), F.col(f"{g}{f}")).alias("cause"))

    return pairs.select("golden_id", "extracted_id", F.explode(F.array(*map(one, fields))).alias("s")).select("golden_id", "extracted_id", "s.*")


def override(scores: DataFrame, judged: DataFrame) -> DataFrame:
    """A judge's verdicts (golden_id, field, verdict) lift WRONG to CORRECT or PARTIAL; nothing is lowered."""
    out = scores.join(judged, ["golden_id", "field"], "left")
    return out.withColumn("score", F.when((F.col("score") == "WRONG") & F.col("verdict").isin("CORRECT", "PARTIAL"), F.col("verdict")).otherwise(F.col("score"))).drop("verdict")


def _accuracy() -> Column:
    n = lambda s: F.count_if(F.col("score") == s)
    return terms.percent(n("CORRECT") + 0.5 * n("PARTIAL"), n("CORRECT") + n("PARTIAL") + n("WRONG") + n("MISSING"))


def category_accuracy(scores: DataFrame) -> DataFrame:
    """A17."""
    return scores.groupBy("category").agg(_accuracy().alias("accuracy"))


def worst_fields(scores: DataFrame, most: int = 15) -> DataFrame:
    """Lowest accuracy first, with the commonest cause."""
    causes = scores.filter("cause is not null").groupBy("field", "cause").agg(F.count("*").alias("n")).groupBy("field").agg(F.max_by("cause", F.struct("n", "cause")).alias("top_cause"))
    return scores.filter("score in ('CORRECT', 'PARTIAL', 'WRONG', 'MISSING')").groupBy("field").agg(_accuracy().alias("accuracy"), F.count("*").alias("scored")).join(causes, "field", "left").orderBy("accuracy", "field").limit(most)


def match_rate(golden: DataFrame, pairs: DataFrame) -> DataFrame:
    """A19."""
    return golden.agg(F.count("*").alias("golden")).crossJoin(pairs.agg(F.count("*").alias("matched"))).withColumn("match_rate", terms.percent(F.col("matched"), F.col("golden")))


def diagnostic_key() -> Column:
    """account|phone|kind of row|code: no sub-account, and a code for component rows only."""
    account = X.match_account(F.col("carrier_account_number"))
    phone = X.match_phone(F.coalesce(F.nullif("phone_number", F.lit("")), "btn"))
    kind = F.lower(F.trim(F.coalesce(F.nullif("service_or_component", F.lit("")), "row_type", F.lit(""))))
    kind = F.when(kind.isin("s", "c"), F.upper(kind)).when(kind.contains("t") | kind.contains("occ"), "T").otherwise("U")
    code = F.when(kind == "C", X.without_point_zero(F.lower(F.trim(F.coalesce("usoc", F.lit("")))))).otherwise("")
    padded = F.when((F.length(phone) == 7) & (F.length(account) >= 3), F.concat(F.left(account, F.lit(3)), phone)).otherwise(phone)
    return F.concat_ws("|", account, padded, kind, code)


def diagnostic_pairs(golden: DataFrame, extracted: DataFrame) -> DataFrame:
    """The weaker matcher: one pass, the first row of each side."""
    first = lambda d, name: d.groupBy(diagnostic_key().alias("k")).agg(F.min_by("row_id", "row_seq").alias(name))
    return first(golden, "golden_id").join(first(extracted, "extracted_id"), "k").select("golden_id", "extracted_id")


def diagnostic_compare(field: str, e: Column, g: Column) -> Column:
    """A field of such a pair. An account or contract that is part of the other one is right, whatever its length; other texts that are part of
    each other are partly right, likewise."""
    a, b = (X.without_point_zero(F.lower(F.trim(F.coalesce(v.cast("string"), F.lit(""))))) for v in (e, g))
    within = lambda x, y: x.contains(y) | y.contains(x)
    part = F.lit(False)
    if field in ("phone_number", "btn", "point_to_number"):
        x, y = X.match_phone(e.cast("string")), X.match_phone(g.cast("string"))
        right = (x == y) | ((F.length(x) == 7) & (F.length(y) == 10) & y.endswith(x)) | ((F.length(y) == 7) & (F.length(x) == 10) & x.endswith(y))
    elif field in (*ACCOUNT_LIKE, "master_account"):
        x, y = X.digits(e.cast("string")), X.digits(g.cast("string"))
        right = within(x, y)
    elif field in ("monthly_recurring_cost", "cost_per_unit", "mrc_per_currency", "ld_cost", "rate", "ld_flat_rate"):
        x, y = (F.bround(F.regexp_replace(v.cast("string"), r"[$,\s]", "").try_cast("decimal(30,8)"), 2) for v in (e, g))
        right = (a == b) | F.coalesce(F.abs(x - y) <= F.lit(0.01).cast("decimal(3,2)"), F.lit(False))
    elif field in DATES:
        x, y = (F.coalesce(X.parsed_date(v.cast("string")).cast("string"), F.trim(v.cast("string"))) for v in (e, g))
        right = x == y
    elif field in ("quantity", "contract_term_months", "num_calls"):
        right = X.whole(e.cast("string")) == X.whole(g.cast("string"))
    else:
        right, part = a == b, within(a, b)
    return (
        F.when((a == "") & (b == ""), "BOTH_EMPTY").when(a == "", "MISSING").when(b == "", "EXTRA")
        .when(F.coalesce(right, F.lit(False)), "CORRECT").when(F.coalesce(part, F.lit(False)), "PARTIAL").otherwise("WRONG"))


Judge = Callable[[DataFrame], DataFrame]
