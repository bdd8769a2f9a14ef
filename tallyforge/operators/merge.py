"""Merging the rows of several documents into one inventory.

Every rule that takes "the first" orders by (doc_seq, row_seq). Groups are keyed by account and line, so aggregates combine before
the shuffle; only the greedy clustering of service rows (J4) needs a whole group in one place, and a group is one line's rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import normalize
from ..schema import ACCOUNT_ENRICHMENT, ACCOUNT_FIELDS, ACCOUNTS, BASE_ORDER, FIELDS, PHONES, PRIORITY, UNLISTED
from .graph import connected, cut

SEQ = ("doc_seq", "row_seq")


def merge_key(with_sub_account: bool = True, canonical: int | None = None, check_digit: bool = False, pad: bool = False) -> Column:
    """account|sub-account|phone or btn; what is missing is left out; rows without any stand alone."""
    acct = lambda c: X.account(X.blank_to_null(F.col(c)), canonical, check_digit)
    phone = X.padded_phone(F.col("phone_number"), F.col("carrier_account_number")) if pad else X.digits(F.col("phone_number"))
    line = F.when(X.truthy(F.col("phone_number")), phone).when(X.truthy(F.col("btn")), X.digits(F.col("btn")))
    parts = [acct("carrier_account_number"), *([acct("sub_account_number_1")] if with_sub_account else []), line]
    key = F.concat_ws("|", *parts)
    return F.when(F.coalesce(*parts).isNull(), F.concat(F.lit("unkeyed_"), F.col("doc_id"), F.lit("_"), F.col("row_seq"))).otherwise(key)


def split_accounts(df: DataFrame, column: str = "carrier_account_number") -> DataFrame:
    """A contract's or subscription's row with several accounts becomes one row for each that has seven digits."""
    parts = F.filter(F.transform(F.split(F.col(column), r"(?i)\s*(?:&|/|,|;|\band\b)\s*"), lambda p: F.trim(p)), lambda p: F.length(X.digits(p)) >= 7)
    several = F.lower("doc_type").isin("contract", "subscription") & (F.size(parts) > 1)
    return df.withColumn(column, F.explode(F.when(several, parts).otherwise(F.array(column))))


def priority(field: str, doc_type: Column, overrides: dict[str, dict[str, int]] | None = None) -> Column:
    own = PRIORITY.get(field, {}) | (overrides or {}).get(field, {})
    out = F.lit(UNLISTED)
    for kind, p in own.items():
        out = F.when(doc_type == kind, p).otherwise(out)
    return out


def base_order(doc_type: Column, overrides: dict[str, int] | None = None) -> Column:
    """J36."""
    out = F.lit(1)
    for kind, p in (BASE_ORDER | (overrides or {})).items():
        out = F.when(doc_type == kind, p).otherwise(out)
    return out


def completeness(fields: Sequence[str]) -> Column:
    """A23."""
    return sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))


def merge_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str], overrides: dict | None = None, bases: dict[str, int] | None = None) -> DataFrame:
    """One row a group. The base is the row of the document type that leads (of one type: the fullest row). A field takes the last
    row's value, in that order, whose priority is above the base document's; else the base's; else the first there is.

    Only the base's priority counts, not that of the row whose value stands: as observed (Q-1). Two aggregates and a join in between: the
    first, of a few columns, tells each group's base document; the second takes the values where the join has brought a group's rows. So
    rows move once, as they are: three values with their order for each field are several times a row. Aggregates hold a row a
    group, so one group may hold any share of the rows."""
    order = F.struct((-base_order(F.col("doc_type"), bases)).alias("o"), "doc_seq", "row_seq")
    one = F.struct(*keys)  # as one value, nulls are equal to nulls, and joined rows lie as the second aggregate needs them
    base = df.groupBy(one.alias("_of")).agg((F.min("doc_type") == F.max("doc_type")).alias("_one"), F.min_by("doc_type", order).alias("_base"))
    keyed = df.select(one.alias("_keys"), *(c for c in df.columns if c not in keys or c in fields))
    rows = keyed.join(base.hint("merge"), F.col("_keys") == F.col("_of")).drop("_of")
    lead = F.when(F.col("_one"), completeness(fields)).otherwise(base_order(F.col("doc_type"), bases))
    ranked = rows.withColumn("_at", F.struct((-lead).alias("lead"), "doc_seq", "row_seq"))
    aggs = []
    for f in fields:
        value, own, led = F.col(f), priority(f, F.col("doc_type"), overrides), priority(f, F.col("_base"), overrides)
        wins = value.isNotNull() & (F.col("doc_type") != F.col("_base")) & (own > led)
        aggs.append(F.coalesce(F.max_by(value, F.when(wins, F.col("_at"))), F.min_by(value, F.col("_at")), F.min_by(value, F.when(value.isNotNull(), F.col("_at")))).alias(f))
    made = ranked.groupBy("_keys").agg(
        F.min_by("doc_id", "_at").alias("doc_id"), F.min_by("doc_type", "_at").alias("doc_type"), F.min("doc_seq").alias("doc_seq"), F.min_by("row_seq", F.struct("doc_seq", "row_seq")).alias("row_seq"), F.count("*").alias("merged_rows"), *aggs)
    return made.select("_keys.*", *made.columns[1:])


def _all_of(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def equivalent(field: str, a: Column, b: Column) -> Column:
    """Values that differ in form only."""
    if field in ACCOUNTS or field in PHONES:
        return X.digits(a) == X.digits(b)
    return X.name_key(a) == X.name_key(b) if field == "carrier_name" else F.lit(False)


def conflicts(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """J34 (emission): values of other kinds of documents that differ from the base's at the same priority."""
    w = Window.partitionBy(*keys).orderBy(F.desc(base_order(F.col("doc_type"))), "doc_seq", "row_seq")
    ranked = df.withColumn("_at", F.row_number().over(w))
    cols = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), priority(f, F.col("doc_type")).alias("p")) for f in fields))
    long = ranked.select(*keys, "_at", "doc_id", "doc_type", F.explode(cols).alias("v")).select(*keys, "_at", "doc_id", "doc_type", "v.*").filter("value is not null")
    base = long.filter("_at = 1").select(*keys, "field", F.col("value").alias("value_a"), F.col("doc_type").alias("source_a"), F.col("doc_id").alias("doc_a"), F.col("p").alias("pa"))
    other = long.filter("_at > 1").select(*keys, "field", F.col("value").alias("value_b"), F.col("doc_type").alias("source_b"), F.col("doc_id").alias("doc_b"), F.col("p").alias("pb"))
    same = X.any_of([(F.col("field") == f) & equivalent(f, F.col("value_a"), F.col("value_b")) for f in fields if f in (*ACCOUNTS, *PHONES, "carrier_name")])
    found = base.join(other, [*keys, "field"]).filter((F.col("value_a") != F.col("value_b")) & (F.col("source_a") != F.col("source_b")) & (F.col("pa") == F.col("pb")) & ~F.coalesce(same, F.lit(False)))
    return found.drop("pa", "pb").withColumn("conflict_id", F.sha2(F.concat_ws("|", *keys, "field", "doc_a", "doc_b"), 256))


def resolve(conflicts_: DataFrame, picks: DataFrame) -> DataFrame:
    """J34 (write-back): picks: conflict_id, pick 'a' or 'b'. Unknown ids are ignored, unresolved conflicts keep a."""
    return conflicts_.join(picks, "conflict_id", "left").withColumn("resolved", F.when(F.lower("pick") == "b", F.col("value_b")).otherwise(F.col("value_a")))


def apply_picks(merged: DataFrame, conflicts_: DataFrame, picks: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """J34 (write-back into rows): merged rows with the picked values of their conflicts; conflicts that nobody decided leave the row as the rules
    made it. Of several decided conflicts of one key and field, the one with the last document of side b counts. Picks of unknown ids do nothing.

    One patch a key, no larger than the record, and one join: rows aren't exploded."""
    decided = resolve(conflicts_, picks.groupBy("conflict_id").agg(F.max("pick").alias("pick"))).filter(F.col("pick").isNotNull() & F.col("field").isin(*fields))
    last = decided.groupBy(*keys, "field").agg(F.max_by("resolved", F.struct("doc_b", "conflict_id")).alias("value"))
    patch = last.groupBy(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys))).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_patch"))
    kinds = dict(merged.dtypes)
    patched = merged.join(patch, _all_of([F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]), "left")
    return patched.withColumns({f: F.coalesce(F.col("_patch")[f].cast(kinds[f]), F.col(f)) for f in fields}).select(*merged.columns)


def cluster_services(df: DataFrame, key: str, least_share: float = 0.6) -> DataFrame:
    """Number rows of a merge key by service: each joins the first cluster whose first row is the same service.

    Same: no two service types; equal codes where both have one; else equal names, or one beginning with the other and at least the share
    of its length. Greedy and not transitive, so rows of a key are taken in order in one place."""
    asked = [F.col(key).alias("_key"), X.service_name(F.col("component_or_feature_name")).alias("_name"), F.lower(F.trim(F.coalesce("service_type", F.lit("")))).alias("_type"), F.lower(F.trim(F.coalesce("usoc", F.lit("")))).alias("_code")]
    ready = df.repartition(key).sortWithinPartitions(key, *SEQ).select(*df.columns, *asked)

    def same(a: tuple, b: tuple) -> bool:
        if a[1] and b[1] and a[1] != b[1]:
            return False
        if a[2] and b[2]:
            return a[2] == b[2]
        short, long = sorted((a[0], b[0]), key=len)
        return bool(short) and (short == long or len(short) >= len(long) * least_share and long.startswith(short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, firsts = None, []  # rows of a key come one after the other; only its clusters' first rows are kept
        for batch in batches:
            out = []
            for k, *me in zip(*(c.to_pylist() for c in batch.columns[-4:])):
                if k != now:
                    now, firsts = k, []
                at = next((i for i, f in enumerate(firsts) if same(me, f)), len(firsts))
                if at == len(firsts):
                    firsts.append(me)
                out.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(out, pa.int32())], names=[*batch.schema.names[:-4], "cluster"])

    return ready.mapInArrow(run, T.StructType([*df.schema, T.StructField("cluster", T.IntegerType())]))


def component_key() -> Column:
    """What makes component rows of a merge key the same."""
    return F.concat_ws("|", F.lower(F.trim(F.coalesce("usoc", F.lit("")))), X.service_name(F.col("component_or_feature_name")))


def fill_first(df: DataFrame, group: Sequence[str], fields: Sequence[str], source: Column | None = None) -> DataFrame:
    """Blanks of a group take the first value that isn't blank, in order, of rows that may give one. First values are aggregated by
    group, combined before the shuffle, and joined to the rows; a group may hold any share of them."""
    kinds = dict(df.dtypes)
    value = lambda f: X.blank_to_null(F.col(f)) if kinds[f] == "string" else F.col(f)
    given = lambda f: F.when(source, value(f)) if source is not None else value(f)
    first = df.groupBy(*group).agg(*(F.min_by(given(f), F.when(given(f).isNotNull(), F.struct(*SEQ))).alias(f"_first_{f}") for f in fields))
    first = first.select(*(F.col(g).alias(f"_group_{i}") for i, g in enumerate(group)), *(f"_first_{f}" for f in fields))
    out = df.join(first, _all_of([F.col(g).eqNullSafe(F.col(f"_group_{i}")) for i, g in enumerate(group)]), "left")
    return out.select(*(F.coalesce(value(c), F.col(f"_first_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns))


def propagate_location(df: DataFrame, key: str = "merge_key") -> DataFrame:
    """Service rows give their place to the other rows of the line."""
    return fill_first(df, [key], ["service_address_1", "service_address_2", "city", "state", "zip"], (F.col("service_or_component") == "S") | (F.col("row_type") == "S"))


def propagate_account(df: DataFrame, group: str = "account_group", fields: Sequence[str] = ACCOUNT_FIELDS) -> DataFrame:
    """J7, and N11's second turn: account-level fields, then the country from the zip code."""
    out = fill_first(df, [group], [f for f in fields if f in df.columns])
    return with_country(out)


def with_country(df: DataFrame) -> DataFrame:
    """the country from the zip code, where it is blank."""
    return df.withColumn("country", F.coalesce(X.blank_to_null(F.col("country")), X.country_of(F.col("zip")))) if {"country", "zip"} <= set(df.columns) else df


def prefix_bridge(keys: DataFrame, column: str = "account") -> DataFrame:
    """Key, target: a key of seven digits or more moves to the longest one that it begins. keys: column, first_seen.

    Each key is spread to its beginnings of seven digits or more, so the join is one of equals."""
    digit = keys.filter(F.col(column).rlike("^[0-9]{7,}$")).select(F.col(column).alias("key"), "first_seen")
    sizes = F.sequence(F.lit(7), F.length("key") - 1)
    longer = digit.filter(F.length("key") > 7).select(F.col("key").alias("long"), F.col("first_seen").alias("seen"), F.explode(F.transform(sizes, lambda n: F.left(F.col("key"), n))).alias("head"))
    found = digit.select("key").join(longer, F.col("key") == F.col("head"))
    return found.groupBy("key").agg(F.max_by("long", F.struct(F.length("long"), -F.col("seen"))).alias("target"))


def account_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Id, root for accounts that occur in one row (edges: a, b as strings). The root is the shortest, then the least, account of the
    component; the reference's depends on the order of its unions (Q-5), ours doesn't."""
    return connected(edges, max_rounds)


def tiered_key(equivalent_accounts: Column | None = None) -> tuple[Column, Column]:
    """The key and its tier: 1 account and line, 2 account and circuit or service type, 3 account, 0 none."""
    d = lambda c: F.nullif(X.digits(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    acct = F.coalesce(d("sub_account_number_1"), d("carrier_account_number")) if equivalent_accounts is None else equivalent_accounts
    line, circuit, service = F.coalesce(d("phone_number"), d("btn")), X.blank_to_null(F.col("carrier_circuit_number")), F.upper(X.blank_to_null(F.col("service_type")))
    whole = F.upper(F.trim(F.coalesce("service_or_component", F.lit("")))).isin("S", "")
    tier = F.when(acct.isNull(), 0).when(line.isNotNull(), 1).when(circuit.isNotNull() | (service.isNotNull() & whole), 2).otherwise(3)
    key = (
        F.when(acct.isNull(), F.concat(F.lit("unkeyed_"), F.col("doc_id"), F.lit("_"), F.col("row_seq"))).when(line.isNotNull(), F.concat_ws("|", acct, line))
        .when(circuit.isNotNull(), F.concat(acct, F.lit("|cir:"), circuit)).when(service.isNotNull() & whole, F.concat(acct, F.lit("|svc:"), service)).otherwise(acct)
    )
    return key, tier


def enrich(target: DataFrame, source: DataFrame, fields: Sequence[str], account_fields: Sequence[str] = ACCOUNT_ENRICHMENT) -> DataFrame:
    """Blanks of a target take the source's value: any field where the line or circuit agrees, account-level fields where the account
    does; the most specific, then the document of highest priority, then the first wins. Both need tier_key, tier, account."""
    # one pass over the source: the best value of each key, from which the accounts' best follow
    order = lambda f: F.struct(priority(f, F.col("doc_type")).alias("p"), (-F.col("doc_seq")).alias("d"), (-F.col("row_seq")).alias("r"), F.col(f).alias("v"))
    by_key = cut(source.groupBy("tier_key").agg(F.max("tier").alias("tier"), F.max("account").alias("account"), *(F.max(F.when(F.col(f).isNotNull(), order(f))).alias(f) for f in fields)))
    fine = by_key.filter("tier in (1, 2)").select("tier_key", *(F.col(f)["v"].alias(f"_f_{f}") for f in fields))
    wide = [f for f in fields if f in account_fields]
    coarse = by_key.filter("account is not null").groupBy("account").agg(*(F.max(f)["v"].alias(f"_a_{f}") for f in wide)) if wide else by_key.select("account").limit(0)
    # accounts' values go to the keys of these accounts, so that rows move once, by key, and meet both there
    keys = target.filter("account is not null").select("tier_key", "account").distinct().join(coarse, "account").withColumnsRenamed({"tier_key": "_key", "account": "_account"})
    same = F.coalesce(F.col("account") == F.col("_account"), F.lit(False))  # no key of the join
    out = target.join(fine, "tier_key", "left").join(keys, (F.col("tier_key") == F.col("_key")) & same, "left")
    kinds = dict(target.dtypes)

    def filled(f: str) -> Column:
        blank = X.blank_to_null(F.col(f)) if kinds[f] == "string" else F.col(f)
        return F.coalesce(blank, F.col(f"_f_{f}"), *([F.col(f"_a_{f}")] if f in wide else []), F.col(f))

    return out.withColumns({f: filled(f) for f in fields}).select(*target.columns)


def append_supplemental(merged: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of other documents whose key isn't the line or service (tiers 1 and 2) of a row of the inventory; rows without such a key
    are new, too."""
    known = merged.filter("tier in (1, 2)").select("tier_key").distinct()
    return merged.unionByName(other.join(known, "tier_key", "left_anti"), allowMissingColumns=True)


@dataclass
class MergeRules:
    """How a carrier's documents are merged."""

    roles: dict[str, str] = field(default_factory=dict)  # document type -> base, enrichment or supplemental; base if not named
    canonical: int | None = None  # digits of an account
    check_digit: bool = False
    with_sub_account: bool = True
    pad_phones: bool = False
    equivalence: list[str] = field(default_factory=lambda: ["carrier_account_number", "master_account"])  # accounts of one row in these are one account
    base_order: dict[str, int] = field(default_factory=dict)
    priorities: dict[str, dict[str, int]] = field(default_factory=dict)
    non_propagating: list[str] = field(default_factory=list)
    extra_propagation: list[str] = field(default_factory=list)


def propagate(df: DataFrame, rules: MergeRules) -> DataFrame:
    """J7 with a carrier's fields, over bridged accounts (J8). First values are taken an account, then a bridged group, and come back by the row's
    own account: rows themselves move once, to meet them."""
    fields = list(dict.fromkeys(f for f in (*ACCOUNT_FIELDS, *rules.extra_propagation) if f not in rules.non_propagating and f in df.columns))
    kinds = dict(df.dtypes)
    value = lambda f: X.blank_to_null(F.col(f)) if kinds[f] == "string" else F.col(f)
    acct = X.account(F.coalesce("carrier_account_number", F.lit("")), rules.canonical, rules.check_digit)
    rows = cut(df.withColumn("account_group", acct))
    firsts = cut(rows.groupBy(F.col("account_group").alias("_account")).agg(
        F.min(F.col("doc_seq").cast("long") * 4_294_967_296 + F.col("row_seq")).alias("first_seen"), *(F.min(F.when(value(f).isNotNull(), F.struct(*SEQ, value(f).alias("v")))).alias(f) for f in fields)))
    moves = cut(prefix_bridge(firsts.select(F.col("_account").alias("account"), "first_seen")).select(F.col("key").alias("_account"), F.col("target").alias("_group")))
    grouped = firsts.select("_account", *fields).join(moves, "_account", "left").withColumn("_group", F.coalesce("_group", "_account"))
    best = grouped.groupBy("_group").agg(*(F.min(f)["v"].alias(f"_first_{f}") for f in fields))
    own = grouped.select("_account", "_group").join(best, "_group").drop("_group")
    out = rows.join(own, F.col("account_group").eqNullSafe(F.col("_account")), "left")
    out = out.select(*(F.coalesce(value(c), F.col(f"_first_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns))
    return with_country(out)


def _prepared(df: DataFrame, rules: MergeRules) -> DataFrame:
    """Accounts split, merge keys, and item: what makes rows of a key one."""
    keyed = split_accounts(df).withColumn("merge_key", merge_key(rules.with_sub_account, rules.canonical, rules.check_digit, rules.pad_phones))
    is_service = (F.col("service_or_component") == "S") | (F.col("row_type") == "S")
    services = cluster_services(keyed.filter(is_service), "merge_key").withColumn("item", F.concat(F.lit("S"), F.col("cluster"))).drop("cluster")
    rest = keyed.filter(~F.coalesce(is_service, F.lit(False))).withColumn("item", F.when((F.col("service_or_component") == "C") | (F.col("row_type") == "C"), F.concat(F.lit("C"), component_key())).otherwise(F.concat_ws("_", F.lit("O"), "doc_id", "row_seq")))
    return cut(services.unionByName(rest))  # written out, so plans stay small


def merge_same_granularity(df: DataFrame, fields: Sequence[str] = FIELDS, rules: MergeRules | None = None) -> DataFrame:
    """Split accounts, key, merge what is the same service or component, give places along the line and terms along the account."""
    rules = rules or MergeRules()
    return _merge_prepared(_prepared(df, rules), [f for f in fields if f in df.columns], rules)


def _merge_prepared(prepared: DataFrame, fields: Sequence[str], rules: MergeRules) -> DataFrame:
    merged = cut(merge_fields(prepared, ["merge_key", "item"], fields, rules.priorities, rules.base_order))
    return propagate(propagate_location(merged), rules)


def merge_documents(df: DataFrame, roles: dict[str, str] | None = None, fields: Sequence[str] = FIELDS, rules: MergeRules | None = None, normal: normalize.Rules | None = None, today: Column | None = None) -> DataFrame:
    """Rules that make rows uniform before (N1-N3); documents of the role 'base' are merged row by row, 'enrichment' ones fill
    blanks, 'supplemental' ones add what is missing; account-level fields spread; then the rules for values (N4-N14), which may blank
    some, and the fields spread again. Roles default to base."""
    return merge_with_conflicts(df, roles, fields, rules, normal, today)[0]


def merge_with_conflicts(df: DataFrame, roles: dict[str, str] | None = None, fields: Sequence[str] = FIELDS, rules: MergeRules | None = None, normal: normalize.Rules | None = None, today: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged rows, and the conflicts among the base documents' (J34). Base rows are split, keyed and written once; conflicts cost nothing
    until they are read."""
    rules = rules or MergeRules()
    roles = rules.roles if roles is None else roles
    role = F.lit("base")
    for kind, r in roles.items():
        role = F.when(F.col("doc_type") == kind, r).otherwise(role)
    rows = cut((normalize.before_merge(df, normal) if normal else df).withColumn("_role", role))
    fields = [f for f in fields if f in df.columns]
    digits = lambda c: F.nullif(X.digits(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    same = [f for f in rules.equivalence if f in df.columns]
    links = [rows.select(digits(same[0]).alias("a"), digits(f).alias("b")) for f in same[1:]]
    roots = account_components(reduce(DataFrame.unionAll, links)) if links else None

    def keyed(d: DataFrame) -> DataFrame:
        acct = F.coalesce(digits("sub_account_number_1"), digits("carrier_account_number"))
        out = d.withColumn("account", acct)
        if roots is not None:
            out = out.join(roots.select(F.col("id").alias("account"), "root"), "account", "left").withColumn("account", F.coalesce("root", "account")).drop("root")
        key, tier = tiered_key(F.col("account"))
        return out.withColumn("tier_key", key).withColumn("tier", tier)

    prepared = _prepared(rows.filter("_role = 'base'").drop("_role"), rules)
    base = keyed(_merge_prepared(prepared, fields, rules).drop("merge_key", "item"))
    extra = keyed(rows.filter("_role = 'enrichment'").drop("_role"))
    more = keyed(rows.filter("_role = 'supplemental'").drop("_role"))
    out = propagate(append_supplemental(enrich(cut(base), extra, fields), more), rules)  # written there
    if normal:
        out = propagate(normalize.after_merge(out, normal, today if today is not None else F.current_date()), rules)
    return out, conflicts(prepared, ["merge_key", "item"], fields)


# The columns that name an identifier, by its type.
IDENTIFIERS = {"account": "carrier_account_number", "btn": "btn", "phone": "phone_number"}


def _identifiers(rows: DataFrame, kinds: Mapping[str, str]) -> Column:
    """Structs of rank, identifier_type, identifier that a row has, digits only."""
    each = [F.struct(F.lit(i).alias("rank"), F.lit(k).alias("identifier_type"), F.nullif(X.digits(F.coalesce(F.col(c), F.lit(""))), F.lit("")).alias("identifier")) for i, (k, c) in enumerate(kinds.items()) if c in rows.columns]
    return F.filter(F.array(*each), lambda s: s["identifier"].isNotNull())


def known_accounts(rows: DataFrame, known: DataFrame, kinds: Mapping[str, str] = IDENTIFIERS) -> DataFrame:
    """Known: identifier, identifier_type, carrier (of several, the least). A hit is certain; of a row's identifiers the first type that is known
    counts. One join of equals for each type."""
    hit = known.filter("carrier is not null").groupBy("identifier_type", "identifier").agg(F.min("carrier").alias("_carrier"))
    out, found = rows, []
    for i, (kind, column) in enumerate((k, c) for k, c in kinds.items() if c in rows.columns):
        own = hit.filter(F.col("identifier_type") == kind).select(F.col("identifier").alias(f"_id_{i}"), F.col("_carrier").alias(f"_carrier_{i}"))
        out = out.join(own, X.digits(F.col(column)) == F.col(f"_id_{i}"), "left").drop(f"_id_{i}")
        found.append(f"_carrier_{i}")
    out = out.withColumn("known_carrier", F.coalesce(*found, F.lit(None).cast("string"))).drop(*found)
    return out.withColumn("confidence", F.when(F.col("known_carrier").isNotNull(), "high").otherwise(F.col("confidence"))) if "confidence" in rows.columns else out


def learn_accounts(known: DataFrame, rows: DataFrame, kinds: Mapping[str, str] = IDENTIFIERS) -> DataFrame:
    """J33 (learn-back): identifiers of every type, of rows with high or medium confidence, that aren't known yet; the least carrier counts."""
    new = rows.filter("confidence in ('high', 'medium')").select(F.inline(_identifiers(rows, kinds)), F.col("carrier_name").alias("carrier")).filter("carrier is not null")
    new = new.groupBy("identifier", "identifier_type").agg(F.min("carrier").alias("carrier"))
    return known.select("identifier", "identifier_type", "carrier").unionByName(new.join(known, ["identifier", "identifier_type"], "left_anti"))
