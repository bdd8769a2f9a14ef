"""Inventory queries: orders stand for billing rows. INVENTORY is one SELECT that both engines read, so a query and its SQL start equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as X
from ..operators import classify, evaluate, feedback, lifecycle, marts, merge, normalize, quality
from ..schema import PRIORITY
from .catalogue import query, table

TODAY = "1998-01-01"
INVENTORY = """
SELECT o_orderkey AS row_id, 'doc' || cast(o_orderkey % 40 AS string) AS doc_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'csr' WHEN 2 THEN 'contract' ELSE 'subscription' END AS doc_type,
  cast(o_orderkey % 40 AS int) AS doc_seq, cast(o_orderkey AS int) AS row_seq, 'up' || cast(o_custkey % 30 AS string) AS upload_id,
  CASE o_custkey % 6 WHEN 0 THEN 'AT&T Ohio' WHEN 1 THEN 'Charter Communications' WHEN 2 THEN 'windstream' WHEN 3 THEN 'Peerless Network' WHEN 4 THEN 'Zeta Telco' END AS carrier_name,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '614-' || lpad(cast(o_custkey % 500 AS string), 3, '0') || '-' || lpad(cast(o_custkey AS string), 5, '0') || CASE WHEN o_orderkey % 3 = 0 THEN '-152' ELSE '' END END AS carrier_account_number,
  CASE WHEN o_orderkey % 5 = 0 THEN '9' || lpad(cast(o_custkey AS string), 8, '0') END AS sub_account_number_1,
  CASE WHEN o_orderkey % 13 = 0 THEN '8' || lpad(cast(o_custkey AS string), 8, '0') END AS master_account,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '555' || lpad(cast(o_custkey % 10000 AS string), 4, '0') WHEN 2 THEN 'ext. 12' ELSE '(614) 555-' || lpad(cast(o_custkey % 10000 AS string), 4, '0') END AS phone_number,
  CASE WHEN o_orderkey % 14 = 0 THEN '614.555.0100' END AS btn, CASE WHEN o_orderkey % 17 = 0 THEN '6145550199' END AS point_to_number,
  CASE WHEN o_orderkey % 6 = 0 THEN '12/KQXX/' || lpad(cast(o_custkey AS string), 6, '0') || '/000/LEC' END AS carrier_circuit_number,
  CASE o_orderkey % 5 WHEN 0 THEN 'Voice' WHEN 1 THEN 'Internet' WHEN 2 THEN 'POTS Line' WHEN 3 THEN '' END AS service_type,
  CASE o_orderkey % 4 WHEN 0 THEN '1MB' WHEN 1 THEN 'ESX' WHEN 2 THEN 'esx ' END AS usoc,
  CASE o_orderkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'C' ELSE '' END AS service_or_component, CASE o_orderkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'C' WHEN 2 THEN 'T' END AS row_type,
  CASE o_orderkey % 6 WHEN 0 THEN 'BusLocalCalling' WHEN 1 THEN 'Monthly Fee - Qty 3' WHEN 2 THEN ' monthly  fee ' WHEN 3 THEN 'Three-Way Calling' WHEN 4 THEN 'ESX' END AS component_or_feature_name,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE cast((o_orderkey % 97700) / 100.0 AS decimal(12,2)) END AS monthly_recurring_cost,
  cast(o_orderkey % 4 AS int) AS quantity, CASE WHEN o_orderkey % 4 = 1 THEN cast((o_orderkey % 97700) / 100.0 AS decimal(12,2)) ELSE cast((o_orderkey % 4000) / 100.0 AS decimal(12,2)) END AS cost_per_unit,
  CASE o_orderkey % 7 WHEN 0 THEN 'MRC' WHEN 1 THEN 'Recurring' WHEN 2 THEN 'Taxes' WHEN 3 THEN 'usage' WHEN 4 THEN 'One-Time' WHEN 5 THEN '' END AS charge_type,
  CASE WHEN o_orderkey % 9 < 7 THEN cast(o_orderdate AS date) END AS contract_begin_date,
  CASE WHEN o_orderkey % 9 < 6 THEN cast(12 * (1 + o_custkey % 3) AS int) END AS contract_term_months,
  CASE WHEN o_orderkey % 9 < 8 THEN cast(o_orderdate AS date) + cast(CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 = 1 THEN -3 ELSE 365 * (1 + o_custkey % 3) + o_orderkey % 90 - 45 END AS int) END AS contract_expiration_date,
  CASE o_orderkey % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN 'N/A' WHEN 2 THEN 'No(contract rate $' || cast(o_orderkey % 900 AS string) || ')' WHEN 3 THEN 'No, rate $13' END AS billing_per_contract,
  CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' ' WHEN 2 THEN 'No' END AS currently_month_to_month, CASE WHEN o_orderkey % 6 = 1 THEN 'YES' END AS auto_renew, CASE WHEN o_orderkey % 12 = 0 THEN 'K-' || cast(o_custkey AS string) END AS contract_number,
  CASE o_orderkey % 6 WHEN 0 THEN '43215' WHEN 1 THEN '43215-1234' WHEN 2 THEN 'M5V 2T6' WHEN 3 THEN '1234' WHEN 4 THEN '' END AS zip, CASE WHEN o_orderkey % 23 = 0 THEN 'x' END AS z_zip,
  CASE o_orderkey % 4 WHEN 0 THEN cast(o_custkey AS string) || ' High St' WHEN 1 THEN '' END AS service_address_1, CASE o_orderkey % 3 WHEN 0 THEN 'Columbus' WHEN 1 THEN 'Dayton' END AS city, CASE WHEN o_orderkey % 3 = 0 THEN 'OH' END AS state,
  CASE WHEN o_orderkey % 29 = 0 THEN 'USA' END AS country, CASE o_orderkey % 5 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Not Mentioned' WHEN 2 THEN '' END AS billing_name,
  CASE o_orderkey % 10 WHEN 0 THEN 'Active' WHEN 1 THEN '' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 'pending' ELSE 'approved' END AS review_status, o_orderdate AS created_at
FROM orders"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of INVENTORY, one for each order."""
    return spark.sql(INVENTORY.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def over(sql: str) -> str:
    return f"WITH inv AS ({INVENTORY}) {sql}"


def inv(name: str, sql: str | None = None):
    """Register a query over the inventory."""
    def add(f):
        query(name, None if sql is None else over(sql))(lambda spark, sf_dir: f(inventory(spark, sf_dir)))
        return f
    return add


def d(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"


def blank(c: str) -> str:
    return f"nullif(trim({c}), '')"


# --- scalar functions ----------------------------------------------------------------------------------------------------

@inv("f_accounts", f"""SELECT row_id, {d('carrier_account_number')} AS digits,
 CASE WHEN length({d('carrier_account_number')}) = 12 THEN left({d('carrier_account_number')}, 11) ELSE {d('carrier_account_number')} END AS canonical,
 CASE WHEN length({d('phone_number')}) = 7 AND length({d('carrier_account_number')}) >= 3 THEN left({d('carrier_account_number')}, 3) || {d('phone_number')} ELSE {d('phone_number')} END AS padded,
 left({d('carrier_account_number')}, 13) AS matched FROM inv""")
def _(df):
    """F1-F3, F42, F43."""
    a = F.coalesce("carrier_account_number", F.lit(""))
    return df.select("row_id", X.digits(a).alias("digits"), X.account(a, 11, True).alias("canonical"), X.padded_phone(F.coalesce("phone_number", F.lit("")), a).alias("padded"), X.match_account(a).alias("matched"))


@inv("f_names", r"""SELECT row_id, regexp_replace(lower(carrier_name), '[^a-z0-9]+', '', 'g') AS name_key,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(component_or_feature_name, ''))), '\s*[-–]\s*qty\s*:?\s*\d+\s*$', ''), '\s*\(\s*qty\s*:?\s*\d+\s*\)\s*$', ''), '\s*qty\s*:?\s*\d+\s*$', ''), '\s+', ' ', 'g')) AS service_name,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(carrier_name)), '&+', '_and_', 'g'), '[^a-z0-9]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS slug,
 CASE WHEN lower(trim(coalesce(billing_name, ''))) IN ('not mentioned', 'na', 'n/a', 'none') THEN '' ELSE trim(coalesce(billing_name, '')) END AS comparable FROM inv""")
def _(df):
    """F4, F5, F8, F14."""
    return df.select("row_id", X.name_key(F.col("carrier_name")).alias("name_key"), X.service_name(F.col("component_or_feature_name")).alias("service_name"), X.slug(F.col("carrier_name")).alias("slug"), X.comparable(F.col("billing_name")).alias("comparable"))


@inv("f_carrier", """SELECT row_id, CASE WHEN carrier_name = 'AT&T Ohio' THEN 'ATT' WHEN carrier_name LIKE 'Charter%' THEN 'SPECTRUM' WHEN carrier_name = 'windstream' THEN 'WINDSTREAM' WHEN carrier_name LIKE 'Peerless%' THEN 'PEERLESS'
 ELSE upper(regexp_replace(coalesce(carrier_name, ''), '[^a-zA-Z0-9]', '', 'g')) END AS carrier FROM inv""")
def _(df):
    """F11."""
    return df.select("row_id", X.carrier(F.col("carrier_name")).alias("carrier"))


@inv("f_charges", """SELECT row_id, CASE upper(trim(coalesce(charge_type, ''))) WHEN 'MRC' THEN 'MRC' WHEN 'RECURRING' THEN 'MRC' WHEN 'TAXES' THEN 'TAX' WHEN 'USAGE' THEN 'USAGE' WHEN 'ONE-TIME' THEN 'OCC' WHEN '' THEN 'UNK' ELSE upper(trim(charge_type)) END AS charge,
 CASE WHEN coalesce(nullif(service_or_component, ''), row_type, '') IN ('S', 'C') THEN 'SC' WHEN coalesce(nullif(service_or_component, ''), row_type, '') LIKE '%T%' THEN 'T' ELSE '' END AS bucket FROM inv""")
def _(df):
    """F12, F13."""
    return df.select("row_id", X.charge_bucket(F.col("charge_type")).alias("charge"), X.row_bucket(F.col("service_or_component"), F.col("row_type")).alias("bucket"))


@inv("f_components", r"""SELECT row_id, CASE WHEN component_or_feature_name = 'BusLocalCalling' THEN 'businesslocalcalling' ELSE regexp_replace(lower(coalesce(component_or_feature_name, '')), '[^a-z0-9]+', '', 'g') END AS component FROM inv""")
def _(df):
    """F9."""
    return df.select("row_id", X.component_name(F.col("component_or_feature_name")).alias("component"))


@inv("f_terms", f"""SELECT row_id, coalesce(contract_expiration_date < DATE '{TODAY}', false) AS expired,
 abs(date_diff('day', contract_expiration_date, cast(contract_begin_date + to_months(contract_term_months) AS date))) <= 31 AS term_ok,
 cast(greatest(0, (year(contract_expiration_date) - 1998) * 12 + month(contract_expiration_date) - 1) AS bigint) AS months_left FROM inv WHERE contract_expiration_date IS NOT NULL""")
def _(df):
    """F26-F28."""
    end, today = F.col("contract_expiration_date"), F.to_date(F.lit(TODAY))
    return df.filter(end.isNotNull()).select("row_id", terms.is_expired(end, today).alias("expired"), terms.term_matches(F.col("contract_begin_date"), F.col("contract_term_months"), end).alias("term_ok"), terms.months_remaining(end, today).cast("long").alias("months_left"))


DOLLAR = r"try_cast(nullif(replace(regexp_extract(billing_per_contract, '\$?([\d,]+(?:\.\d{1,2})?)', 1), ',', ''), '') AS double)"


@inv("f_dollar", f"SELECT row_id, {DOLLAR} AS rate FROM inv")
def _(df):
    """F31."""
    return df.select("row_id", X.dollar(F.col("billing_per_contract")).cast("double").alias("rate"))


@inv("f_country", r"""SELECT row_id, CASE WHEN regexp_full_match(trim(zip), '\d{5}(-\d{4})?') THEN 'USA' WHEN regexp_full_match(upper(trim(zip)), '[A-Z]\d[A-Z]\s?\d[A-Z]\d') THEN 'CAN' END AS country FROM inv""")
def _(df):
    """F40."""
    return df.select("row_id", X.country_of(F.col("zip")).alias("country"))


# --- keys, merging, propagation ------------------------------------------------------------------------------------------

LINE = f"CASE WHEN coalesce(phone_number, '') <> '' THEN {d('phone_number')} WHEN coalesce(btn, '') <> '' THEN {d('btn')} END"
KEY = f"""CASE WHEN coalesce({blank('carrier_account_number')}, {blank('sub_account_number_1')}, {LINE}) IS NULL THEN 'unkeyed_' || doc_id || '_' || cast(row_seq AS string)
 ELSE concat_ws('|', CASE WHEN {blank('carrier_account_number')} IS NOT NULL THEN {d('carrier_account_number')} END, CASE WHEN {blank('sub_account_number_1')} IS NOT NULL THEN {d('sub_account_number_1')} END, {LINE}) END"""


@inv("j1_merge_key", f"SELECT row_id, {KEY} AS merge_key FROM inv")
def _(df):
    """J1."""
    return df.select("row_id", merge.merge_key().alias("merge_key"))


@inv("j2_split_accounts", """SELECT row_id, trim(a) AS carrier_account_number FROM (SELECT row_id, unnest(CASE WHEN doc_type IN ('contract', 'subscription') THEN string_split('614555' || lpad(cast(row_id AS string), 6, '0') || ' & 7400000000 and 12', ' & ') ELSE ['614555' || lpad(cast(row_id AS string), 6, '0') || ' & 7400000000 and 12'] END) AS x, doc_type FROM inv) t,
 LATERAL (SELECT CASE WHEN doc_type IN ('contract', 'subscription') THEN replace(x, ' and 12', '') ELSE x END AS a) u""")
def _(df):
    """J2."""
    joined = F.concat(F.lit("614555"), F.lpad(F.col("row_id").cast("string"), 6, "0"), F.lit(" & 7400000000 and 12"))
    return merge.split_accounts(df.select("row_id", "doc_type", joined.alias("carrier_account_number"))).select("row_id", "carrier_account_number")


def _prio(field: str, kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY[field].items()) + " ELSE 5 END"


def _fold(field: str) -> str:
    wins = f"{field} IS NOT NULL AND doc_type <> base AND {_prio(field, 'doc_type')} > {_prio(field, 'base')}"
    return f"coalesce(arg_max({field}, at_) FILTER ({wins}), max({field}) FILTER (at_ = 1), arg_min({field}, at_) FILTER ({field} IS NOT NULL)) AS {field}"


MERGED = ["monthly_recurring_cost", "usoc", "city", "contract_number", "phone_number"]
FULL = " + ".join(f"({f} IS NOT NULL)::int" for f in MERGED)


@inv("j3_merge_fields", f""", g AS (SELECT *, {d('carrier_account_number')} AS k FROM inv),
 l AS (SELECT *, CASE WHEN min(doc_type) OVER (PARTITION BY k) = max(doc_type) OVER (PARTITION BY k) THEN {FULL} ELSE CASE doc_type WHEN 'invoice' THEN 10 WHEN 'csr' THEN 8 WHEN 'contract' THEN 7 ELSE 5 END END AS lead_ FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lead_ DESC, doc_seq, row_seq) AS at_ FROM l),
 b AS (SELECT *, first_value(doc_type) OVER (PARTITION BY k ORDER BY at_) AS base FROM r)
 SELECT k, {', '.join(_fold(f) if f != 'monthly_recurring_cost' else _fold(f).replace(' AS monthly_recurring_cost', '::double AS monthly_recurring_cost') for f in MERGED)}, count(*) AS merged_rows FROM b GROUP BY k""")
def _(df):
    """J3, A23, J36."""
    out = merge.merge_fields(df.withColumn("k", X.digits(F.coalesce("carrier_account_number", F.lit("")))), ["k"], MERGED)
    return out.select("k", F.col("monthly_recurring_cost").cast("double").alias("monthly_recurring_cost"), *MERGED[1:], "merged_rows")


@inv("j4_service_clusters")
def _(df):
    """Greedy, so without SQL; tests hold it against a plain model."""
    keyed = df.filter("service_or_component = 'S'").withColumn("merge_key", X.digits(F.coalesce("carrier_account_number", F.lit(""))))
    return merge.cluster_services(keyed.select("row_id", "doc_seq", "row_seq", "merge_key", "component_or_feature_name", "service_type", "usoc"), "merge_key").select("row_id", "merge_key", "cluster")


@inv("j5_component_dedup", rf"""SELECT {d('carrier_account_number')} AS acct, lower(trim(coalesce(usoc, ''))) AS usoc, count(*) AS n, min(row_id) AS first_row FROM inv WHERE service_or_component = 'C' GROUP BY ALL""")
def _(df):
    """J5 by code."""
    return df.filter("service_or_component = 'C'").groupBy(X.digits(F.coalesce("carrier_account_number", F.lit(""))).alias("acct"), F.lower(F.trim(F.coalesce("usoc", F.lit("")))).alias("usoc")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def _first(field: str, part: str, when: str = "true", as_: str | None = None) -> str:
    return f"coalesce({blank(field)}, first_value(CASE WHEN {when} THEN {blank(field)} END IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY doc_seq, row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), {field}) AS {as_ or field}"


@inv("j6_location", f"SELECT row_id, {', '.join(_first(f, 'k', chr(39).join(['service_or_component = ', 'S', ' OR row_type = ', 'S', ''])) for f in ('service_address_1', 'city', 'zip'))} FROM (SELECT *, {KEY} AS k FROM inv)")
def _(df):
    """J6."""
    full = df.withColumn("merge_key", merge.merge_key()).withColumn("service_address_2", F.lit(None).cast("string"))
    return merge.propagate_location(full).select("row_id", "service_address_1", "city", "zip")


@inv("j7_account_propagation", f"SELECT row_id, {', '.join(_first(f, 'k') for f in ('billing_name', 'service_address_1', 'contract_number'))} FROM (SELECT *, {d('carrier_account_number')} AS k FROM inv)")
def _(df):
    """J7, W3."""
    return merge.propagate_account(df.withColumn("account_group", X.digits(F.coalesce("carrier_account_number", F.lit("")))), fields=["billing_name", "service_address_1", "contract_number"]).select("row_id", "billing_name", "service_address_1", "contract_number")


@inv("j8_prefix_bridge", f""", k AS (SELECT {d('carrier_account_number')} AS key, min(row_seq) AS seen FROM inv GROUP BY 1), q AS (SELECT * FROM k WHERE regexp_full_match(key, '[0-9]{{7,}}'))
 SELECT a.key, arg_max(b.key, (length(b.key), -b.seen)) AS target FROM q a JOIN q b ON length(b.key) > length(a.key) AND starts_with(b.key, a.key) GROUP BY a.key""")
def _(df):
    """J8, W8."""
    return merge.prefix_bridge(df.groupBy(X.digits(F.coalesce("carrier_account_number", F.lit(""))).alias("account")).agg(F.min("row_seq").alias("first_seen")))


@inv("j9_account_components", f""", e AS (SELECT DISTINCT {d('carrier_account_number')} AS a, {d('sub_account_number_1')} AS b FROM inv WHERE {d('carrier_account_number')} <> '' AND {d('sub_account_number_1')} <> ''),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e), r2 AS (SELECT DISTINCT x.a, y.b FROM u x JOIN u y ON x.b = y.a), r4 AS (SELECT DISTINCT x.a, y.b FROM r2 x JOIN r2 y ON x.b = y.a)
 SELECT a AS id, arg_min(b, (length(b), b)) AS root FROM r4 GROUP BY a""")
def _(df):
    """J9."""
    e = df.select(F.nullif(X.digits(F.coalesce("carrier_account_number", F.lit(""))), F.lit("")).alias("a"), F.nullif(X.digits(F.coalesce("sub_account_number_1", F.lit(""))), F.lit("")).alias("b"))
    return merge.account_components(e)


ACCT = f"coalesce(nullif({d('sub_account_number_1')}, ''), nullif({d('carrier_account_number')}, ''))"
TLINE = f"coalesce(nullif({d('phone_number')}, ''), nullif({d('btn')}, ''))"
WHOLE = "upper(trim(coalesce(service_or_component, ''))) IN ('S', '')"
TIER = f"CASE WHEN {ACCT} IS NULL THEN 0 WHEN {TLINE} IS NOT NULL THEN 1 WHEN {blank('carrier_circuit_number')} IS NOT NULL OR ({blank('service_type')} IS NOT NULL AND {WHOLE}) THEN 2 ELSE 3 END"
TKEY = f"CASE WHEN {ACCT} IS NULL THEN 'unkeyed_' || doc_id || '_' || cast(row_seq AS string) WHEN {TLINE} IS NOT NULL THEN {ACCT} || '|' || {TLINE} WHEN {blank('carrier_circuit_number')} IS NOT NULL THEN {ACCT} || '|cir:' || trim(carrier_circuit_number) WHEN {blank('service_type')} IS NOT NULL AND {WHOLE} THEN {ACCT} || '|svc:' || upper(trim(service_type)) ELSE {ACCT} END"


def tiered(df: DataFrame) -> DataFrame:
    key, tier = merge.tiered_key()
    acct = F.coalesce(*(F.nullif(X.digits(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("sub_account_number_1", "carrier_account_number")))
    return df.withColumn("tier_key", key).withColumn("tier", tier).withColumn("account", acct)


@inv("j10_tiered_key", f"SELECT row_id, {TKEY} AS tier_key, {TIER} AS tier FROM inv")
def _(df):
    """J10."""
    return tiered(df).select("row_id", "tier_key", "tier")


@inv("j11_enrich", f""", t AS (SELECT *, {TKEY} AS tk, {TIER} AS tier, {ACCT} AS acct FROM inv), s AS (SELECT * FROM t WHERE doc_type = 'contract'),
 f AS (SELECT tk, arg_max(usoc, (5, -doc_seq, -row_seq)) FILTER (usoc IS NOT NULL) AS usoc, arg_max(contract_number, (10, -doc_seq, -row_seq)) FILTER (contract_number IS NOT NULL) AS contract_number FROM s WHERE tier IN (1, 2) GROUP BY tk),
 a AS (SELECT acct, arg_max(contract_number, (10, -doc_seq, -row_seq)) FILTER (contract_number IS NOT NULL) AS contract_number FROM s WHERE acct IS NOT NULL GROUP BY acct)
 SELECT t.row_id, coalesce({blank('t.usoc')}, f.usoc, t.usoc) AS usoc, coalesce({blank('t.contract_number')}, f.contract_number, a.contract_number, t.contract_number) AS contract_number FROM t LEFT JOIN f ON t.tk = f.tk LEFT JOIN a ON t.acct = a.acct WHERE t.doc_type = 'invoice'""")
def _(df):
    """J11."""
    t = tiered(df)
    return merge.enrich(t.filter("doc_type = 'invoice'"), t.filter("doc_type = 'contract'"), ["usoc", "contract_number"]).select("row_id", "usoc", "contract_number")


@inv("j12_supplemental", f", t AS (SELECT *, {TKEY} AS tk, {TIER} AS tier FROM inv) SELECT row_id, tk AS tier_key FROM t WHERE doc_type = 'invoice' UNION ALL SELECT row_id, tk FROM t WHERE doc_type = 'csr' AND tk NOT IN (SELECT tk FROM t WHERE doc_type = 'invoice' AND tier IN (1, 2))")
def _(df):
    """J12."""
    t = tiered(df)
    return merge.append_supplemental(t.filter("doc_type = 'invoice'"), t.filter("doc_type = 'csr'")).select("row_id", "tier_key")


@inv("j13_merge_documents")
def _(df):
    """The whole merge; tests hold it against small cases."""
    return _whole_merge(df)


def _whole_merge(df: DataFrame) -> DataFrame:
    fields = ["carrier_name", "carrier_account_number", "sub_account_number_1", "phone_number", "btn", "usoc", "service_type", "service_or_component", "row_type", "component_or_feature_name", "carrier_circuit_number", "monthly_recurring_cost", "contract_number", "service_address_1", "service_address_2", "city", "state", "zip", "country", "billing_name"]
    rows = df.withColumn("service_address_2", F.lit(None).cast("string")).select("doc_id", "doc_type", "doc_seq", "row_seq", *fields)
    return merge.merge_documents(rows, {"contract": "enrichment", "subscription": "supplemental"}, fields).select("doc_id", "row_seq", "carrier_account_number", "monthly_recurring_cost", "contract_number", "city", "country")


@inv("j34_conflicts", f""", g AS (SELECT *, {d('carrier_account_number')} AS k, row_number() OVER (PARTITION BY {d('carrier_account_number')} ORDER BY CASE doc_type WHEN 'invoice' THEN 10 WHEN 'csr' THEN 8 WHEN 'contract' THEN 7 ELSE 5 END DESC, doc_seq, row_seq) AS at_ FROM inv)
 SELECT a.k, a.row_type AS value_a, b.row_type AS value_b, b.doc_id AS doc_b, count(*) AS n FROM g a JOIN g b ON a.k = b.k AND a.at_ = 1 AND b.at_ > 1 AND a.row_type <> b.row_type AND a.doc_type <> b.doc_type GROUP BY ALL""")
def _(df):
    """A field without priorities."""
    found = merge.conflicts(df.withColumn("k", X.digits(F.coalesce("carrier_account_number", F.lit("")))), ["k"], ["row_type"])
    return found.groupBy("k", "value_a", "value_b", "doc_b").agg(F.count("*").alias("n"))


# --- normalisation -------------------------------------------------------------------------------------------------------

@inv("n_rules", f"""SELECT row_id, CASE service_type WHEN 'POTS Line' THEN 'Voice' ELSE coalesce({blank('service_type')}, CASE upper(trim(usoc)) WHEN '1MB' THEN 'Voice' END) END AS service_type,
 CASE charge_type WHEN 'Recurring' THEN 'MRC' ELSE charge_type END AS charge_type, CASE WHEN lower(trim(billing_name)) = 'not mentioned' THEN NULL ELSE billing_name END AS billing_name,
 coalesce({blank('currently_month_to_month')}, CASE WHEN contract_expiration_date < DATE '{TODAY}' THEN 'Yes' WHEN contract_expiration_date IS NOT NULL THEN 'No' END) AS currently_month_to_month,
 coalesce({blank('billing_per_contract')}, CASE WHEN contract_expiration_date >= DATE '{TODAY}' AND coalesce(monthly_recurring_cost, 0) <> 0 THEN 'Yes' END) AS billing_per_contract FROM inv""")
def _(df):
    """N5, N6, N10-N13."""
    r = normalize.Rules(service_type={"POTS Line": "Voice"}, charge_type={"Recurring": "MRC"}, billing_name_placeholders=["Not Mentioned"])
    out = normalize.after_merge(df, r, F.to_date(F.lit(TODAY)))
    filled = F.coalesce(X.blank_to_null(F.col("service_type")), F.try_element_at(X.literal_map({"1MB": "Voice"}), F.upper(F.trim("usoc"))))
    return out.select("row_id", filled.alias("service_type"), "charge_type", "billing_name", "currently_month_to_month", "billing_per_contract")


@inv("n3_row_types", "SELECT row_id, CASE charge_type WHEN 'MRC' THEN 'S' WHEN 'Taxes' THEN NULL ELSE row_type END AS row_type FROM inv")
def _(df):
    """N3."""
    return normalize.before_merge(df, normalize.Rules(row_type={"MRC": "S", "Taxes": "T"})).select("row_id", "row_type")


@inv("n2_master_account", f"""SELECT row_id, CASE WHEN {blank('master_account')} IS NOT NULL AND trim(master_account) <> coalesce(carrier_account_number, '') AND {blank('sub_account_number_1')} IS NULL THEN carrier_account_number ELSE sub_account_number_1 END AS sub_account_number_1,
 coalesce(CASE WHEN trim(master_account) <> coalesce(carrier_account_number, '') THEN trim(master_account) END, carrier_account_number) AS carrier_account_number FROM inv""")
def _(df):
    """N2."""
    return normalize.before_merge(df, normalize.Rules(promote_master_account=True)).select("row_id", "sub_account_number_1", "carrier_account_number")


@inv("n9_inference", f"SELECT row_id, coalesce({blank('service_type')}, CASE WHEN regexp_matches(component_or_feature_name, '(?i)calling') THEN 'Voice' WHEN regexp_matches(component_or_feature_name, '(?i)fee') THEN 'Fee' END) AS service_type FROM inv")
def _(df):
    """N9."""
    r = normalize.Rules(service_type_inference=[("calling", "Voice"), ("fee", "Fee")], derive_month_to_month=False, derive_billing_per_contract=False)
    return normalize.after_merge(df, r, F.to_date(F.lit(TODAY))).select("row_id", "service_type")


@inv("n14_unit_cost", "SELECT row_id, CASE WHEN quantity > 0 THEN cast(round(cast(monthly_recurring_cost * 100 AS bigint) / quantity + 0.0000001) / 100 AS double) END AS unit FROM inv WHERE monthly_recurring_cost IS NOT NULL")
def _(df):
    """N14."""
    return df.filter("monthly_recurring_cost is not null").withColumn("cost_per_unit", F.lit(None).cast("decimal(12,2)")).select("row_id", normalize.unit_cost().cast("double").alias("unit"))


@inv("n15_contract_info", "SELECT row_id, CASE WHEN bool_or(doc_type = 'contract') OVER (PARTITION BY upload_id) THEN 'Yes' ELSE 'No' END AS contract_info_received FROM inv")
def _(df):
    """N15."""
    return normalize.contract_info(df.withColumn("contract_info_received", F.lit(None).cast("string")), df.select("upload_id", "doc_type")).select("row_id", "contract_info_received")


@inv("n16_registry", r"""SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(carrier_name)), '&+', '_and_', 'g'), '[^a-z0-9]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS key, min(trim(carrier_name)) AS name FROM inv WHERE length(trim(carrier_name)) BETWEEN 3 AND 64 GROUP BY 1""")
def _(df):
    """N16, P14."""
    return normalize.register_carriers(df, df.sparkSession.createDataFrame([], "key string, name string"))


@inv("n17_phone_backfill", "SELECT row_id, CASE WHEN max(nullif(trim(phone_number), '')) OVER (PARTITION BY doc_id) IS NULL THEN '6145550000' ELSE phone_number END AS phone_number FROM inv")
def _(df):
    """N17."""
    return normalize.backfill_phone(df.withColumn("document_phone", F.lit("6145550000"))).select("row_id", "phone_number")


@inv("f25_vocabulary", """SELECT row_id, CASE WHEN coalesce(trim(service_type), '') = '' THEN 'blank' WHEN service_type IN ('Voice', 'Internet') THEN 'exact' ELSE 'synonym' END AS service_type_how, CASE service_type WHEN 'POTS Line' THEN 'Voice' ELSE service_type END AS service_type FROM inv""")
def _(df):
    """F24, F25."""
    return normalize.vocabulary(df.select("row_id", "service_type"), "service_type", ["Voice", "Internet"], {"pots line": "Voice"}).select("row_id", "service_type_how", "service_type")


# --- validation and compliance -------------------------------------------------------------------------------------------

ISSUES = f"""SELECT row_id, 'monthly_recurring_cost' AS field, 'warning' AS severity FROM inv WHERE quantity <> 0 AND cost_per_unit <> 0 AND monthly_recurring_cost <> 0 AND abs(quantity::double * cost_per_unit::double - monthly_recurring_cost::double) > 0.02
 {' '.join(f"UNION ALL SELECT row_id, '{f}', 'warning' FROM inv WHERE {f} <> '' AND NOT regexp_full_match({f}, '[0-9 ().+-]{{7,20}}')" for f in ('phone_number', 'btn', 'point_to_number'))}
 {' '.join(f"UNION ALL SELECT row_id, '{f}', 'info' FROM inv WHERE {f} <> '' AND NOT regexp_full_match({f}, '[0-9]{{5}}(-[0-9]{{4}})?')" for f in ('zip', 'z_zip'))}
 UNION ALL SELECT row_id, 'contract_expiration_date', CASE WHEN contract_begin_date = contract_expiration_date THEN 'info' ELSE 'error' END FROM inv WHERE contract_begin_date >= contract_expiration_date
 {' '.join(f"UNION ALL SELECT row_id, '{f}', 'warning' FROM inv WHERE coalesce({f}, '') = ''" for f in ('carrier_name', 'carrier_account_number'))}"""


@inv("v_issues", ISSUES)
def _(df):
    """V1-V5."""
    return df.select("row_id", F.explode(quality.issues()).alias("i")).select("row_id", "i.field", "i.severity")


@inv("v7_valid", "SELECT row_id, NOT coalesce(contract_begin_date > contract_expiration_date, false) AS valid FROM inv")
def _(df):
    """V7."""
    return df.select("row_id", quality.is_valid(quality.issues()).alias("valid"))


@inv("v6_reconcile", f""", t AS (SELECT coalesce(nullif(sub_account_number_1, ''), carrier_account_number) AS account, sum(monthly_recurring_cost)::double AS extracted, sum(quantity * cost_per_unit)::double AS expected FROM inv GROUP BY 1)
 SELECT account, round(extracted - expected, 2) AS delta FROM (SELECT account, coalesce(extracted, 0) AS extracted, expected FROM t) WHERE abs(extracted - expected) > 1 AND account IS NOT NULL""")
def _(df):
    """V6, A13."""
    acct = F.coalesce(F.nullif("sub_account_number_1", F.lit("")), "carrier_account_number")
    summary = df.groupBy(acct.alias("account")).agg(F.sum(F.col("quantity") * F.col("cost_per_unit")).cast("double").alias("expected"))
    return quality.reconcile(df, summary).select("account", "delta")


MTM, AUTO = "lower(trim(coalesce(currently_month_to_month, '')))", "lower(trim(coalesce(auto_renew, '')))"
EXPIRED = f"coalesce(contract_expiration_date < DATE '{TODAY}', false)"
OFF = f"round(abs(monthly_recurring_cost::double - {DOLLAR}), 6)"
FLAGS = f"""SELECT row_id, 'rate_mismatch' AS "check", CASE WHEN round({OFF} / {DOLLAR} * 100, 6) > 10 THEN 'error' ELSE 'warning' END AS severity FROM inv WHERE monthly_recurring_cost <> 0 AND billing_per_contract LIKE 'No%' AND {DOLLAR} > 0 AND {OFF} > 0.5 AND round({OFF} / {DOLLAR} * 100, 6) > 1
 UNION ALL SELECT row_id, 'expired_contract', CASE WHEN {MTM} = 'yes' OR {AUTO} = 'yes' THEN 'info' ELSE 'warning' END FROM inv WHERE monthly_recurring_cost > 0 AND {EXPIRED}
 UNION ALL SELECT row_id, 'mtm_inconsistency', 'warning' FROM inv WHERE {MTM} = 'yes' AND contract_expiration_date IS NOT NULL AND NOT {EXPIRED}
 UNION ALL SELECT row_id, 'term_date_mismatch', 'info' FROM inv WHERE contract_term_months <> 0 AND abs(date_diff('day', contract_expiration_date, cast(contract_begin_date + to_months(contract_term_months) AS date))) > 31
 UNION ALL SELECT row_id, 'no_contract', 'info' FROM inv WHERE monthly_recurring_cost > 0 AND coalesce(cast(contract_term_months AS string), cast(contract_begin_date AS string), cast(contract_expiration_date AS string), contract_number, currently_month_to_month, auto_renew) IS NULL"""


@inv("c_flags", FLAGS)
def _(df):
    """C1-C5."""
    return df.select("row_id", F.explode(quality.flags(F.to_date(F.lit(TODAY)))).alias("f")).select("row_id", "f.check", "f.severity")


@inv("a14_flag_summary", f"SELECT \"check\" || ':' || severity AS kind, count(*) AS n FROM ({FLAGS}) GROUP BY 1")
def _(df):
    """A14."""
    return quality.flag_summary(df.withColumn("compliance_flags", quality.flags(F.to_date(F.lit(TODAY)))))


@inv("c6_needs_review", f"SELECT row_id, CASE WHEN {blank('status')} IS NULL AND (row_id IN (SELECT row_id FROM ({ISSUES}) WHERE severity = 'error') OR row_id IN (SELECT row_id FROM ({FLAGS}) WHERE severity = 'error')) THEN 'Needs Review' ELSE status END AS status FROM inv")
def _(df):
    """C6."""
    return quality.audit(df, F.to_date(F.lit(TODAY))).select("row_id", "status")


@inv("q1_confidence", """SELECT row_id, CASE WHEN phone_number IS NULL THEN 'missing' WHEN regexp_full_match(phone_number, '[0-9 ().+-]{7,20}') THEN 'high' ELSE 'medium' END AS phone_number, CASE WHEN zip IS NULL THEN 'missing' WHEN regexp_full_match(zip, '[0-9]{5}(-[0-9]{4})?') THEN 'high' ELSE 'medium' END AS zip,
 CASE WHEN city IS NULL THEN 'missing' ELSE 'high' END AS city, CASE WHEN usoc IS NULL THEN 'missing' ELSE 'medium' END AS usoc FROM inv""")
def _(df):
    """Q1."""
    from ..schema import CATEGORY

    full = df.select("*", *(F.lit(None).cast("string").alias(f) for f in CATEGORY if f not in df.columns)).withColumn("m", quality.confidence())
    return full.select("row_id", *(F.col("m")[f].alias(f) for f in ("phone_number", "zip", "city", "usoc")))


# --- reports -------------------------------------------------------------------------------------------------------------

@inv("a2_review_totals", "SELECT count(*) AS n_rows, sum(monthly_recurring_cost)::double AS total_mrc, count(nullif(review_status, 'pending')) AS reviewed FROM inv")
def _(df):
    """A1, A2."""
    return marts.review_totals(df).withColumn("total_mrc", F.col("total_mrc").cast("double"))


@inv("a3_review_counts", "SELECT review_status, count(*) AS n FROM inv GROUP BY 1")
def _(df):
    """A3."""
    return marts.counts(df, F.col("review_status"), "review_status")


@inv("a5_by_carrier", "SELECT carrier_name, count(*) AS n_rows, sum(monthly_recurring_cost)::double AS total_mrc FROM inv WHERE carrier_name IS NOT NULL GROUP BY 1")
def _(df):
    """A5."""
    return marts.by_carrier(df).withColumn("total_mrc", F.col("total_mrc").cast("double"))


RATED = ["carrier_name", "carrier_account_number", "phone_number", "usoc", "monthly_recurring_cost", "contract_begin_date", "zip", "city"]


def _rate(f: str) -> str:
    n = f"count(nullif({f}, ''))" if f not in ("monthly_recurring_cost", "contract_begin_date") else f"count({f})"
    return f"SELECT '{f}' AS field, {n} AS filled, round({n} * 100.0 / count(*), 1)::double AS rate FROM inv"


@inv("a7_fill_rates", " UNION ALL ".join(map(_rate, RATED)))
def _(df):
    """A7, F34."""
    return marts.fill_rates(df, RATED)


@inv("a15_upload_stats", f""", i AS (SELECT row_id, count(*) AS n, count(*) FILTER (severity = 'error') AS e FROM ({ISSUES}) GROUP BY 1)
 SELECT upload_id, count(*) AS n_rows, count(*) FILTER (n > 0) AS with_issues, count(*) FILTER (e > 0) AS with_errors, count(DISTINCT carrier_account_number) AS accounts FROM inv LEFT JOIN i USING (row_id) GROUP BY 1""")
def _(df):
    """A15."""
    return marts.upload_stats(df.withColumn("issues", quality.issues())).drop("carriers")


@inv("a20_footer", "SELECT sum(monthly_recurring_cost) FILTER (lower(city) LIKE '%colum%')::double AS total_mrc, count(DISTINCT carrier_account_number) FILTER (lower(city) LIKE '%colum%') AS accounts, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM inv")
def _(df):
    """A20."""
    return marts.footer(df, F.lower("city").contains("colum")).withColumn("total_mrc", F.col("total_mrc").cast("double"))


@inv("a21_key_overlap", f", a AS (SELECT DISTINCT {d('carrier_account_number')} AS k FROM inv WHERE doc_type = 'invoice'), b AS (SELECT DISTINCT {d('carrier_account_number')} AS k FROM inv WHERE doc_type = 'csr') SELECT (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS shared, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b")
def _(df):
    """A21."""
    k = df.withColumn("k", X.digits(F.coalesce("carrier_account_number", F.lit(""))))
    return marts.key_overlap(k.filter("doc_type = 'invoice'").select("k"), k.filter("doc_type = 'csr'").select("k"), "k")


@inv("p11_search", "SELECT row_id FROM inv WHERE contains(lower(concat_ws(' ', carrier_name, city)), 'peer') ")
def _(df):
    """P11."""
    return marts.search(df, "peer", ["carrier_name", "city"]).select("row_id")


@inv("p10_review_filter", "SELECT row_id FROM inv WHERE review_status = 'approved'")
def _(df):
    """P10."""
    return marts.review_filter(df, "approved").select("row_id")


@inv("p13_merge_trigger", "SELECT upload_id, bool_or(doc_type = 'contract') AND bool_or(doc_type IN ('invoice', 'csr', 'subscription')) AS merge FROM inv GROUP BY 1")
def _(df):
    """P13."""
    return marts.merge_trigger(df)


@inv("p9_comparable_rows", f"SELECT row_id FROM inv WHERE {blank('charge_type')} IS NOT NULL OR {blank('row_type')} IS NOT NULL")
def _(df):
    """P9."""
    return evaluate.comparable_rows(df).select("row_id")


@inv("l3_natural_page", "SELECT row_id, carrier_account_number FROM inv WHERE carrier_account_number <> '' ORDER BY lpad(split_part(carrier_account_number, '-', 2), 20, '0'), lpad(split_part(carrier_account_number, '-', 3), 20, '0'), lpad(split_part(carrier_account_number || '-0', '-', 4), 20, '0'), row_id LIMIT 50")
def _(df):
    """L3."""
    return marts.page(df.filter("carrier_account_number != ''").select("row_id", "carrier_account_number"), F.col("carrier_account_number"), size=50)


# --- matching and scoring ------------------------------------------------------------------------------------------------

MPHONE = "regexp_replace(replace(coalesce(nullif(phone_number, ''), btn, ''), '.0', ''), '[^0-9]', '', 'g')"
MKEY = f"left({d('carrier_account_number')}, 13) || '|' || left({d('sub_account_number_1')}, 13) || '|' || CASE WHEN length({MPHONE}) = 7 AND length({d('carrier_account_number')}) >= 3 THEN left({d('carrier_account_number')}, 3) || {MPHONE} ELSE {MPHONE} END"


@inv("j23_match_key", f"SELECT row_id, {MKEY} AS k FROM inv")
def _(df):
    """J22, J23."""
    return df.select("row_id", evaluate.match_key(False).alias("k"))


@inv("w5_pair_in_order", f""", g AS (SELECT row_id, {d('carrier_account_number')} AS k, row_number() OVER (PARTITION BY {d('carrier_account_number')} ORDER BY row_seq) AS n FROM inv WHERE doc_type = 'invoice'),
 e AS (SELECT row_id, {d('carrier_account_number')} AS k, row_number() OVER (PARTITION BY {d('carrier_account_number')} ORDER BY row_seq) AS n FROM inv WHERE doc_type = 'csr') SELECT g.row_id AS golden_id, e.row_id AS extracted_id FROM g JOIN e USING (k, n)""")
def _(df):
    """W5, J25."""
    k = df.withColumn("k", X.digits(F.coalesce("carrier_account_number", F.lit(""))))
    return evaluate.pair_in_order(k.filter("doc_type = 'invoice'"), k.filter("doc_type = 'csr'"), ["k"])


@inv("j25_match_rows")
def _(df):
    """Three passes, each row once; tests hold it against a plain model."""
    rows = df.withColumn("sub_account_number_2", F.lit(None).cast("string"))
    return evaluate.match_rows(rows.filter("doc_type = 'invoice'"), rows.filter("doc_type = 'csr'"))


@inv("e1_scores", """, p AS (SELECT row_id, city AS e, CASE WHEN row_id % 4 = 0 THEN 'Columbus OH' WHEN row_id % 4 = 1 THEN city WHEN row_id % 4 = 2 THEN 'N/A' ELSE 'Akron' END AS g FROM inv),
 q AS (SELECT row_id, trim(coalesce(e, '')) AS e, CASE WHEN lower(trim(coalesce(g, ''))) = 'n/a' THEN '' ELSE trim(coalesce(g, '')) END AS g FROM p)
 SELECT row_id AS golden_id, CASE WHEN e = '' AND g = '' THEN 'BOTH_EMPTY' WHEN e = '' THEN 'MISSING' WHEN g = '' THEN 'EXTRA' WHEN lower(e) = lower(g) THEN 'CORRECT' WHEN length(e) > 3 AND length(g) > 3 AND (contains(lower(e), lower(g)) OR contains(lower(g), lower(e))) THEN 'PARTIAL' ELSE 'WRONG' END AS score FROM q""")
def _(df):
    """E1, E3."""
    g = F.when(F.col("row_id") % 4 == 0, "Columbus OH").when(F.col("row_id") % 4 == 1, F.col("city")).when(F.col("row_id") % 4 == 2, "N/A").otherwise("Akron")
    pairs = df.select(F.col("row_id").alias("golden_id"), F.col("row_id").alias("extracted_id"), F.col("city").alias("e_city"), g.alias("g_city"))
    return evaluate.score_pairs(pairs, ["city"]).select("golden_id", "score")


@inv("a17_category_accuracy", """, s AS (SELECT CASE WHEN city IS NULL THEN 'MISSING' WHEN row_id % 3 = 0 AND row_id % 2 = 0 THEN 'CORRECT' ELSE 'WRONG' END AS score FROM inv)
 SELECT 'semi_structured' AS category, round(count(*) FILTER (score = 'CORRECT') * 100.0 / count(*), 1)::double AS accuracy FROM s""")
def _(df):
    """A17."""
    g = F.when((F.col("row_id") % 3 == 0) & (F.col("row_id") % 2 == 0), "Columbus").otherwise("Akron")
    return evaluate.category_accuracy(evaluate.score_pairs(df.select(F.col("row_id").alias("golden_id"), F.col("row_id").alias("extracted_id"), F.col("city").alias("e_city"), g.alias("g_city")), ["city"]))


@inv("j21_reclassify", """, v AS (SELECT doc_id, carrier_name AS c, count(*) AS n FROM inv WHERE carrier_name IS NOT NULL GROUP BY 1, 2) SELECT doc_id, max(n) * 1.0 / sum(n) > 0.6 AS reclassified FROM v GROUP BY 1""")
def _(df):
    """J21."""
    return classify.reclassify(df, df.select("doc_id").distinct().withColumn("carrier", F.lit("nobody"))).select("doc_id", "reclassified")


@inv("j15_names", """SELECT row_id, CASE carrier_name WHEN 'AT&T Ohio' THEN 'AT&T' WHEN 'Charter Communications' THEN 'Spectrum' WHEN 'windstream' THEN 'Windstream' ELSE carrier_name END AS canonical, carrier_name IN ('AT&T Ohio', 'Charter Communications', 'windstream') AS registered FROM inv WHERE carrier_name IS NOT NULL""")
def _(df):
    """J15."""
    reg = df.sparkSession.createDataFrame([("att", "AT&T", ["ATT Ohio Bell"], 0), ("spectrum", "Spectrum", ["Charter"], 1), ("windstream", "Windstream", ["Windstream Enterprise"], 2)], "key string, display string, aliases array<string>, position int")
    return classify.match_names(df.filter("carrier_name is not null").select("row_id", F.col("carrier_name").alias("name")), reg).select("row_id", "canonical", "registered")


# --- life cycle ----------------------------------------------------------------------------------------------------------

@inv("w1_first_of_equals", "SELECT min(row_id) AS row_id FROM inv GROUP BY carrier_name, carrier_account_number, charge_type, usoc")
def _(df):
    """W1."""
    return lifecycle.first_of_equals(df, ["carrier_name", "carrier_account_number", "charge_type", "usoc"], ["row_id"]).select("row_id")


@inv("j31_diff", """SELECT row_seq, 'city' AS field, city AS old, 'Dayton' AS new FROM inv WHERE row_id % 2 = 0 AND coalesce(trim(city), '') <> 'Dayton'""")
def _(df):
    """J31, U3."""
    return lifecycle.diff(df, df.select("row_seq", F.when(F.col("row_id") % 2 == 0, "Dayton").otherwise(" ").alias("city")), ["city"])


@inv("u2_approve", "SELECT row_id, CASE WHEN row_id % 10 = 0 THEN 'approved' ELSE review_status END AS review_status FROM inv")
def _(df):
    """U2."""
    return lifecycle.approve(df, df.filter("row_id % 10 = 0").select("row_id")).select("row_id", "review_status")


@inv("j14_master_data", f"SELECT row_id, CASE WHEN {d('phone_number')} = '6145550007' THEN 'Master City' WHEN {d('carrier_account_number')} = '61400300003' THEN 'Third' ELSE city END AS city FROM inv")
def _(df):
    """J14, F43."""
    entries = df.sparkSession.createDataFrame([(1, None, None, {"carrier_account_number": "614-003-00003"}, {"city": "Third"}), (2, None, None, {"phone_number": "614 555 0007"}, {"city": "Master City"})], "entry_seq int, carrier string, account_number string, key_fields map<string,string>, values map<string,string>")
    return lifecycle.apply_master_data(df, entries, ["city"]).select("row_id", "city")


@inv("j27_upsert", "SELECT upload_id, max(row_id) % 7 AS v FROM inv WHERE upload_id NOT IN ('up1', 'up2') GROUP BY 1 UNION ALL SELECT 'up1', 100 UNION ALL SELECT 'up2', 100")
def _(df):
    """J27, K3."""
    old = df.groupBy("upload_id").agg((F.max("row_id") % 7).alias("v"))
    return lifecycle.upsert(old, df.sparkSession.createDataFrame([("up1", 100), ("up2", 100)], "upload_id string, v long"), ["upload_id"])


@inv("j30_orphans", "SELECT DISTINCT upload_id AS short_id FROM inv WHERE upload_id NOT IN (SELECT upload_id FROM inv WHERE row_id % 500 = 0)")
def _(df):
    """J30."""
    return lifecycle.orphans(df.select(F.col("upload_id").alias("short_id")).distinct(), df.filter("row_id % 500 = 0").select(F.col("upload_id").alias("short_id")))


@inv("p16_guards", "SELECT row_id, confidence <> 'low' AS allowed FROM inv")
def _(df):
    """P16."""
    return lifecycle.guard(df.select("row_id", F.when(F.col("confidence") == "low", "extracting").otherwise("done").alias("status")), "delete").select("row_id", "allowed")


@inv("j33_known_accounts", f"SELECT row_id, CASE WHEN {d('carrier_account_number')} = '61400300003' THEN 'att' END AS known_carrier FROM inv")
def _(df):
    """J33."""
    return merge.known_accounts(df, df.sparkSession.createDataFrame([("61400300003", "account", "att")], "identifier string, identifier_type string, carrier string")).select("row_id", "known_carrier")


@inv("j33_learned_accounts", f"""SELECT identifier, identifier_type, min(carrier) AS carrier FROM
 (SELECT unnest(['account', 'btn', 'phone']) AS identifier_type, unnest([{d('carrier_account_number')}, {d('btn')}, {d('phone_number')}]) AS identifier, carrier_name AS carrier FROM inv WHERE row_seq % 3 < 2)
WHERE identifier <> '' AND carrier IS NOT NULL AND NOT (identifier = '61400300003' AND identifier_type = 'account') GROUP BY 1, 2 UNION ALL SELECT '61400300003', 'account', 'att'""")
def _(df):
    """Accounts, billing numbers and phones that rows of high or medium confidence teach, beside one that was known."""
    known = df.sparkSession.createDataFrame([("61400300003", "account", "att")], "identifier string, identifier_type string, carrier string")
    return merge.learn_accounts(known, df.withColumn("confidence", F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("row_seq") % 3 + 1).cast("int"))))


@inv("u4_snapshots", "SELECT upload_id, 0 AS version FROM inv GROUP BY 1")
def _(df):
    """U4, W4."""
    none = df.sparkSession.createDataFrame([], "upload_id string, version int, content_hash string")
    one = lifecycle.snapshot(df.select("upload_id", "row_seq", F.col("city").alias("payload")), none)
    return lifecycle.snapshot(df.select("upload_id", "row_seq", F.col("city").alias("payload")), one).select("upload_id", "version")


@inv("a12_patterns", "SELECT 'merge_rule' AS suggestion, 'city' AS field_name, count(*) AS count FROM inv WHERE city IS NOT NULL")
def _(df):
    """A12."""
    c = df.filter("city is not null").select(F.lit("city").alias("field_name"), F.col("city").alias("corrected_value"), F.lit("merge").alias("root_cause"))
    return feedback.patterns(c).select("suggestion", "field_name", "count")


@inv("a11_hints", "SELECT 'city' AS field_name, city AS corrected_value, count(*) AS n FROM inv WHERE city IS NOT NULL AND row_id % 2 = 0 GROUP BY 2 HAVING count(*) >= 2")
def _(df):
    """A11."""
    c = df.filter("city is not null").select(F.lit("city").alias("field_name"), F.col("city").alias("corrected_value"), F.lit("x").alias("extracted_value"), F.when(F.col("row_id") % 2 == 0, "EXTRACTION").otherwise("MERGE").alias("root_cause"))
    return feedback.hints(c).select("field_name", "corrected_value", "n")
