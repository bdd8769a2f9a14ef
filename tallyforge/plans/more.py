"""Queries of the operators that stand beside the inventory's main road: cells, headers, dates, addresses, files, corrections, versions.

Most start from one SELECT over orders that both engines read; the operator and the SQL then say the same of it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as X
from ..operators import chunk, classify, evaluate, extract, feedback, lifecycle, marts, merge, normalize, quality
from ..operators.graph import cut
from ..schema import ANALYST_JUDGMENT, CATEGORY, DERIVED, extractability_by_carrier
from ..sources import files, sinks
from .catalogue import query, table
from .inventory import INVENTORY, d, inv

K = "cast(o_orderkey AS string)"


def orders(name: str, columns: str, sql: str):
    """Register a query over SELECT o_orderkey AS id, <columns> FROM orders, which is x in its SQL."""
    source = f"SELECT o_orderkey AS id, {columns} FROM orders"

    def add(f: Callable[[DataFrame], DataFrame]):
        query(name, f"WITH x AS ({source}) {sql}")(lambda spark, sf_dir: f(spark.sql(source.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))))
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads."""
    cut(spark.range(0))  # sets the shared folder where tests have none
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/tallyforge/files-{uuid.uuid4().hex}"


# --- cells, names, dates -------------------------------------------------------------------------------------------------

@orders("f6_headers", f"'  Bill-To  (No. ' || {K} || ')' AS h", f"SELECT id, 'billto no ' || cast(id AS string) AS loose, 'bill-to (no. ' || cast(id AS string) || ')' AS strict FROM x")
def _(x):
    """F6."""
    return x.select("id", X.header(F.col("h")).alias("loose"), X.header(F.col("h"), True).alias("strict"))


@orders("f7_point_zero", f"CASE WHEN o_orderkey % 2 = 0 THEN {K} || '.0' WHEN o_orderkey % 3 = 0 THEN {K} || '.05' ELSE 'v' || {K} || '.0' END AS c", "SELECT id, CASE WHEN id % 2 = 0 THEN cast(id AS string) ELSE c END AS c FROM x")
def _(x):
    """F7."""
    return x.select("id", X.without_point_zero(F.col("c")).alias("c"))


@orders("f10_camel", f"CASE WHEN o_orderkey % 2 = 0 THEN 'ThreeWayCalling' ELSE 'HTTPServer_name' || {K} END AS c", "SELECT id, CASE WHEN id % 2 = 0 THEN 'three way calling' ELSE 'http server name' || cast(id AS string) END AS c FROM x")
def _(x):
    """F10."""
    return x.select("id", X.camel_split(F.col("c")).alias("c"))


@orders("f15_respaced", f"CASE o_orderkey % 6 WHEN 0 THEN {K} || 'NHIGHST' WHEN 1 THEN {K} || '5THST' WHEN 2 THEN 'S' || {K} WHEN 3 THEN {K} || '3RD' WHEN 4 THEN 'A ' || {K} || 'B' ELSE {K} || '5thave' END AS c",
        "SELECT id, CASE id % 6 WHEN 0 THEN cast(id AS string) || ' NHIGHST' WHEN 1 THEN cast(id AS string) || '5TH ST' WHEN 2 THEN 'S ' || cast(id AS string) WHEN 3 THEN c WHEN 4 THEN c ELSE cast(id AS string) || '5th ave' END AS c FROM x")
def _(x):
    """F15."""
    return x.select("id", X.respaced(F.col("c")).alias("c"))


@orders("f16_address_block", f"'Acme Holding' || chr(10) || {K} || ' Main St' || chr(10) || 'USA' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'New Albany, OH 43054' ELSE 'New Albany' END AS c",
        "SELECT id, CASE WHEN id % 2 = 0 THEN 'Acme Holding' ELSE 'Acme Holding' END AS billing_name, cast(id AS string) || ' Main St' AS service_address_1, CASE WHEN id % 2 = 0 THEN 'New Albany' END AS city, CASE WHEN id % 2 = 0 THEN 'OH' END AS state, CASE WHEN id % 2 = 0 THEN '43054' END AS zip FROM x")
def _(x):
    """F16."""
    return x.select("id", X.address_block(F.col("c")).alias("b")).select("id", "b.*")


@orders("f19_quantity", f"CASE o_orderkey % 3 WHEN 0 THEN 'Fee - Qty ' || {K} WHEN 1 THEN 'Fee (qty: 7)' ELSE 'Quantity 3' END AS c", "SELECT id, CASE id % 3 WHEN 0 THEN cast(id AS int) WHEN 1 THEN 7 END AS n FROM x")
def _(x):
    """F19."""
    return x.select("id", X.quantity_in(F.col("c")).alias("n"))


@orders("f20_account_in_text", f"CASE o_orderkey % 3 WHEN 0 THEN 'Account: AB' || {K} WHEN 1 THEN 'Acct #' || {K} ELSE 'none' END AS c", "SELECT id, CASE id % 3 WHEN 0 THEN 'AB' || cast(id AS string) WHEN 1 THEN cast(id AS string) END AS account FROM x")
def _(x):
    """F20."""
    return x.select("id", X.account_in(F.col("c"), [r"Account:\s*([A-Z]+\d+)", r"Acct #(\d+)"]).alias("account"))


@orders("f29_dates", "CASE o_orderkey % 4 WHEN 0 THEN '1997-03-05T10:00:00' WHEN 1 THEN '3/' || cast(1 + o_orderkey % 28 AS string) || '/1997' WHEN 2 THEN '12-31-1996' ELSE 'soon' END AS c",
        "SELECT id, CASE id % 4 WHEN 0 THEN DATE '1997-03-05' WHEN 1 THEN make_date(1997, 3, cast(1 + id % 28 AS int)) WHEN 2 THEN DATE '1996-12-31' END AS day FROM x")
def _(x):
    """F29."""
    return x.select("id", X.parsed_date(F.col("c")).alias("day"))


@orders("f30_timestamps", "CASE o_orderkey % 3 WHEN 0 THEN '2024-05-01T12:00:00Z' WHEN 1 THEN '2024-05-01T12:00:00+02:00' ELSE 'never' END AS c", "SELECT id, CASE id % 3 WHEN 0 THEN 1714564800 WHEN 1 THEN 1714557600 END::bigint AS seconds FROM x")
def _(x):
    """F30."""
    return x.select("id", F.unix_timestamp(X.iso_timestamp(F.col("c"))).alias("seconds"))


@orders("f32_amounts", f"CASE o_orderkey % 4 WHEN 0 THEN '$1,' || lpad(cast(o_orderkey % 1000 AS string), 3, '0') || '.50' WHEN 1 THEN 'N/A' WHEN 2 THEN {K} ELSE '12.345x' END AS c", "SELECT id, CASE id % 4 WHEN 0 THEN 1000.5 + id % 1000 WHEN 2 THEN id END::double AS amount FROM x")
def _(x):
    """F32."""
    return x.select("id", X.amount(F.col("c")).cast("double").alias("amount"))


@orders("f33_whole", f"CASE o_orderkey % 3 WHEN 0 THEN {K} || '.9' WHEN 1 THEN '' ELSE 'x' END AS c", "SELECT id, CASE WHEN id % 3 = 0 THEN id END AS n FROM x")
def _(x):
    """F33."""
    return x.select("id", X.whole(F.col("c")).alias("n"))


@orders("f39_flags", f"CASE WHEN o_orderkey % 2 = 0 THEN 'error' ELSE 'info' END AS severity, {K} AS k", """SELECT id, '[' || severity || '] rate: off by ' || k || '; [info] term: none' AS shown, '[{"check":"rate","severity":"' || severity || '","message":"off by ' || k || '"},{"check":"term","severity":"info","message":"none"}]' AS stored FROM x""")
def _(x):
    """F38, F39."""
    flag = lambda c, s, m: F.struct(F.lit(c).alias("check"), s.alias("severity"), m.alias("message"))
    flags = F.array(flag("rate", F.col("severity"), F.concat(F.lit("off by "), "k")), flag("term", F.lit("info"), F.lit("none")))
    return x.select("id", terms.flags_text(flags).alias("shown"), terms.flags_json(flags).alias("stored"))


@orders("f41_judged_phones", f"CASE WHEN o_orderkey % 2 = 0 THEN '(614) ' || {K} || '.0' ELSE 'N/A' END AS c", "SELECT id, CASE WHEN id % 2 = 0 THEN '614' || cast(id AS string) ELSE '' END AS phone FROM x")
def _(x):
    """F41."""
    return x.select("id", X.judge_phone(F.col("c")).alias("phone"))


# --- rules before and after the merge ------------------------------------------------------------------------------------

@inv("n1_account_from_filename", f"SELECT row_id, coalesce(nullif(trim(carrier_account_number), ''), substr(doc_id, 4)) AS carrier_account_number FROM inv")
def _(df):
    """N1."""
    return normalize.before_merge(df, normalize.Rules(account_from_filename=r"doc(\d+)")).select("row_id", "carrier_account_number")


@inv("n7_code_names", "SELECT row_id, CASE WHEN component_or_feature_name = 'ESX' THEN 'Call Forwarding' ELSE component_or_feature_name END AS component_or_feature_name FROM inv")
def _(df):
    """Codes by their names; other values stay."""
    r = normalize.Rules(usoc_component={"ESX": "Call Forwarding", "Three-Way Calling": "no"}, derive_month_to_month=False, derive_billing_per_contract=False)
    return normalize.after_merge(df, r, F.current_date()).select("row_id", "component_or_feature_name")


SERVICE = f"coalesce(nullif(trim(service_type), ''), CASE upper(trim(usoc)) WHEN '1MB' THEN 'Voice' WHEN 'ESX' THEN 'Feature' END)"


@inv("n8_line_service_type", f""", t AS (SELECT row_id, doc_seq, row_seq, {d('phone_number')} AS p, {SERVICE} AS s FROM inv)
 SELECT row_id, coalesce(s, CASE WHEN p <> '' THEN first_value(s IGNORE NULLS) OVER (PARTITION BY p ORDER BY doc_seq, row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END) AS service_type FROM t""")
def _(df):
    """By code, then by the line's first."""
    r = normalize.Rules(usoc_service_type={"1MB": "Voice", "ESX": "Feature"}, derive_month_to_month=False, derive_billing_per_contract=False)
    return normalize.after_merge(df, r, F.current_date()).select("row_id", "service_type")


@inv("n18_section_accounts", "SELECT row_id, coalesce(nullif(trim(sub_account_number_1), ''), 'S' || row_id) AS sub_account_number_1, CASE WHEN row_id % 2 = 0 THEN 'M' || row_id ELSE coalesce(carrier_account_number, 'S' || row_id) END AS carrier_account_number FROM inv")
def _(df):
    """N18."""
    key = F.col("row_id").cast("string")
    given = df.withColumn("section_sub_account", F.concat(F.lit("S"), key)).withColumn("section_master", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("M"), key)).otherwise(" "))
    return normalize.section_accounts(given).select("row_id", "sub_account_number_1", "carrier_account_number")


RAW = f"""CASE WHEN o_orderkey % 5 = 0 THEN 'no object' ELSE '{{"monthly_recurring_cost": "$1,0' || lpad(cast(o_orderkey % 100 AS string), 2, '0') || '.25", "quantity": "3.0", "row_type": "' || CASE WHEN o_orderkey % 2 = 0 THEN 'S' ELSE 'X' END || '", "contract_begin_date": "3/4/1997", "city": " "}}' END AS raw"""


@orders("n19_typed_rows", RAW, "SELECT id, 1000.25 + id % 100 AS mrc, 3 AS quantity, CASE WHEN id % 2 = 0 THEN 'S' ELSE 'X' END AS row_type, CASE WHEN id % 2 = 0 THEN 'S' END AS service_or_component, DATE '1997-03-04' AS begins, cast(NULL AS string) AS city FROM x WHERE id % 5 <> 0")
def _(x):
    """The rows that are objects."""
    good, _ = normalize.typed_rows(x)
    return good.select("id", F.col("monthly_recurring_cost").cast("double").alias("mrc"), "quantity", "row_type", "service_or_component", F.col("contract_begin_date").alias("begins"), "city")


@orders("n19_bad_rows", RAW, "SELECT id FROM x WHERE id % 5 = 0")
def _(x):
    """The others."""
    return normalize.typed_rows(x)[1].select("id")


@inv("n20_addresses", "SELECT row_id, coalesce(nullif(trim(city), ''), CASE WHEN carrier_account_number = '614-003-00003' THEN 'Dublin' END) AS city, CASE WHEN carrier_account_number = '614-003-00003' THEN coalesce(nullif(trim(billing_name), ''), 'Acme Holding') ELSE nullif(trim(billing_name), '') END AS billing_name FROM inv")
def _(df):
    """N20."""
    blocks = df.sparkSession.createDataFrame([("614-003-00003", "Acme Holding\n1 Main St\nDublin, OH 43017")], "account string, block string")
    return normalize.fill_addresses(df, blocks).select("row_id", "city", "billing_name")


@inv("c7_billing_sidecars", "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'Akron' END AS billing_city, CASE WHEN row_id % 2 = 0 AND coalesce(trim(city), '') <> '' AND coalesce(status, '') = '' THEN 'Needs Review' ELSE status END AS status FROM inv")
def _(df):
    """C7."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    full = df.select("*", *(none(c) for c in ("billing_address_1", "billing_city", "billing_state", "billing_zip", "billing_name_from_invoice")), F.when(F.col("row_id") % 2 == 0, "Akron").alias("_invoice_city"))
    return quality.billing_sidecars(full).select("row_id", "billing_city", "status")


@inv("p6_line_items", "SELECT row_id FROM inv WHERE row_id % 2 = 1 OR coalesce(phone_number, '') <> '' OR coalesce(btn, '') <> '' OR coalesce(sub_account_number_1, '') <> '' OR coalesce(usoc, '') <> '' OR coalesce(service_type, '') <> '' OR coalesce(carrier_circuit_number, '') <> '' OR coalesce(quantity, 0) <> 0 OR length(coalesce(component_or_feature_name, '')) > 25")
def _(df):
    """P6."""
    return extract.keep_line_items(df.withColumn("section_type", F.when(F.col("row_id") % 2 == 0, "scanned"))).select("row_id")


@orders("p7_sections", "CASE o_orderkey % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'bill' WHEN 2 THEN 'revenue amounts' END AS section_type", "SELECT id FROM x WHERE section_type IS NULL OR section_type = 'bill'")
def _(x):
    """P7."""
    return extract.extractable(x).select("id")


@inv("p8_unavailable", "SELECT row_id, CASE WHEN row_id % 3 = 0 AND doc_type <> 'contract' THEN NULL ELSE contract_begin_date END AS contract_begin_date, city FROM inv")
def _(df):
    """P8."""
    given = df.withColumn("format_variant", F.when(F.col("row_id") % 3 == 0, "box").otherwise("section"))
    return extract.without_unavailable(given, {"box": ["contract_begin_date"], "other": ["city"]}).select("row_id", "contract_begin_date", "city")


# --- classification, names, reports --------------------------------------------------------------------------------------

@orders("j20_agreement", "CASE o_orderkey % 3 WHEN 0 THEN 'att' WHEN 1 THEN 'bell' END AS a_carrier, 'medium' AS a_level, CASE o_orderkey % 4 WHEN 0 THEN 'att' WHEN 1 THEN 'bell' END AS b_carrier, 'low' AS b_level",
        "SELECT id, CASE WHEN a_carrier = b_carrier THEN a_carrier WHEN a_carrier IS NULL THEN b_carrier WHEN b_carrier IS NULL THEN a_carrier END AS carrier, CASE WHEN a_carrier = b_carrier THEN 'high' WHEN a_carrier IS NOT NULL AND b_carrier IS NULL THEN 'medium' WHEN a_carrier IS NULL AND b_carrier IS NOT NULL THEN 'low' END AS level FROM x")
def _(x):
    """J20."""
    return classify.agree(x).select("id", "carrier", "level")


@orders("j37_display_names", "CASE o_orderkey % 3 WHEN 0 THEN 'att' WHEN 1 THEN 'zeta_telco' END AS carrier", "SELECT id, CASE carrier WHEN 'att' THEN 'AT&T' WHEN 'zeta_telco' THEN 'zeta telco' END AS shown FROM x")
def _(x):
    """J37."""
    names = x.sparkSession.createDataFrame([("att", "AT&T")], "key string, display string")
    return classify.display_names(x, names).select("id", F.col("carrier_display").alias("shown"))


@inv("a8_category_fill", ", r AS (SELECT 'semi_structured' AS category, round(count(nullif(city, '')) * 100.0 / count(*), 1) AS rate FROM inv UNION ALL SELECT 'semi_structured', round(count(nullif(state, '')) * 100.0 / count(*), 1) FROM inv UNION ALL SELECT 'structured', round(count(nullif(zip, '')) * 100.0 / count(*), 1) FROM inv) SELECT category, round(avg(rate), 1)::double AS rate FROM r GROUP BY 1")
def _(df):
    """A8."""
    from ..schema import field_catalogue

    return marts.category_fill(marts.fill_rates(df, ["city", "state", "zip"]), field_catalogue(df.sparkSession).select("field", "category"))


@orders("a16_overall_confidence", "CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'missing' END AS a, CASE o_orderkey % 2 WHEN 0 THEN 'medium' ELSE 'missing' END AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'high' ELSE 'missing' END AS c",
        ", v AS (SELECT id, unnest([a, b, c]) AS v, unnest([1, 2, 3]) AS place FROM x), n AS (SELECT id, v, count(*) AS n, min(place) AS place FROM v WHERE v <> 'missing' GROUP BY 1, 2) SELECT x.id, coalesce((SELECT arg_max(v, (n.n, -n.place)) FROM n WHERE n.id = x.id), 'missing') AS overall FROM x")
def _(x):
    """A16."""
    return x.select("id", quality.overall_confidence(F.create_map(*(v for f in "abc" for v in (F.lit(f), F.col(f)))), ["a", "b", "c"]).alias("overall"))


SCORED = "CASE o_orderkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'zip' ELSE 'usoc' END AS field, CASE o_orderkey % 7 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'WRONG' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'MISSING' WHEN 4 THEN 'SKIPPED' ELSE 'CORRECT' END AS score, CASE o_orderkey % 7 WHEN 1 THEN 'EXTRACTION' WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'MERGE' ELSE 'DATA_GAP' END END AS cause"


@orders("a18_worst_fields", SCORED, """, c AS (SELECT field, cause, count(*) AS n FROM x WHERE cause IS NOT NULL GROUP BY 1, 2) SELECT field, round((count(*) FILTER (score = 'CORRECT') + 0.5 * count(*) FILTER (score = 'PARTIAL')) * 100.0 / count(*), 1)::double AS accuracy, count(*) AS scored, (SELECT arg_max(cause, (n, cause)) FROM c WHERE c.field = x.field) AS top_cause FROM x WHERE score <> 'SKIPPED' GROUP BY field""")
def _(x):
    """A18."""
    return evaluate.worst_fields(x)


@orders("a19_match_rate", "o_custkey AS c", "SELECT count(*) AS golden, count(*) FILTER (id % 3 = 0) AS matched, round(count(*) FILTER (id % 3 = 0) * 100.0 / count(*), 1)::double AS match_rate FROM x")
def _(x):
    """A19."""
    return evaluate.match_rate(x, x.filter("id % 3 = 0"))


@orders("e2_override", SCORED, "SELECT id, CASE WHEN score = 'WRONG' AND id % 2 = 0 THEN 'PARTIAL' ELSE score END AS score FROM x")
def _(x):
    """What a judge's verdicts change."""
    judged = x.filter("id % 2 = 0").select(F.col("id").alias("golden_id"), "field", F.lit("PARTIAL").alias("verdict"))
    return evaluate.override(x.withColumnRenamed("id", "golden_id"), judged).select(F.col("golden_id").alias("id"), "score")


MATCHED = "regexp_replace(replace(coalesce(nullif(phone_number, ''), btn, ''), '.0', ''), '[^0-9]', '', 'g')"
MATCH = f"left({d('carrier_account_number')}, 13) || '|' || left({d('sub_account_number_1')}, 13) || '|' || CASE WHEN length({MATCHED}) = 7 AND length({d('carrier_account_number')}) >= 3 THEN left({d('carrier_account_number')}, 3) || {MATCHED} ELSE {MATCHED} END || '|' || CASE WHEN upper(trim(coalesce(service_or_component, ''))) = 'C' THEN lower(trim(coalesce(usoc, ''))) ELSE '' END"


KIND = "lower(trim(coalesce(nullif(service_or_component, ''), row_type, '')))"
DIAGNOSED = f"left({d('carrier_account_number')}, 13) || '|' || CASE WHEN length({MATCHED}) = 7 AND length({d('carrier_account_number')}) >= 3 THEN left({d('carrier_account_number')}, 3) || {MATCHED} ELSE {MATCHED} END || '|' || CASE WHEN {KIND} IN ('s', 'c') THEN upper({KIND}) WHEN contains({KIND}, 't') OR contains({KIND}, 'occ') THEN 'T' ELSE 'U' END || '|' || CASE WHEN {KIND} = 'c' THEN lower(trim(coalesce(usoc, ''))) ELSE '' END"


@inv("e4_diagnostic_pairs", f", k AS (SELECT {DIAGNOSED} AS k, doc_type, arg_min(row_id, row_seq) AS r FROM inv WHERE doc_type IN ('invoice', 'csr') GROUP BY 1, 2) SELECT g.r AS golden_id, e.r AS extracted_id FROM k g JOIN k e USING (k) WHERE g.doc_type = 'invoice' AND e.doc_type = 'csr'")
def _(df):
    """E4."""
    return evaluate.diagnostic_pairs(df.filter("doc_type = 'invoice'"), df.filter("doc_type = 'csr'"))


@inv("e4_diagnostic_scores", f""", p AS (SELECT a.row_id, a.carrier_account_number AS ea, b.carrier_account_number AS ga, a.city AS ec, b.city AS gc, a.monthly_recurring_cost AS em, b.monthly_recurring_cost AS gm FROM inv a JOIN (SELECT *, lag(row_id) OVER (ORDER BY row_id) AS before FROM inv) b ON a.row_id = b.before)
 SELECT row_id, CASE WHEN trim(coalesce(ea, '')) = '' AND trim(coalesce(ga, '')) = '' THEN 'BOTH_EMPTY' WHEN trim(coalesce(ea, '')) = '' THEN 'MISSING' WHEN trim(coalesce(ga, '')) = '' THEN 'EXTRA' WHEN contains({d('ea')}, left({d('ga')}, 4)) OR contains(left({d('ga')}, 4), {d('ea')}) THEN 'CORRECT' ELSE 'WRONG' END AS account,
 CASE WHEN coalesce(ec, '') = '' AND coalesce(gc, '') = '' THEN 'BOTH_EMPTY' WHEN coalesce(ec, '') = '' THEN 'MISSING' WHEN coalesce(gc, '') = '' THEN 'EXTRA' WHEN lower(ec) = lower(gc) THEN 'CORRECT' WHEN contains(lower(ec), lower(gc)) OR contains(lower(gc), lower(ec)) THEN 'PARTIAL' ELSE 'WRONG' END AS city,
 CASE WHEN em IS NULL AND gm IS NULL THEN 'BOTH_EMPTY' WHEN em IS NULL THEN 'MISSING' WHEN gm IS NULL THEN 'EXTRA' WHEN abs(em::decimal(20,2) - gm::decimal(20,2)) <= 0.01 THEN 'CORRECT' ELSE 'WRONG' END AS cost FROM p""")
def _(df):
    """Each row against the next one, whose account is cut to four digits."""
    from ..operators.graph import numbered

    at = numbered(df.select(F.lit(0).alias("_all"), "row_id", "carrier_account_number", "city", "monthly_recurring_cost"), ["_all"], ["row_id"]).drop("_all")
    nxt = at.select((F.col("n") - 1).alias("n"), F.when(F.trim("carrier_account_number") == "", "").otherwise(F.left(X.digits(F.col("carrier_account_number")), F.lit(4))).alias("ga"), F.col("city").alias("gc"), F.col("monthly_recurring_cost").alias("gm"))
    score = lambda f, g: evaluate.diagnostic_compare(f, F.col(f), F.col(g))
    return at.join(nxt, "n").select("row_id", score("carrier_account_number", "ga").alias("account"), score("city", "gc").alias("city"), score("monthly_recurring_cost", "gm").alias("cost"))


@inv("a21_merge_rates", "SELECT 'city' AS field, round(count(nullif(city, '')) FILTER (doc_type = 'csr') * 100.0 / count(*) FILTER (doc_type = 'csr'), 1)::double AS before, round(count(nullif(city, '')) * 100.0 / count(*), 1)::double AS after FROM inv")
def _(df):
    """Rates before and after."""
    return marts.merge_rates(df.filter("doc_type = 'csr'"), df, ["city"]).drop("gain")


@orders("a24_upload_cards", f"'u' || {K} AS short_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 + o_orderkey % 2 END AS n", "SELECT short_id, coalesce(n, 0)::int AS n_files, 0 AS n_rows, CASE WHEN id % 2 = 0 THEN ['ATT'] ELSE ['X'] END AS carriers FROM x")
def _(x):
    """A24."""
    some = F.when(F.col("n").isNotNull(), F.array_repeat(F.lit("f"), F.col("n").cast("int")))
    rows = x.select("short_id", some.alias("files"), F.lit(None).cast("array<string>").alias("results"), F.when(F.col("id") % 2 == 0, F.array(F.lit("ATT"), F.lit("Unknown"), F.lit("ATT"))).alias("carriers"), F.array(F.lit("Unknown"), F.lit("X")).alias("classified"))
    return marts.upload_cards(rows)


@orders("a25_registry_counts", f"'c' || cast(o_custkey % 50 AS string) AS key", ", k AS (SELECT DISTINCT key FROM x UNION SELECT 'none') SELECT k.key, (SELECT count(*) FROM x WHERE x.key = k.key) AS formats FROM k")
def _(x):
    """A25."""
    carriers = x.select("key").distinct().union(x.sparkSession.createDataFrame([("none",)], "key string"))
    return marts.registry_counts(carriers, x)


@orders("a26_vocabulary_stats", "CASE o_orderkey % 5 WHEN 0 THEN 'Voice' WHEN 1 THEN 'pots line' WHEN 2 THEN 'Ethernet Privte Line' WHEN 3 THEN 'zzz' ELSE '' END AS t", "SELECT count(*) FILTER (id % 5 IN (1, 2)) AS normalized, count(*) FILTER (id % 5 = 3) AS warned FROM x")
def _(x):
    """One value is known by ratio only."""
    return normalize.vocabulary_stats(normalize.vocabulary(x, "t", ["Voice", "Ethernet Private Line"], {"pots line": "Voice"}), "t")


@orders("f24_fuzzy_values", "CASE o_orderkey % 4 WHEN 0 THEN ' ETHERNET PRIVTE LINE' WHEN 1 THEN 'Ethernet' WHEN 2 THEN 'voice' END AS t", "SELECT id, CASE id % 4 WHEN 0 THEN 'fuzzy' WHEN 1 THEN 'unknown' WHEN 2 THEN 'exact' ELSE 'blank' END AS t_how, CASE id % 4 WHEN 0 THEN 'Ethernet Private Line' WHEN 1 THEN 'Ethernet' WHEN 2 THEN 'Voice' END AS t FROM x")
def _(x):
    """F24, F25."""
    return normalize.vocabulary(x, "t", ["Voice", "Ethernet Private Line"], {}).select("id", "t_how", "t")


@orders("a27_tallies", "CASE o_orderkey % 3 WHEN 0 THEN 'att' END AS carrier, 'invoice' AS doc_type, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'low' END AS level", "SELECT carrier, doc_type, level, count(*) AS files FROM x GROUP BY ALL")
def _(x):
    """A27."""
    return classify.tallies(x)


@inv("l5_document_order", "SELECT row_id, row_number() OVER (PARTITION BY upload_id ORDER BY CASE doc_type WHEN 'invoice' THEN 10 WHEN 'csr' THEN 8 WHEN 'contract' THEN 7 ELSE 5 END DESC, (city IS NOT NULL)::int + (usoc IS NOT NULL)::int DESC, row_id) AS n FROM inv")
def _(df):
    """By document type, then by fullness."""
    from pyspark.sql import Window

    w = Window.partitionBy("upload_id").orderBy(merge.base_order(F.col("doc_type")).desc(), merge.completeness(["city", "usoc"]).desc(), "row_id")
    return df.select("row_id", F.row_number().over(w).alias("n"))


# --- corrections, versions, life cycle -----------------------------------------------------------------------------------

@inv("u1_corrections", "SELECT row_id, CASE WHEN row_id % 10 = 0 THEN 'B' || row_id ELSE city END AS city, CASE WHEN row_id % 20 = 0 THEN 7 ELSE quantity END AS quantity FROM inv")
def _(df):
    """The last correction of a field stands; one that doesn't fit its type is ignored."""
    key = F.col("row_id").cast("string")
    one = lambda every, field, value, ts: df.filter(f"row_id % {every} = 0").select("row_id", F.lit(field).alias("field_name"), value.alias("corrected_value"), F.lit(ts).alias("ts"))
    fixes = one(10, "city", F.concat(F.lit("A"), key), 1).union(one(10, "city", F.concat(F.lit("B"), key), 2)).union(one(20, "quantity", F.lit("7"), 1)).union(one(30, "quantity", F.lit("many"), 0))
    return feedback.apply_corrections(df, fixes, ["city", "quantity"]).select("row_id", "city", "quantity")


@inv("u1_master_entries", """SELECT 'address' AS kind, carrier_account_number AS account, arg_max(city, row_id) AS city FROM inv WHERE city IS NOT NULL AND carrier_account_number <> '' GROUP BY 2""")
def _(df):
    """What corrections teach."""
    c = df.filter("city is not null and carrier_account_number != ''").select(F.lit("city").alias("field_name"), F.col("city").alias("corrected_value"), F.col("carrier_account_number").alias("account"), F.lit(None).cast("string").alias("phone"), F.col("row_id").alias("ts"))
    return feedback.master_entries(c).select("kind", "account", F.col("values")["city"].alias("city"))


@orders("d1_diagnosis", "o_custkey AS c", "SELECT id, CASE id % 4 WHEN 0 THEN 'MERGE' WHEN 1 THEN 'EXTRACTION' WHEN 2 THEN 'ENRICHMENT' ELSE 'DATA_GAP' END AS root_cause FROM x")
def _(x):
    """The right value on the line, the wrong one there, the right one elsewhere, none."""
    kind, key = F.col("id") % 4, F.col("id").cast("string")
    phone = F.concat(F.lit("614"), F.lpad(key, 7, "0"))
    c = x.select("id", F.lit("city").alias("field_name"), F.concat(F.lit("was"), key).alias("extracted_value"), F.concat(F.lit("right"), key).alias("corrected_value"), F.lit(None).cast("string").alias("account"), phone.alias("phone"))
    there = x.filter(kind < 3).select(F.concat(F.lit("d"), key).alias("doc_id"), F.lit(None).cast("string").alias("account"), F.when(kind == 2, "").otherwise(phone).alias("phone"), F.lit("city").alias("field_name"), F.when(kind == 1, F.concat(F.lit("WAS"), key)).otherwise(F.concat(F.lit(" Right"), key)).alias("value"))
    return feedback.diagnose(c, there).select("id", "root_cause")


@orders("a12_suggestions", "o_custkey AS c", """SELECT suggestion, field_name, top_value, n AS count FROM (SELECT 'service_type' AS suggestion, 'service_type' AS field_name, 'Voice' AS top_value, count(*) FILTER (id % 5 = 0) AS n FROM x UNION ALL SELECT 'prompt_hint', 'city', 'Dayton', count(*) FILTER (id % 5 = 1) FROM x
 UNION ALL SELECT 'data_gap', 'zip', '43215', count(*) FILTER (id % 5 = 2) FROM x UNION ALL SELECT 'merge_rule', 'usoc', CASE WHEN count(*) FILTER (id % 10 = 3) > count(*) FILTER (id % 10 = 8) THEN 'A' ELSE 'B' END, count(*) FILTER (id % 5 = 3) FROM x) WHERE n >= 3""")
def _(x):
    """All four kinds."""
    case = lambda *v: F.element_at(F.array(*(F.lit(i) for i in v)), (F.col("id") % 5 + 1).cast("int"))
    c = x.select(case("service_type", "city", "zip", "usoc", "notes").alias("field_name"), F.when(F.col("id") % 5 == 3, F.when(F.col("id") % 10 == 3, "A").otherwise("B")).otherwise(case("Voice", "Dayton", "43215", "", "n")).alias("corrected_value"), case("extraction", "EXTRACTION", "data_gap", "MERGE", "ANALYST").alias("root_cause"))
    return feedback.patterns(c)


@inv("u4_new_versions", "SELECT upload_id, v AS version FROM (SELECT upload_id, unnest(CASE WHEN upload_id IN ('up3', 'up4') THEN [0, 1] ELSE [0] END) AS v FROM (SELECT DISTINCT upload_id FROM inv))")
def _(df):
    """U4: rows that changed since raise a version, equal ones don't."""
    none = df.sparkSession.createDataFrame([], "upload_id string, version int, content_hash string")
    rows = df.select("upload_id", "row_seq", F.col("city").alias("payload"))
    changed = rows.withColumn("payload", F.when(F.col("upload_id").isin("up3", "up4"), F.concat_ws("", "payload", F.lit("!"))).otherwise(F.col("payload")))
    return lifecycle.snapshot(changed, cut(lifecycle.snapshot(rows, none))).select("upload_id", "version")


@orders("s19_at_version", "'u' || cast(o_custkey % 5 AS string) AS upload_id, cast(o_orderkey % 4 AS int) AS version", "SELECT id FROM x WHERE upload_id = 'u2' AND version = (SELECT max(version) FROM x WHERE upload_id = 'u2')")
def _(x):
    """S19."""
    return lifecycle.at_version(x, "u2").select("id")


STATES = "'u' || cast(o_orderkey AS string) AS short_id, CASE o_orderkey % 4 WHEN 0 THEN 'merging' WHEN 1 THEN 'done' WHEN 2 THEN 'extracting' ELSE 'error' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS deleted_at, CASE WHEN o_orderkey % 3 = 0 THEN 'c' END AS client"


@orders("u5_bin", STATES, "SELECT id, CASE WHEN short_id IN ('u1', 'u2', 'u3') OR deleted_at IS NOT NULL AND short_id <> 'u5' THEN 1 ELSE 0 END AS gone, CASE WHEN status IN ('extracting', 'merging') THEN 'interrupted' ELSE status END AS status FROM x")
def _(x):
    """Into the bin, out of it, and runs that a restart left behind."""
    out = lifecycle.sweep_stuck(lifecycle.restore(lifecycle.soft_delete(x, ["u1", "u2", "u3"], F.lit("1999-01-01").cast("timestamp")), ["u5"]))
    return out.select("id", F.col("deleted_at").isNotNull().cast("int").alias("gone"), "status")


@orders("u6_backfill", STATES, "SELECT short_id AS upload_id, n AS row_seq, 'v' || cast(n AS string) AS city FROM x, (SELECT unnest([0, 1]) AS n) WHERE status = 'done' AND id % 8 <> 1")
def _(x):
    """Once more over what is there adds nothing."""
    done = x.select(F.col("short_id").alias("upload_id"), "status", F.array(F.struct(F.lit("v0").alias("city")), F.struct(F.lit("v1").alias("city"))).alias("results"))
    have = x.filter("id % 8 = 1").select(F.col("short_id").alias("upload_id"))
    return lifecycle.backfill(done, have)


@orders("u7_patch", STATES, "SELECT id, CASE WHEN id % 2 = 0 THEN 'New' ELSE client END AS client FROM x")
def _(x):
    """U7."""
    changes = x.filter("id % 2 = 0").select("short_id", F.create_map(F.lit("client"), F.lit("New"), F.lit("nothing"), F.lit("x")).alias("changes"))
    return lifecycle.patch(x, changes, ["client"]).select("id", "client")


@orders("u8_purge", STATES, "SELECT 'upload' AS kind, id FROM x WHERE id % 7 <> 0 UNION ALL SELECT 'row', id FROM x WHERE id % 7 <> 0")
def _(x):
    """U8: uploads and their rows."""
    left, rows = lifecycle.purge(x, x.select("id", F.col("short_id").alias("upload_id")), x.filter("id % 7 = 0").select("short_id"))
    return left.select(F.lit("upload").alias("kind"), "id").unionByName(rows.select(F.lit("row").alias("kind"), "id"))


@orders("s20_lookups", "'doc' || cast(o_orderkey % 40 AS string) || '.pdf; other.pdf' AS files_used, o_orderkey AS row_id", "SELECT 'doc' || cast(id % 40 AS string) || '.pdf' AS file_name, 'invoice' AS doc_type FROM x WHERE id = 7 UNION ALL SELECT 'other.pdf', NULL FROM x WHERE id = 7")
def _(x):
    """A row's sources."""
    kinds = x.select(F.concat(F.lit("doc"), (F.col("id") % 40).cast("string"), F.lit(".pdf")).alias("file_name"), F.lit("invoice").alias("doc_type")).distinct()
    return lifecycle.row_sources(x, kinds, 7).select("file_name", "doc_type")


G1_FIELDS = ", ".join(f"('{f}', '{'analyst_judgment' if f in ANALYST_JUDGMENT else 'derived' if f in DERIVED else 'extractable'}', {i})" for i, f in enumerate(CATEGORY))


@query("g1_extractability", f"""WITH f(field, usual, n) AS (VALUES {G1_FIELDS}), o AS (SELECT DISTINCT s_name AS carrier, field, ['analyst_judgment', 'derived', 'extractable'][c_custkey % 3 + 1] AS kind FROM customer JOIN supplier ON s_nationkey = c_nationkey JOIN f ON n = c_custkey % {len(CATEGORY)})
SELECT s_name AS carrier, f.field, CASE WHEN bool_or(kind = 'extractable') THEN 'extractable' WHEN usual = 'analyst_judgment' OR bool_or(kind = 'analyst_judgment') THEN 'analyst_judgment' WHEN usual = 'derived' OR bool_or(kind = 'derived') THEN 'derived' ELSE 'extractable' END AS kind
FROM supplier CROSS JOIN f LEFT JOIN o ON o.carrier = s_name AND o.field = f.field GROUP BY s_name, f.field, usual""")
def _(spark, sf_dir):
    """G1: suppliers as carriers; the customers of a supplier's nation each say the kind of a field."""
    s = table(spark, sf_dir, "supplier")
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    said = table(spark, sf_dir, "customer").select("c_nationkey", at(list(CATEGORY), F.col("c_custkey")).alias("field"), at(["analyst_judgment", "derived", "extractable"], F.col("c_custkey")).alias("kind")).distinct()
    said = said.join(s, F.col("c_nationkey") == F.col("s_nationkey")).select(F.col("s_name").alias("carrier"), "field", "kind")
    return extractability_by_carrier(s.select(F.col("s_name").alias("carrier")), said)


# --- sections ------------------------------------------------------------------------------------------------------------

@orders("t2_markers", f"'---LISTINGS---' || chr(10) || 'a' || {K} || chr(10) || '---BILL---' || chr(10) || 'b' AS text", "SELECT id, section_name, n FROM (SELECT id, unnest(['listings', 'bill']) AS section_name, unnest([17 + length(cast(id AS string)), 12]) AS n FROM x)")
def _(x):
    """T2."""
    return chunk.by_markers(x, ["---LISTINGS---", "---BILL---"]).select("id", "section_name", F.length("section_text").alias("n"))


@orders("t11_prompt", f"'B' || {K} AS body", "SELECT id, 'Carrier: att' || chr(10) || 'Document: invoice' || chr(10) || 'Codes:' || chr(10) || '1MB' || chr(10) || chr(10) || body AS prompt FROM x")
def _(x):
    """T11."""
    none = F.array().cast("array<string>")
    return x.select("id", chunk.prompt(F.lit("att"), F.lit("invoice"), F.col("body"), F.array(F.lit("1MB")), none, none).alias("prompt"))


@orders("t11_prompt_layers", "o_custkey AS c, o_orderpriority AS p", """SELECT id, 'Carrier: att' || chr(10) || 'Document: ' || p || chr(10) || 'Field codes:' || chr(10) || array_to_string(list_transform(generate_series(1, least(30, 1 + id % 40)), lambda i: c || '/' || i), chr(10)) || chr(10) || 'Service locations:' || chr(10) || '  Account ' || c || ':'
 || CASE WHEN regexp_full_match(trim(substr(p, 3)), '[A-Z]{1,6}') THEN '' ELSE chr(10) || '    ' || trim(substr(p, 3)) END || chr(10) || '    ' || id || ' MAIN ST' || chr(10) || chr(10) || 'body' AS prompt FROM x""")
def _(x):
    """Field codes beyond 30 are left out, and address lines of up to six letters (URGENT, HIGH, MEDIUM, LOW) are codes."""
    none = F.array().cast("array<string>")
    codes = F.transform(F.sequence(F.lit(1), F.col("id") % 40 + 1), lambda i: F.concat(F.col("c"), F.lit("/"), i))
    block = F.concat(F.substring("p", 3, 99), F.lit("\n \n"), F.col("id"), F.lit(" MAIN ST"))
    return x.select("id", chunk.prompt(F.lit("att"), F.col("p"), F.lit("body"), none, none, none, codes, F.create_map(F.col("c").cast("string"), block)).alias("prompt"))


@orders("s18_scanned", "o_orderkey % 3 AS k", "SELECT cast(id AS string) AS doc_id, 2::bigint AS pages, k = 0 AS scanned FROM x")
def _(x):
    """Documents none of whose pages has text."""
    pages = x.select(F.col("id").cast("string").alias("doc_id"), F.explode(F.array(F.lit(" "), F.when(F.col("k") == 0, "").otherwise("words"))).alias("text"))
    return files.is_scanned(pages)


@orders("s7_blocks_above", "o_orderkey AS n", "SELECT cast(id AS string) AS doc_id, 'Acme' || chr(10) || 'Main St' AS block FROM x")
def _(x):
    """The words above a mark, and not those further off."""
    word = lambda t, a, b: F.struct(F.lit(t).alias("text"), F.lit(a).alias("x"), F.lit(b).alias("y"))
    at = x.select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.explode(F.array(word("Acme", 100.0, 70.0), word("Main St", 110.0, 90.0), word("far", 400.0, 80.0), word("high", 100.0, 10.0))).alias("w")).select("doc_id", "page", "w.*")
    marks = x.select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.lit("Remit").alias("text"), F.lit(100.0).alias("x"), F.lit(120.0).alias("y"))
    return files.blocks_above(at, marks).select("doc_id", "block")


# --- files that a query writes and reads ---------------------------------------------------------------------------------

NATIONS = "SELECT cast(n_nationkey AS string) AS n_nationkey, n_name, cast(n_regionkey AS string) AS n_regionkey FROM nation"


@query("s1_directory", "SELECT n_name AS line, '.txt' AS ext FROM nation")
def _(spark, sf_dir):
    """A directory's files."""
    path = folder(spark)
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).repartition(3).write.text(path)
    return files.scan_directory(spark, path).select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"), "ext").filter("line != ''")


@query("s2_delimited", NATIONS)
def _(spark, sf_dir):
    """As text."""
    path = folder(spark)
    table(spark, sf_dir, "nation").write.csv(path, header=True)
    return files.read_delimited(spark, path)


@query("s3_tabs", NATIONS)
def _(spark, sf_dir):
    """S3."""
    path = folder(spark)
    table(spark, sf_dir, "nation").write.csv(path, header=True, sep="\t")
    return files.read_delimited(spark, path, "\t")


def made_books(df: DataFrame, sheet: str, head: list[list[str]], columns: list[str], books: int) -> DataFrame:
    """path, file_name, content: workbooks that tasks make of a table's rows, dealt by its first column; head stands above the rows."""
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = ([None if pd.isna(v) else str(v) for v in r[: len(columns)]] for r in pdf.sort_values(columns[0]).itertuples(index=False))
        name = f"{pdf['_book'].iloc[0]}.xlsx"
        return pd.DataFrame([(f"/in/{name}", name, sinks.workbook({sheet: chain(head, rows)}))], columns=["path", "file_name", "content"])

    return df.select(*columns, F.pmod(F.col(columns[0]), F.lit(books)).alias("_book")).groupBy("_book").applyInPandas(make, "path string, file_name string, content binary")


@query("s4_many_workbooks", "SELECT '/in/' || (c_custkey % 40) || '.xlsx' AS doc_id, c_custkey::int AS quantity, c_name AS billing_name, round(c_acctbal, 2)::double AS mrc FROM customer")
def _(spark, sf_dir):
    """Forty workbooks of customers, made and read by tasks."""
    book = made_books(table(spark, sf_dir, "customer").withColumn("c_acctbal", F.format_string("$%,.2f", F.round("c_acctbal", 2))), "Sheet", [["A title"], ["Qty", "Bill  Name!", "M.R.C."]], ["c_custkey", "c_name", "c_acctbal"], 40)
    got = files.typed_cells(files.structured_rows(book, {"bill name": "billing_name", "qty": "quantity", "mrc": "monthly_recurring_cost"}), ["billing_name", "quantity", "monthly_recurring_cost"])
    return got.select("doc_id", "quantity", "billing_name", F.col("monthly_recurring_cost").cast("double").alias("mrc"))


@query("s12_many_golden", "SELECT '/in/' || (s_suppkey % 8) || '.xlsx' AS doc_id, cast(s_suppkey AS varchar) AS quantity, s_name AS carrier_name FROM supplier")
def _(spark, sf_dir):
    """Golden workbooks of suppliers."""
    book = made_books(table(spark, sf_dir, "supplier"), "Baseline", [["Area"], ["Required"], ["Quantity", "Carrier Name"]], ["s_suppkey", "s_name"], 8)
    got = files.golden_rows(book, {"carrier name": "carrier_name", "quantity": "quantity"})
    return got.select("doc_id", F.col("cells")["quantity"].alias("quantity"), F.col("cells")["carrier_name"].alias("carrier_name"))


@query("s13_many_correction_workbooks", "SELECT cast(c_custkey AS int) AS row_seq, 'city' AS field, c_name AS old, c_name || '!' AS new FROM customer WHERE c_nationkey % 3 = 0")
def _(spark, sf_dir):
    """Workbooks that came back, a third of their cities corrected, against the rows they were made from."""
    c = table(spark, sf_dir, "customer")
    sent = c.select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("city"), F.lit("43215").alias("zip"))
    got = files.correction_rows(made_books(sent, "Extracted Data", [["Inventory"], ["Row", "City", "Zip Code"]], ["c_custkey", "city", "zip"], 40), {"Row": "row_seq", "City": "city", "Zip Code": "zip"})
    cell = lambda f: F.try_element_at("cells", F.lit(f))
    imported = got.select(cell("row_seq").cast("int").alias("row_seq"), cell("city").alias("city"), cell("zip").alias("zip"))
    return lifecycle.diff(c.select(F.col("c_custkey").cast("int").alias("row_seq"), F.col("c_name").alias("city"), F.lit("43215").alias("zip")), imported, ["city", "zip"])


def _as_files(spark: SparkSession, named: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(f"/in/{n}", n, bytearray(raw)) for n, raw in named], "path string, file_name string, content binary")


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The 25 nations, from which files are made."""
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


@query("s4_workbooks", "SELECT n_name AS billing_name, cast(n_nationkey AS int) AS quantity, cast(n_nationkey * 1.5 AS double) AS mrc FROM nation")
def _(spark, sf_dir):
    """A workbook under a title row, with a column that isn't known; rows of one known cell go."""
    rows = [["Bill  Name!", "Qty", "x", "M.R.C."], *([r["n_name"], f"{r['n_nationkey']}.0", "?", f"${r['n_nationkey'] * 1.5:,.2f}"] for r in _nations(spark, sf_dir)), [None, None, None, "5"]]
    book = _as_files(spark, [("a.xlsx", sinks.workbook({"Sheet": [["A title"], *rows]}))])
    got = files.structured_rows(book, {"bill name": "billing_name", "qty": "quantity", "mrc": "monthly_recurring_cost"})
    return files.typed_cells(got, ["billing_name", "quantity", "monthly_recurring_cost"]).select("billing_name", "quantity", F.col("monthly_recurring_cost").cast("double").alias("mrc"))


@query("s9_mail", "SELECT n_name AS subject, 'Hello ' || n_name AS body FROM nation")
def _(spark, sf_dir):
    """Messages as text."""
    mails = [(f"{r['n_name']}.eml", f"Subject: {r['n_name']}\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHello {r['n_name']}".encode()) for r in _nations(spark, sf_dir)]
    parts = F.split("text", "\n\n")
    return files.file_texts(_as_files(spark, mails)).select(F.replace(parts[0], F.lit("Subject: "), F.lit("")).alias("subject"), F.trim(parts[1]).alias("body"))


@query("s10_word_files", "SELECT n_name AS first, n_name || ' | ' || cast(n_nationkey AS string) AS second FROM nation")
def _(spark, sf_dir):
    """Paragraphs, then a table's row."""
    import io
    import zipfile

    def word(name: str, key: int) -> bytes:
        w, out = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", io.BytesIO()
        text = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{text(name)}<w:tbl><w:tr><w:tc>{text(name)}</w:tc><w:tc>{text(key)}</w:tc></w:tr></w:tbl></w:body></w:document>')
        return out.getvalue()

    made = _as_files(spark, [(f"{r['n_nationkey']}.docx", word(r["n_name"], r["n_nationkey"])) for r in _nations(spark, sf_dir)])
    lines = F.split("text", "\n")
    return files.file_texts(made).select(lines[0].alias("first"), lines[1].alias("second"))


@query("s12_golden", "SELECT n_name AS carrier_name, cast(n_nationkey AS string) AS quantity FROM nation")
def _(spark, sf_dir):
    """S12."""
    rows = [["Area"], ["Required"], ["Carrier Name", "Quantity"], *([r["n_name"], str(r["n_nationkey"])] for r in _nations(spark, sf_dir))]
    got = files.golden_rows(_as_files(spark, [("g.xlsx", sinks.workbook({"Baseline": rows}))]), {"carrier name": "carrier_name", "quantity": "quantity"})
    return got.select(F.col("cells")["carrier_name"].alias("carrier_name"), F.col("cells")["quantity"].alias("quantity"))


@query("s13_correction_workbooks", "SELECT cast(n_nationkey AS int) AS row_seq, 'city' AS field, n_name AS old, n_name || '!' AS new FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, sf_dir):
    """A workbook that came back, under its found header, against the rows it was made from."""
    nations = _nations(spark, sf_dir)
    rows = [["Inventory"], ["Row", "City", "Zip Code", "Notes"], *([str(r["n_nationkey"]), r["n_name"] + ("!" if r["n_nationkey"] % 2 == 0 else ""), "", "n"] for r in nations)]
    made = _as_files(spark, [("c.xlsx", sinks.workbook({"Extracted Data": rows}))])
    got = files.correction_rows(made, {"Row": "row_seq", "City": "city", "Zip Code": "zip", "Notes": "notes"})
    cell = lambda f: F.try_element_at("cells", F.lit(f))
    imported = got.select(cell("row_seq").cast("int").alias("row_seq"), cell("city").alias("city"), cell("zip").alias("zip"))
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("row_seq"), F.col("n_name").alias("city"), F.lit("43215").alias("zip"))
    return lifecycle.diff(old, imported, ["city", "zip"])


@query("k1_export", "SELECT n_name AS \"Billing Name\", '[info] a: b' AS \"Flags\" FROM nation")
def _(spark, sf_dir):
    """K1: columns under the labels of a template, written as text and read again."""
    path = folder(spark)
    flag = F.array(F.struct(F.lit("a").alias("check"), F.lit("info").alias("severity"), F.lit("b").alias("message")))
    sinks.export_csv(table(spark, sf_dir, "nation").select(F.col("n_name").alias("billing_name"), flag.alias("compliance_flags")), path, [("billing_name", "Billing Name"), ("compliance_flags", "Flags")])
    return files.read_delimited(spark, path)


@query("k2_replaced_uploads", "SELECT 'up' || cast(o_custkey % 7 AS string) AS upload_id, count(*) FILTER (o_custkey % 7 <> 3 OR o_orderkey % 2 = 0) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    """K2: writing an upload again replaces it and leaves the others."""
    path = folder(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("up"), (F.col("o_custkey") % 7).cast("string")).alias("upload_id"))
    sinks.write_inventory(rows, path)
    sinks.write_inventory(rows.filter("upload_id = 'up3' and o_orderkey % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("upload_id").agg(F.count("*").alias("n"))


@query("s15_cache", "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'att' ELSE 'bell' END AS carrier, 'invoice' AS doc_type, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    """What was extracted, by carrier and kind; only the folders asked for are read."""
    path = folder(spark)
    sinks.write_cache(table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "att").otherwise("bell").alias("carrier"), F.lit("invoice").alias("doc_type")), path)
    return spark.read.parquet(path).groupBy("carrier", "doc_type").agg(F.count("*").alias("n"))


@query("k6_json", "SELECT n_nationkey::bigint AS n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    """K6."""
    path = folder(spark)
    sinks.write_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.json(path)


@query("w7_header_spans", "SELECT nation, area, min(position) AS first, max(position) AS last FROM (SELECT c_nationkey::int AS nation, c_mktsegment AS area, c_custkey::bigint AS position, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS run FROM customer) GROUP BY nation, area, run")
def _(spark, sf_dir):
    """A template for each nation, its columns the customers, their areas the segments."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("nation"), F.col("c_custkey").cast("long").alias("position"), F.col("c_mktsegment").alias("area"))
    return sinks.area_spans(c, "nation")


WORDS = """SELECT o_custkey AS doc_id, o_orderkey % 2 AS page, 600.0D AS width, cast(o_orderkey AS string) AS text, cast(floor(o_totalprice) AS int) % CASE WHEN o_custkey % 3 = 0 THEN 320 ELSE 600 END AS x, o_orderkey * 7 % 61 AS y FROM orders"""


@query("s6_reflow", f"""WITH RECURSIVE w AS ({WORDS.replace("600.0D", "600.0::double")}),
 b AS (SELECT doc_id, page, min(y) AS top FROM w GROUP BY 1, 2 UNION ALL SELECT w.doc_id, w.page, min(w.y) FROM b JOIN w ON w.doc_id = b.doc_id AND w.page = b.page AND w.y - b.top >= 5 GROUP BY w.doc_id, w.page),
 l AS (SELECT w.*, (SELECT max(top) FROM b WHERE b.doc_id = w.doc_id AND b.page = w.page AND b.top <= w.y) AS line FROM w),
 n AS (SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY x, y, text) FILTER (x < 300) AS a, string_agg(text, ' ' ORDER BY x, y, text) FILTER (x >= 300) AS z, string_agg(text, ' ' ORDER BY x, y, text) AS whole, min(x) < 280 AND max(x) > 320 AS wide FROM l GROUP BY 1, 2, 3),
 s AS (SELECT *, a IS NOT NULL AND z IS NOT NULL AND sum(wide::int) OVER p >= 0.2 * count(*) OVER p AS split FROM n WINDOW p AS (PARTITION BY doc_id, page)),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) - row_number() OVER (PARTITION BY doc_id, page, split ORDER BY line) AS run FROM s),
 g AS (SELECT doc_id, page, min(line) AS top, CASE WHEN split THEN string_agg(a, chr(10) ORDER BY line) || chr(10) || string_agg(z, chr(10) ORDER BY line) ELSE string_agg(whole, chr(10) ORDER BY line) END AS part FROM r GROUP BY doc_id, page, split, run)
SELECT doc_id, page, string_agg(part, chr(10) ORDER BY top) AS text FROM g GROUP BY doc_id, page""")
def _(spark, sf_dir):
    """The orders of a customer as the words of two pages, a third of the customers with words nearly in one column only."""
    return files.reflow(spark.sql(WORDS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")))


@query("d1_accounts", """WITH r AS (SELECT l_orderkey % 1000 AS doc_id, cast(l_partkey * 37 % 5000 + 100 AS varchar) AS b, 'F' || (l_linenumber % 3) AS field_name, 'V' || (l_suppkey % 40) AS v FROM lineitem),
 c AS (SELECT o_orderkey AS id, cast(o_custkey * 7919 % 1000000 AS varchar) AS a, 'F' || (o_orderkey % 3) AS field_name, 'V' || (o_orderkey % 37) AS was, 'V' || (o_orderkey % 43) AS fix FROM orders),
 p AS (SELECT a, b FROM (SELECT DISTINCT a FROM c) JOIN (SELECT DISTINCT b FROM r) ON contains(a, b) OR contains(b, a)),
 f AS (SELECT b, field_name, min({'d': doc_id, 'v': v}) AS m, list(DISTINCT v) AS vs FROM r GROUP BY 1, 2),
 s AS (SELECT id, bool_or(list_contains(vs, fix)) AS had, min(m) AS m FROM c JOIN p USING (a) JOIN f USING (b, field_name) GROUP BY id)
SELECT id, c.field_name, CASE WHEN had THEN 'MERGE' WHEN m.v = was THEN 'EXTRACTION' WHEN m IS NOT NULL THEN 'MERGE' WHEN (c.field_name, fix) IN (SELECT (field_name, v) FROM r) THEN 'ENRICHMENT' ELSE 'DATA_GAP' END AS root_cause FROM c LEFT JOIN s USING (id)""")
def _(spark, sf_dir):
    """Corrections of orders against values of order lines, met by accounts that are part of each other."""
    r = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 1000 AS doc_id", "concat('A-', l_partkey * 37 % 5000 + 100) AS account", "cast(null AS string) AS phone", "concat('F', l_linenumber % 3) AS field_name", "concat(' v', l_suppkey % 40) AS value")
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "concat(o_custkey * 7919 % 1000000, ' ') AS account", "'' AS phone", "concat('F', o_orderkey % 3) AS field_name", "concat('V', o_orderkey % 37) AS extracted_value", "concat('v', o_orderkey % 43) AS corrected_value")
    return feedback.diagnose(c, r)
