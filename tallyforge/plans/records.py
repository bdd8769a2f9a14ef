"""Records in the carriers' own shapes, built from orders and their lines, so that what they say varies with the data: the SQL takes it from the
lines, the operators from the texts. Also the spend ledger, error reasons, matching under any account, and picks of conflicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables, terms
from ..functions import text as X
from ..operators import chunk, evaluate, feedback, marts, merge, normalize
from ..sources.versions import Versions
from .catalogue import query, table
from .inventory import d, inv
from .more import folder

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity"
LINES = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS n FROM lineitem)"


def records(spark, sf_dir: str, of_line: Callable[[Column], Column], before: Column, after: Column) -> DataFrame:
    """id, status, text: of each order a text of its lines in order, between two others (of the order). Lines of an order are gathered and sorted
    once; of_line is given a line's n (from 1), part, supp, pick, quantity."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*ORDER.split(", ")))).alias("lines"))
    told = lambda x, i: F.struct((i + 1).alias("n"), x["l_partkey"].cast("string").alias("part"), x["l_suppkey"].cast("string").alias("supp"), (x["l_suppkey"] % 5).alias("pick"), x["l_quantity"].cast("int").alias("quantity"))
    body = lines.select("id", F.array_join(F.transform(F.transform("lines", told), of_line), "").alias("body"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"), F.left("o_orderpriority", F.lit(1)).alias("urgent"))
    return o.join(body, "id").select("id", "status", F.concat(before, F.col("body"), after).alias("text"))


def _said(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def summary_line(x: Column) -> Column:
    return _said("  1000", x["pick"].cast("string"), "  Plant ", x["part"], "  $1,", F.lpad(x["quantity"].cast("string"), 3, "0"), ".25  $", x["supp"], ".50\n", "note without account $3.00\n")


SUMMARIES = f"l AS (SELECT l_orderkey AS id, '1000' || (l_suppkey % 5) AS account, n, l_suppkey + 0.5 AS total FROM {LINES}), t AS (SELECT id, account, arg_max(total, n)::double AS total, min(n) AS first FROM l GROUP BY 1, 2)"


def location_records(spark, sf_dir):
    """Two of three have an end of the summary; a line below the end isn't of it."""
    end = F.when(F.col("id") % 3 == 0, "\nACTIVITY FOR MAY\n99999 usage $3.00\n").when(F.col("id") % 3 == 1, "\n99999 usage $3.00\n").otherwise("")
    return records(spark, sf_dir, summary_line, _said("bill\nLOCATION SUMMARY page ", F.col("cust").cast("string"), "\n"), end)


@query("t7_location_totals", f"WITH {SUMMARIES} SELECT id, account, total FROM t WHERE id % 3 < 2")
def location_totals(spark, sf_dir):
    """T7."""
    return location_records(spark, sf_dir).select("id", F.explode(chunk.location_totals(F.col("text"))).alias("t")).select("id", "t.*")


def box_line(x: Column) -> Column:
    return _said("! ! ", x["n"].cast("string"), " !C", x["pick"].cast("string"), " Line ", x["part"], " of ", x["supp"], " !\n")


def box_records(spark, sf_dir):
    total = _said("---REVENUE AMOUNTS---\n OTHER 9.00\n LOCAL SERVICE TOTAL   ", F.col("cust").cast("string"), ".75\n", F.when(F.col("urgent") == "1", "---LOCAL SERVICE TOTAL 1.00\n").otherwise("LISTINGS\n"))
    return records(spark, sf_dir, box_line, _said(F.when(F.col("urgent") > "2", total).otherwise("no amounts\nLOCAL SERVICE TOTAL 7.00\n"), "SERV & EQUIP ACCOUNT SUMMARY\n"), F.lit("!------------!\n! ! 9 !ZZ not of it !\n"))


BOXES = f"l AS (SELECT l_orderkey AS id, 'C' || (l_suppkey % 5) AS code, n, 'Line ' || l_partkey || ' of ' || l_suppkey AS what FROM {LINES}), t AS (SELECT id, code, arg_max(what, n) AS description, min(n) AS first FROM l GROUP BY 1, 2)"


@query("t7_box_summaries", f"WITH {BOXES} SELECT t.id, code, description, CASE WHEN left(o_orderpriority, 1) > '2' THEN o_custkey + 0.75 END::double AS revenue FROM t JOIN orders ON o_orderkey = t.id")
def box_summaries(spark, sf_dir):
    """Code descriptions and revenue."""
    return box_records(spark, sf_dir).select("id", chunk.revenue_total(F.col("text")).alias("revenue"), F.explode(chunk.code_descriptions(F.col("text"))).alias("c")).select("id", "c.*", "revenue")


@query("t10_summary_section", f"""WITH {SUMMARIES}, {BOXES.replace('l AS (', 'm AS (').replace('FROM l ', 'FROM m ').replace('t AS (', 'c AS (')}
SELECT o_orderkey AS id, '{{"location_summary":{{' || (SELECT string_agg('"' || account || '":' || total, ',' ORDER BY first) FROM t WHERE t.id = o_orderkey) || '}}}}' AS locations,
 CASE WHEN left(o_orderpriority, 1) > '2' THEN '{{"revenue_total":' || (o_custkey + 0.75)::double || '}}' END AS revenue,
 '{{"usoc_summary":{{' || (SELECT string_agg('"' || code || '":"' || description || '"', ',' ORDER BY first) FROM c WHERE c.id = o_orderkey) || '}}}}' AS codes, NULL::varchar AS other
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 3 < 2""")
def summary_section(spark, sf_dir):
    """Each section by the name that a format gives it."""
    said = lambda name: chunk.summary_section(F.lit(name), F.col("text"))
    # exploded, since a filter would make the section a second time
    a = location_records(spark, sf_dir).select("id", F.explode(F.filter(F.array(said("LOCATION SUMMARY")), lambda x: x.isNotNull())).alias("locations"))
    b = box_records(spark, sf_dir).select("id", said("---REVENUE AMOUNTS---").alias("revenue"), said("SERV & EQUIP ACCOUNT SUMMARY").alias("codes"), said("LISTINGS").alias("other"))
    return a.join(b, "id")


def station_line(x: Column) -> Column:
    return _said("SLA  !", F.lpad(x["n"].cast("string"), 3, "0"), "-", x["part"], " OAK ST", F.when(x["pick"] < 4, F.concat(F.lit(", TOWN "), x["supp"])).otherwise(""), F.when(x["quantity"] % 2 == 0, " /LSO 614 222,").otherwise(","), " !\n")


def used_line(x: Column) -> Column:
    return _said("1MB /TA 36 /SLA ", F.lpad((x["n"] + F.when(x["quantity"] % 3 == 0, 500).otherwise(0)).cast("string"), 3, "0"), " /CNUM K", x["pick"].cast("string"), "\n")


def station_records(spark, sf_dir):
    main = _said("X LA  !", F.col("cust").cast("string"), " ELM AVE, DAYTON ,\n", F.when(F.col("urgent") == "1", F.concat(F.lit("SA |"), F.col("cust").cast("string"), F.lit(" MAIN ST!\n"))).otherwise(""), F.when(F.col("urgent") > "3", F.concat(F.lit("DZIP !"), F.lpad(F.col("cust").cast("string"), 5, "0"), F.lit("\n"))).otherwise(""))
    return records(spark, sf_dir, lambda x: _said(station_line(x), used_line(x)), main, F.lit(""))


STATIONS = f"""l AS (SELECT l_orderkey AS id, n, n + CASE WHEN cast(l_quantity AS int) % 3 = 0 THEN 500 ELSE 0 END AS used, l_partkey || ' OAK ST' AS address, CASE WHEN l_suppkey % 5 < 4 THEN 'TOWN ' || l_suppkey END AS city, 'K' || (l_suppkey % 5) AS contract FROM {LINES}),
o AS (SELECT o_orderkey AS id, CASE WHEN left(o_orderpriority, 1) = '1' THEN o_custkey || ' MAIN ST' ELSE o_custkey || ' ELM AVE' END AS address, CASE WHEN left(o_orderpriority, 1) <> '1' THEN 'DAYTON' END AS city, CASE WHEN left(o_orderpriority, 1) > '3' THEN lpad(cast(o_custkey AS varchar), 5, '0') END AS zip FROM orders)"""


@query("t8_placed_lines", f"WITH {STATIONS} SELECT l.id, lpad(cast(used AS varchar), 3, '0') AS station, CASE WHEN used < 500 THEN l.address ELSE o.address END AS address, CASE WHEN used < 500 THEN l.city ELSE o.city END AS city FROM l JOIN o USING (id)")
def placed_lines(spark, sf_dir):
    """Lines join the station entries of their record."""
    return chunk.placed_lines(station_records(spark, sf_dir), "id").filter("station is not null").select("id", "station", "address", "city")


@query("t8_address_context", f"""WITH {STATIONS}, k AS (SELECT id, list_sort(list_distinct(list(contract))) AS c FROM l GROUP BY 1),
s AS (SELECT id, string_agg('  SLA ' || lpad(cast(n AS varchar), 3, '0') || ' = ' || address || coalesce(', ' || city, ''), chr(10) ORDER BY n) AS said FROM l GROUP BY 1)
SELECT o.id, chr(10) || '--- ADDRESS LOOKUP TABLE ---' || chr(10) || 'DEFAULT_ADDRESS: ' || address || coalesce(chr(10) || 'DEFAULT_CITY: ' || city, '') || coalesce(chr(10) || 'DEFAULT_ZIP: ' || zip, '') || chr(10) || 'SLA_LOOKUP_TABLE:' || chr(10) || said
 || chr(10) || 'CONTRACT_NUMBER: ' || c[1] || CASE WHEN len(c) > 1 THEN chr(10) || 'CONTRACT_NUMBERS_ALT: ' || array_to_string(c[2:], ', ') ELSE '' END || chr(10) || '--- END ADDRESS TABLE ---' || chr(10) AS context FROM o JOIN s USING (id) JOIN k USING (id)""")
def address_context(spark, sf_dir):
    """T8."""
    return station_records(spark, sf_dir).select("id", chunk.address_context(chunk.address_table(F.col("text"))).alias("context"))


def block_line(x: Column) -> Column:
    return _said(
        F.when(x["n"] % 2 == 0, "Suite 1\nFloor 2\nDock 3\n").otherwise(""), "Acme ", x["part"], "\n", x["supp"], " Elm \n", F.when(x["pick"] == 1, "\n").when(x["pick"] == 2, "SUBTOTAL 5.00\n").when(x["pick"] == 3, "Date   Description\n").otherwise(""),
        F.when(x["pick"] < 4, F.concat(F.lit("Town "), x["quantity"].cast("string"), F.lit("\n"))).otherwise("pastdue\n"), "AccountNumber: ", (F.lit(10**12) + F.col("id") * 1000 + x["n"]).cast("long").cast("string"), "\n")


@query("s21_address_blocks", f"""SELECT l_orderkey AS id, cast(1000000000000 + l_orderkey * 1000 + n AS varchar) AS account, CASE WHEN l_suppkey % 5 = 0 AND n % 2 = 0 THEN 'Floor 2' || chr(10) || 'Dock 3' || chr(10) ELSE '' END || CASE WHEN l_suppkey % 5 = 0 THEN 'Acme ' || l_partkey || chr(10) || l_suppkey || ' Elm' || chr(10) ELSE '' END || 'Town ' || cast(l_quantity AS int) AS address
FROM {LINES} WHERE l_suppkey % 5 < 4""")
def address_blocks(spark, sf_dir):
    """Every account with at most five lines above it, up to an empty or a stop line."""
    docs = records(spark, sf_dir, block_line, F.lit(""), F.lit("end"))
    return docs.select("id", F.explode(chunk.address_blocks(F.col("text"), r"AccountNumber:\s*(\d{13})")).alias("b")).select("id", "b.*")


# --- salvaged JSON, reasons, spend ---------------------------------------------------------------------------------------

@query("f37_salvaged_json", """SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_suppkey % 7 < 6 THEN cast(l_partkey AS varchar) END AS first, CASE WHEN l_suppkey % 7 IN (1, 2) THEN 2 WHEN l_suppkey % 7 < 6 THEN 1 END AS size FROM lineitem""")
def salvaged(spark, sf_dir):
    """whole, fenced, in brackets with others within, object before other braces, bad brackets before a good object, nothing to salvage."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS n", "l_suppkey % 7 AS k", """concat('{"a": "', l_partkey, '"}') AS o""")
    o, k = F.col("o"), F.col("k")
    text = (
        F.when(k == 0, _said(" ", o, "\n")).when(k == 1, _said("Here:\n```json\n[", o, ", {\"a\": \"y\"}]\n``` and ```[]```")).when(k == 2, _said("rows [", o, ", {\"a\": \"[1]\"}] of [2]"))
        .when(k == 3, _said("so ", o, " then {\"b\": \"2\"}")).when(k == 4, _said("see [1, then ] ", o, " and {")).when(k == 5, _said("```\n", o, "\n```")).otherwise(_said("cut [", o, ", {\"a\"")))
    s = terms.salvaged_json(text)
    kept = F.when(k < 6, F.try_element_at(s, F.lit(1))["a"]).otherwise(F.when(F.size(s) > 1, F.lit("too much")))
    return rows.select("id", "n", kept.alias("first"), F.when((k < 6) & s.isNotNull(), F.size(s)).alias("size"))


@query("a28_error_reasons", """WITH r AS (SELECT 'f' || (user_id % 97) AS file, event_id, row_number() OVER (PARTITION BY user_id % 97 ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id % 97) AS c,
 'section ''' || event_type || '''' || CASE event_id % 4 WHEN 0 THEN ' too large for the model (' || format('{:,}', event_id * 977) || ' input tokens > 1,048,576 max). Pre-parser cap should have prevented this — check carrier config.'
 WHEN 1 THEN ' (sub_account=' || user_id || ') timed out' WHEN 2 THEN ': token limit of page ' || event_id ELSE ': INVALID_ARGUMENT token count ' || event_id END AS reason FROM events)
SELECT file, string_agg(reason, '; ' ORDER BY n) FILTER (n <= 3) || CASE WHEN max(c) > 3 THEN ' …' ELSE '' END AS summary FROM r GROUP BY 1""")
def error_reasons(spark, sf_dir):
    """A28."""
    k, e = F.col("event_id") % 4, table(spark, sf_dir, "events")
    message = (
        F.when(k == 0, _said("400 INVALID_ARGUMENT: The input token count (", (F.col("event_id") * 977).cast("string"), ") exceeds the maximum number of tokens allowed (1048576).\ntrace")).when(k == 1, _said("asyncio.TimeoutError at ", F.col("event_id").cast("string")))
        .when(k == 2, _said("token limit of page ", F.col("event_id").cast("string"), "\r\nTraceback")).otherwise(_said("INVALID_ARGUMENT token count ", F.col("event_id").cast("string"))))
    return marts.error_reasons(e.select(F.concat(F.lit("f"), (F.col("user_id") % 97).cast("string")).alias("file"), F.col("event_id").alias("at"), F.col("event_type").alias("section"), F.col("user_id").cast("string").alias("sub_account"), message.alias("message")))


CALLS = "c AS (SELECT event_id, event_type AS backend, (user_id % 1000) * 15 + event_id * 60 AS cost FROM events), t AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM c), s AS (SELECT *, CASE WHEN total >= 20 * 1e8 THEN 'blocked' WHEN total >= 16 * 1e8 THEN 'warning' ELSE 'ok' END AS state FROM t)"


def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("backend"), F.lit("flash").alias("tier"), (F.col("user_id") % 1000).alias("tokens_in"), F.col("event_id").alias("tokens_out"))


@query("a22_ledger", f"WITH {CALLS} SELECT event_id, total::bigint AS total_e8, state FROM s")
def ledger(spark, sf_dir):
    """What was spent before each call, and where the cap falls."""
    return marts.ledger(calls(spark, sf_dir), ["event_id"], cap=20.0).select("event_id", (F.col("total") * 100_000_000).cast("long").alias("total_e8"), "state")


@query("a22_spend", f"WITH {CALLS} SELECT backend, round(coalesce(sum(cost) FILTER (state <> 'blocked'), 0)::double / 1e8, 6) AS cost, count(*) FILTER (state <> 'blocked') AS made, count(*) FILTER (state = 'blocked') AS blocked FROM s GROUP BY GROUPING SETS ((backend), ())")
def spend(spark, sf_dir):
    """By backend and in total."""
    return marts.spend(calls(spark, sf_dir), ["event_id"], cap=20.0)


# --- matching and conflicts ----------------------------------------------------------------------------------------------

@inv("j24_any_account")
def _(df):
    """Whole tables under any account; tests hold it against the rule taken one key after the other."""
    rows = df.withColumn("sub_account_number_2", F.lit(None).cast("string"))
    return evaluate.pair_by_any_account(rows.filter("doc_type = 'invoice'"), rows.filter("doc_type = 'csr'"))


@inv("j34_picked", f""", g AS (SELECT *, {d('carrier_account_number')} AS k, row_number() OVER (PARTITION BY {d('carrier_account_number')} ORDER BY CASE doc_type WHEN 'invoice' THEN 10 WHEN 'csr' THEN 8 WHEN 'contract' THEN 7 ELSE 5 END DESC, doc_seq, row_seq) AS at_ FROM inv),
 c AS (SELECT a.k, a.row_type AS value_a, b.row_type AS value_b, b.doc_id AS doc_b FROM g a JOIN g b ON a.k = b.k AND a.at_ = 1 AND b.at_ > 1 AND a.row_type <> b.row_type AND a.doc_type <> b.doc_type),
 p AS (SELECT k, arg_max(CASE WHEN ascii(right(doc_b, 1)) % 2 = 0 THEN value_b ELSE value_a END, doc_b) AS picked FROM (SELECT DISTINCT * FROM c) WHERE ascii(right(doc_b, 1)) % 5 > 0 GROUP BY 1)
 SELECT g.k, coalesce(picked, row_type) AS row_type, city FROM g LEFT JOIN p ON p.k = g.k WHERE at_ = 1""")
def _(df):
    """Picks of reviewers reach the rows; ids that aren't there do nothing."""
    keyed = df.withColumn("k", X.digits(F.coalesce("carrier_account_number", F.lit(""))))
    found = merge.conflicts(keyed, ["k"], ["row_type"])
    digit = F.ascii(F.right("doc_b", F.lit(1)))
    picks = found.filter(digit % 5 > 0).select("conflict_id", F.when(digit % 2 == 0, "b").otherwise("a").alias("pick")).distinct().unionByName(found.select(F.lit("no such id").alias("conflict_id"), F.lit("b").alias("pick")).limit(1))
    order = Window.partitionBy("k").orderBy(F.desc(merge.base_order(F.col("doc_type"))), "doc_seq", "row_seq")
    base = keyed.withColumn("_at", F.row_number().over(order)).filter("_at = 1").select("k", "row_type", "city")
    return merge.apply_picks(base, found, picks, ["k"], ["row_type"])


# --- likeness ------------------------------------------------------------------------------------------------------------

CORRECTIONS = "c AS (SELECT vec_id, 'c' || (vec_id % 3) AS carrier, 'f' || (label % 4) AS field_name, 'was ' || vec_id AS extracted_value, 'v' || (label % 3) AS corrected_value, embedding::double[] AS e FROM embeddings WHERE vec_id % 7 > 0)"


@query("j32_similar_hints", f"""WITH {CORRECTIONS}, q AS (SELECT vec_id AS q_id, 'c' || (vec_id % 3) AS carrier, embedding::double[] AS e FROM embeddings WHERE vec_id % 50 = 0),
 n AS (SELECT q_id, c.*, round(list_cosine_similarity(q.e, c.e), 6) AS s FROM q JOIN c USING (carrier)), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, vec_id) AS place FROM n)
 SELECT q_id, field_name, corrected_value AS correct_value, arg_min(extracted_value, place) AS wrong_value, count(*) AS n FROM k WHERE place <= 10 GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def similar_hints(spark, sf_dir):
    """The questions are the rows whose id is divisible by 50, against all corrections."""
    v = table(spark, sf_dir, "embeddings").withColumn("carrier", F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")))
    named = v.select(F.col("vec_id").alias("corr_id"), "carrier", F.concat(F.lit("f"), (F.col("label") % 4).cast("string")).alias("field_name"), F.concat(F.lit("was "), F.col("vec_id").cast("string")).alias("extracted_value"), F.concat(F.lit("v"), (F.col("label") % 3).cast("string")).alias("corrected_value"), F.when(F.col("vec_id") % 7 > 0, "EXTRACTION").otherwise("MERGE").alias("root_cause"), "embedding")
    return feedback.similar_hints(named, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "carrier", "embedding"))


@query("f24_near_parts")
def near_parts(spark, sf_dir):
    """names and brands of parts against all others; tests hold near_values against every pair."""
    names = table(spark, sf_dir, "part").select(F.lower(F.concat("p_name", F.lit(" "), "p_brand")).alias("value")).distinct()
    return normalize.near_values(names, names.withColumnRenamed("value", "word")).filter("value < word")


# --- versions and plug-ins -----------------------------------------------------------------------------------------------

@query("s19_rows_of_versions", """WITH v1 AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status FROM orders), v2 AS (SELECT id, cust, CASE WHEN id % 7 = 0 THEN 'X' ELSE status END AS status FROM v1 WHERE id % 11 > 0)
SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v1 WHERE id % 2 = 0""")
def rows_of_versions(spark, sf_dir):
    """Three versions of all orders, each read back after the last one replaced the live rows."""
    kept = Versions(spark, folder(spark), ["id"])
    first = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))
    kept.commit(first)
    kept.commit(kept.read().filter("id % 11 > 0").withColumn("status", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("status"))), seen=1)
    kept.commit(kept.read(1).filter("id % 2 = 0"), seen=2)
    a, b, c = (kept.read(n).select(F.lit(n).alias("version"), "*") for n in (1, 2, 3))
    return a.unionByName(b).unionByName(c)


@query("t1_sections_in_sql", f"""SELECT l_orderkey AS id, cast(n AS int) AS section, cast(1000000000000 + l_orderkey * 1000 + n AS varchar) AS sub_account FROM {LINES}""")
def sections_in_sql(spark, sf_dir):
    """T1 and 2.11: the table function, called from SQL."""
    tables.register(spark)
    docs = records(spark, sf_dir, block_line, F.lit(""), F.lit("end"))
    return spark.sql("SELECT d.id, s.section, s.sub_account FROM {docs} d, LATERAL cut_by_boundary(d.text, 'AccountNumber: ([0-9]{{13}})') s", docs=docs)
