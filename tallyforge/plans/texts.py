"""Queries over texts, pages, events and vectors: chunking, sniffing, classification, versions, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as X
from ..operators import chunk, classify, feedback, lifecycle, marts
from .catalogue import query, table

NAMES = "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'ATT_BILL' || page_id || '.pdf' WHEN 1 THEN 'csr_export.xlsx' WHEN 2 THEN 'Signed Quote 7.pdf' WHEN 3 THEN 'usage-report.csv' WHEN 4 THEN 'did_list.csv' WHEN 5 THEN 'plan details.pdf' WHEN 6 THEN 'hello.eml' ELSE 'scan001.pdf' END AS file_name FROM pages"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NAMES.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))


TYPES = f"SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'invoice' WHEN 1 THEN 'csr' WHEN 2 THEN 'contract' WHEN 3 THEN 'report' WHEN 4 THEN 'did_list' WHEN 5 THEN 'subscription' WHEN 6 THEN 'email' END AS doc_type FROM ({NAMES})"


@query("f17_document_types_all", TYPES)
@query("f17_document_types", TYPES)
def document_types(spark, sf_dir):
    """F17, for every page, whatever the number in its name."""
    return names(spark, sf_dir).select("page_id", X.document_type(F.col("file_name")).alias("doc_type"))


@query("s17_router", f"SELECT page_id, CASE WHEN regexp_matches(file_name, '\\.(xlsx|csv)$') THEN 'structured' WHEN file_name LIKE '%.eml' THEN 'email' ELSE 'raw_text' END AS route FROM ({NAMES})")
def router(spark, sf_dir):
    """S17, P15."""
    from ..sources.files import route

    return names(spark, sf_dir).select("page_id", route(F.col("file_name")).alias("route"))


@query("j16_filename_patterns", f"SELECT page_id, CASE WHEN file_name LIKE 'ATT_%' THEN 'att' WHEN file_name LIKE 'csr_%' THEN 'windstream' END AS carrier, CASE WHEN file_name LIKE 'ATT_%' THEN 'high' WHEN file_name LIKE 'csr_%' THEN 'medium' ELSE 'low' END AS level FROM ({NAMES})")
def filename_patterns(spark, sf_dir):
    """J16."""
    rules = spark.createDataFrame([("att", "invoice", "(?i)^att_", 0.9, 0), ("peerless", "invoice", "(?i)bill", 0.5, 1), ("windstream", "csr", "(?i)^csr", 0.8, 2)], "carrier string, doc_type string, pattern string, confidence double, position int")
    return classify.by_filename(names(spark, sf_dir).withColumn("doc_id", F.col("page_id").cast("string")), rules).select("page_id", "carrier", "level")


@query("j17_content_signals", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'a' WHEN contains(lower(text), ' the ') THEN 'b' END AS carrier, CASE WHEN contains(lower(text), 'license') THEN CASE WHEN contains(lower(text), 'mit') THEN 'invoice' WHEN contains(lower(text), 'gnu') THEN 'csr' END END AS doc_type FROM documents")
def content_signals(spark, sf_dir):
    """J17."""
    return classify.by_content(table(spark, sf_dir, "documents"), [("b", [" the "], []), ("a", ["license"], [("invoice", "MIT"), ("csr", "GNU")])]).select("doc_id", "carrier", "doc_type")


@query("j18_deep_scan", r"""WITH p AS (SELECT doc_id, 5 * regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])license($|[^\p{L}\p{N}_])')::int + 10 * contains(lower(text), 'mit license')::int + 2 * len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS mit,
 5 * regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])version($|[^\p{L}\p{N}_])')::int + 10 * contains(lower(text), 'gnu')::int + 2 * len(regexp_extract_all(text, '\b[0-9]{5}\b')) AS gnu FROM documents)
SELECT doc_id, CASE WHEN greatest(mit, gnu) >= 5 AND greatest(mit, gnu) >= 2 * least(mit, gnu) THEN CASE WHEN mit >= gnu THEN 'mit' ELSE 'gnu' END END AS carrier, greatest(mit, gnu)::int AS points FROM p""")
def deep_scan(spark, sf_dir):
    """Word boundaries and counts."""
    return classify.deep_scan(table(spark, sf_dir, "documents"), [("mit", "MIT License", ["license"], [r"\d{3}-\d{4}"]), ("gnu", "GNU", ["version"], [r"\b\d{5}\b"])]).select("doc_id", "carrier", "points")


@query("j19_signatures", "SELECT doc_id, contains(lower(text), 'license') AND (contains(lower(text), 'mit') OR contains(lower(text), 'apache')) AS fits FROM documents")
def signatures(spark, sf_dir):
    """J19."""
    return table(spark, sf_dir, "documents").select("doc_id", classify.signature(F.col("text"), ["license"], ["mit", "apache"]).alias("fits"))


@query("f21_html_text", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n FROM pages")
def html_text(spark, sf_dir):
    """F21."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(X.html_text(F.col("html"))).cast("long").alias("n"))


@query("f22_candidates", r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b(\d{3}[-.]?\d{3}[-.]?\d{4})\b', 1))) AS phones, len(regexp_extract_all(text, '\$?([\d,]+\.\d{2})\b', 1)) AS amounts FROM documents")
def candidates(spark, sf_dir):
    """F22."""
    c = X.candidates(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(c["phones"]).cast("long").alias("phones"), F.size(c["amounts"]).cast("long").alias("amounts"))


@query("f23_line_items")
def line_items(spark, sf_dir):
    """F23."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.line_items(t).alias("items"), X.under_extracted(F.lit(1), t).alias("under"))


@query("t1_boundaries", r"SELECT doc_id, len(string_split(text, chr(10) || 'The ')) - 1 AS sections FROM documents WHERE contains(text, chr(10) || 'The ')")
def boundaries(spark, sf_dir):
    """T1."""
    return chunk.by_boundary(table(spark, sf_dir, "documents"), r"\n(The) ").groupBy("doc_id").agg(F.count("*").alias("sections"))


@query("t3_page_groups", "SELECT conv_id, turn // 3 AS chunk, count(*) AS pages, min(turn) AS first_page FROM conversations GROUP BY ALL")
def page_groups(spark, sf_dir):
    """Turns stand for pages."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    out = chunk.by_pages(pages, 3, ("conv_id",))
    return out.select("conv_id", F.col("chunk").cast("long").alias("chunk"), (F.col("last_page") - F.col("first_page") + 1).alias("pages"), "first_page")


@query("t4_size_parts")
def size_parts(spark, sf_dir):
    """T4."""
    return chunk.by_size(table(spark, sf_dir, "documents").select("doc_id", "text"), 2_000).groupBy("doc_id").agg(F.count("*").alias("parts"), F.max(F.length("part_text")).alias("longest"))


@query("t5_row_chunks", "SELECT cast(event_id // 100 AS int) AS chunk, count(*) AS n FROM events GROUP BY 1")
def row_chunks(spark, sf_dir):
    """T5."""
    return chunk.by_rows(table(spark, sf_dir, "events"), "event_id").groupBy("chunk").agg(F.count("*").alias("n"))


@query("t9_context", "SELECT doc_id, 'Carrier: ' || source || chr(10) || substr(text, 1, 500) AS context FROM documents")
def context(spark, sf_dir):
    """T9."""
    return table(spark, sf_dir, "documents").select("doc_id", chunk.context(F.col("source"), F.col("text")).alias("context"))


@query("s11_sniff", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)) AS head FROM documents")
def sniff(spark, sf_dir):
    """The first lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, 5), "\n").alias("head"))


@query("j29_file_versions", "SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) THEN 'duplicate' WHEN source IN (SELECT source FROM documents WHERE doc_id % 2 = 0) THEN 'new_version' ELSE 'new' END AS verdict FROM documents WHERE doc_id % 2 = 1")
def file_versions(spark, sf_dir):
    """J29, K5."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name"), F.col("text").alias("content"))
    old = d.filter("doc_id % 2 = 0").select("file_name", F.sha2("content", 256).alias("content_hash"))
    return lifecycle.file_versions(d.filter("doc_id % 2 = 1"), old).select("doc_id", "verdict")


@query("w1_exact_duplicates", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def exact_duplicates(spark, sf_dir):
    """W1 by content."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("j32_nearest_vectors", "SELECT vec_id, round(list_cosine_similarity(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10")
def nearest_vectors(spark, sf_dir):
    """J32."""
    v = table(spark, sf_dir, "embeddings")
    return feedback.nearest(v, list(v.filter("vec_id = 0").first()["embedding"])).select("vec_id", "similarity")


@query("a4_json_levels", "SELECT json_extract_string(props, '$.k') AS overall, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def json_levels(spark, sf_dir):
    """A4, F36."""
    return marts.counts(table(spark, sf_dir, "events"), terms.json_field(F.col("props"), "k"), "overall", False)


@query("a9_top_fields", "SELECT event_type AS field_name, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def top_fields(spark, sf_dir):
    """A9, L2."""
    return feedback.top_fields(table(spark, sf_dir, "events").select(F.col("event_type").alias("field_name")))


@query("a10_by_carrier", "SELECT cast(user_id % 20 AS int) AS carrier, count(*) AS n FROM events GROUP BY 1")
def corrections_by_carrier(spark, sf_dir):
    """A10."""
    return feedback.by_carrier(table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("int").alias("carrier")))


@query("a6_live", "SELECT count(*) FILTER (o_orderkey % 10 <> 0) AS uploads, count(*) FILTER (o_orderkey % 10 = 0) AS bin, count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderstatus = 'O') AS active, count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderstatus = 'P') AS failed, cast(sum(o_orderkey % 5) FILTER (o_orderkey % 10 <> 0) AS bigint) AS files FROM orders")
def live(spark, sf_dir):
    """A6."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "extracting").when(F.col("o_orderstatus") == "P", "error").otherwise("done")
    return marts.live(o.select(status.alias("status"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderdate")).alias("deleted_at"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 5).alias("n_files"))).drop("oldest_active")


@query("j26_client_counts", "SELECT c_custkey AS client_id, coalesce(o.n, 0) AS uploads, coalesce(e.n, 0) AS entries FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON c_custkey = user_id")
def client_counts(spark, sf_dir):
    """J26."""
    t = lambda n: table(spark, sf_dir, n)
    return marts.client_counts(t("customer").select(F.col("c_custkey").alias("client_id")), t("orders").select(F.col("o_custkey").alias("client_id")), t("events").select(F.col("user_id").alias("client_id")))


@query("j28_find_or_create", "SELECT c_mktsegment AS name FROM customer GROUP BY 1 UNION ALL SELECT DISTINCT r_name FROM region WHERE lower(r_name) NOT IN (SELECT lower(c_mktsegment) FROM customer)")
def find_or_create(spark, sf_dir):
    """J28."""
    have = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return lifecycle.find_or_create(have, table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query("l1_recent_runs", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_runs(spark, sf_dir):
    """L1."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey")


@query("s16_live_uploads", "SELECT o_orderkey AS short_id FROM orders WHERE o_orderkey % 10 <> 0")
def live_uploads(spark, sf_dir):
    """S16, P12, L4."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("short_id"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderdate")).alias("deleted_at"), F.col("o_orderdate").alias("created_at"))
    return lifecycle.listed(o).select("short_id")


@query("w2_extraction_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS extraction_order FROM events")
def extraction_order(spark, sf_dir):
    """W2."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("upload_id"), F.lit(0).alias("file_seq"), F.lit(0).alias("section_seq"), F.col("event_id").alias("row_seq"))
    return lifecycle.extraction_order(e).select("event_id", F.col("extraction_order").cast("long").alias("extraction_order"))


@query("w6_top_two", "SELECT user_id, max(n) FILTER (r = 1) AS best_score, max(n) FILTER (r = 2) AS next_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1")
def top_two(spark, sf_dir):
    """W6."""
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return classify.top_two(s, "user_id", "n", "event_type").select("user_id", "best_score", "next_score")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Our own extension: tumbling windows."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
