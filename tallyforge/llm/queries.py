"""The corpus operators as queries over the whole `documents` table, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op7_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(documents(spark, sf_dir))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_orc import tokens_round_trip

    return tokens_round_trip(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json")).drop("file")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("longest")


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_jpeg import text_media

    return text_media(documents(spark, sf_dir))


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import documents_round_trip

    return documents_round_trip(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op8_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minmax_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), k=3, percent=85)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(documents(spark, sf_dir))


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attention_lm import score_documents

    return score_documents(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .structure_repair import audited, damaged, repair_parts

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audited(conversations, *repair_parts(damaged(conversations)))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(documents(spark, sf_dir))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULES, judge_urls, rule_table

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op")}


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g, least(len(w), 13) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (g, n)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

_OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, w.doc_id = min(r.c) AS kept FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY w.doc_id, n.n"""


_OP12 = rf"""WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_AZ}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY 1),
f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k >= 2),
s AS (SELECT lang, f, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM (SELECT lang, a AS f, k, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k)),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, g, max(f) AS longer FROM s GROUP BY 1, 2) USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT lang, g, a, h, array_to_string(list_slice(w, 1, h), ' ') AS x, array_to_string(list_slice(w, h + 1, k), ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS h FROM kept)),
scored AS (SELECT cuts.lang, cuts.g, a, h, x.f AS l, y.f AS r, t.n, (1000::hugeint * a * t.n::hugeint) // (x.f::hugeint * y.f) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = cuts.x JOIN f y ON y.lang = cuts.lang AND y.g = cuts.y JOIN t ON t.lang = cuts.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, h) AS turn FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best WHERE turn = 1)
SELECT lang, rank, g AS phrase, a, l, r, n::bigint AS n, score::bigint AS score FROM ranked WHERE rank <= 2000"""

_OP13 = r"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (SELECT p.*, (SELECT arg_max({'rule': h || q, 'verdict': v}, length(h || q)) FROM r WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) AS m FROM p)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM j"""


def oracle_sql() -> dict[str, str]:
    """SQL of whole results; the other operators need a tokenizer, a trained model, a stored file or a sort of all suffixes."""
    return {"op2_benchmark_decontamination": _OP2, "op3_minmax_near_dedup": _OP3, "op12_phrase_collocations": _OP12, "op13_url_filter": _OP13}
