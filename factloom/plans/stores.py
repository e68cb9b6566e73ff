"""Queries of the pool, discovery, report and quality jobs, and of the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import url as U
from factloom.operators import discovery as V
from factloom.operators import joins as J
from factloom.operators import pool as P
from factloom.operators import quality as Q
from factloom.operators import report as R
from factloom.operators import scoring as S
from factloom.operators.common import checkpointed
from factloom.operators.dedupe import url_owner
from factloom.plans.registry import AS_OF, NOW, Tables, query
from factloom.rules import text as T
from factloom.sources import files, search
from factloom.sources import history as H
from factloom.streaming.imports import refresh_due

c = F.col

_ARTICLES = """
art AS (SELECT seq, 'https://mp.weixin.qq.com/s?__biz=' || regexp_extract(url, '__biz=([^#]*)', 1) || '&mid=' || regexp_extract(url, 'mid=(\\d+)', 1) || '&idx=' || regexp_extract(url, 'idx=(\\d+)', 1) AS canonical_url,
  CASE WHEN account_name = '' AND fakeid = '' THEN '待识别:orders' ELSE account_name END AS name, fakeid, title,
  CAST(epoch(CAST(publish_time AS TIMESTAMP)) AS BIGINT) - 28800 AS publish_time, TRY_CAST(nullif(read_count, '') AS BIGINT) AS read_count, body_markdown_path,
  CASE WHEN error <> '' THEN 'token=[redacted] failed' ELSE '' END AS error, CASE WHEN discovered_at <> '' THEN substr(discovered_at, 1, 19) || '+00:00' ELSE '' END AS discovered_at,
  copyright_type, copyright_stat, is_deleted = '1' AS is_deleted, 'msgid:' || msgid AS group_key FROM imports WHERE seq % 41 <> 0),
keyed AS (SELECT *, CASE WHEN fakeid <> '' THEN 'fakeid:' || lower(fakeid) ELSE 'name:' || lower(name) END AS account_key FROM art)"""
_POOL = _ARTICLES + """,
pool AS (SELECT account_key, canonical_url, max(seq) AS id, coalesce(arg_max(title, seq) FILTER (WHERE title <> ''), '') AS title, arg_max(publish_time, seq) FILTER (WHERE publish_time IS NOT NULL) AS publish_time,
  arg_max(read_count, seq) FILTER (WHERE read_count IS NOT NULL) AS read_count, coalesce(arg_max(body_markdown_path, seq) FILTER (WHERE body_markdown_path <> ''), '') AS body,
  coalesce(arg_max(error, seq) FILTER (WHERE error <> ''), '') AS error, coalesce(arg_max(discovered_at, seq) FILTER (WHERE discovered_at <> ''), '') AS discovered_at,
  arg_max(copyright_type, seq) AS copyright_type, arg_max(copyright_stat, seq) AS copyright_stat, bool_or(is_deleted) AS is_deleted, arg_max(group_key, seq) AS group_key FROM keyed GROUP BY 1, 2)"""
_ORIGINAL = "copyright_type = 1 AND copyright_stat = 1 AND NOT is_deleted"


def _articles(t: Tables) -> DataFrame:
    return P.normalize_articles(t.imports, "待识别:orders", "json_import")


def _pool(t: Tables) -> DataFrame:
    return P.merge_import(_articles(t)).withColumn("id", c("seq"))


@query("import_normalize", "K16 K17 F4 F37 F40 F49 F58", f"""
WITH {_ARTICLES} SELECT i.seq, k.canonical_url, CASE WHEN i.seq % 41 = 0 THEN 'host' END AS reject_reason, k.account_key, k.publish_time, k.error FROM imports i LEFT JOIN keyed k ON k.seq = i.seq WHERE i.seq % 41 <> 0""")
def import_normalize(t: Tables) -> DataFrame:
    rows = _articles(t).filter(c("reject_reason").isNull())
    return rows.select("seq", "canonical_url", "reject_reason", "account_key", "publish_time", "error")


@query("last_nonempty_merge", "A6 S11", f"WITH {_POOL} SELECT account_key, canonical_url, title, publish_time, read_count, body, error, discovered_at, is_deleted, group_key FROM pool")
def last_nonempty_merge(t: Tables) -> DataFrame:
    return _pool(t).select("account_key", "canonical_url", "title", "publish_time", "read_count", c("body_markdown_path").alias("body"), "error",
                           "discovered_at", "is_deleted", "group_key")


@query("scope_counts", "A7 S12", f"""
WITH {_POOL} SELECT account_key, count(DISTINCT group_key) AS publish_groups, count(DISTINCT canonical_url) AS expanded_url_items, count(*) FILTER (WHERE {_ORIGINAL}) AS original_articles FROM pool GROUP BY 1""")
def scope_counts(t: Tables) -> DataFrame:
    return P.scope_counts(_pool(t), ["account_key"])


@query("pool_stats", "A8 J6", f"""
WITH {_POOL} SELECT count(*) AS stored_article_rows, count(DISTINCT canonical_url) AS expanded_url_items, count(DISTINCT (account_key, group_key)) AS publish_groups, count(DISTINCT account_key) AS account_count,
  count(*) FILTER (WHERE {_ORIGINAL}) AS original_articles, count(*) FILTER (WHERE publish_time IS NULL) AS pending_date_items, count(*) FILTER (WHERE error = '' AND publish_time IS NOT NULL AND body <> '') AS ready,
  count(*) FILTER (WHERE error = '' AND (publish_time IS NULL OR body = '')) AS pending, count(*) FILTER (WHERE error <> '') AS failed, count(*) FILTER (WHERE discovered_at <> '') AS discovered_total,
  count(DISTINCT account_key) FILTER (WHERE discovered_at <> '') AS discovered_accounts, max(nullif(discovered_at, '')) AS last_discovery_at, min(publish_time) AS first_publish_time, max(publish_time) AS last_publish_time FROM pool""")
def pool_stats(t: Tables) -> DataFrame:
    return P.pool_stats(_pool(t))


@query("pool_page", "P5 W7 F45", f"""
WITH {_POOL} SELECT id, canonical_url, publish_time FROM pool WHERE error = '' AND publish_time IS NOT NULL AND body <> '' AND publish_time BETWEEN 883584000 - 28800 AND 915120000 - 28801 ORDER BY publish_time DESC, id DESC LIMIT 50 OFFSET 20""")
def pool_page(t: Tables) -> DataFrame:
    from factloom.functions.dates import day_bounds
    low, high = day_bounds("1998-01-01", "1998-12-31")
    return P.list_articles(_pool(t), "ready", low, high, 50, 20).select("id", "canonical_url", "publish_time")


@query("pool_recent", "W10 A8", f"""
WITH {_POOL} SELECT count(*) AS stored_article_rows, count(*) FILTER (WHERE error <> '') AS failed, min(publish_time) AS first_publish_time FROM pool WHERE publish_time BETWEEN 915120000 - 28800 - 30 * 86400 AND 915120000 - 28801""")
def pool_recent(t: Tables) -> DataFrame:
    return P.recent_summary(_pool(t), "1998-12-31", 30).select("stored_article_rows", "failed", "first_publish_time")


@query("pool_row_status", "P6", f"""
WITH {_POOL} SELECT CASE WHEN error <> '' THEN 'failed' WHEN discovered_at <> '' AND body = '' THEN 'discovered' WHEN body <> '' AND publish_time IS NOT NULL THEN 'ready' ELSE 'pending' END AS status,
  CASE WHEN discovered_at <> '' THEN 'discovery' ELSE 'import' END AS source_kind, count(*) AS n FROM pool GROUP BY ALL""")
def pool_row_status(t: Tables) -> DataFrame:
    return P.public_rows(_pool(t)).groupBy("status", "source_kind").agg(F.count(F.lit(1)).alias("n"))


@query("import_preview", "J7 S12", f"""
WITH {_POOL}, old AS (SELECT DISTINCT account_key, canonical_url FROM keyed WHERE seq % 2 = 0)
SELECT (SELECT count(*) FROM imports) AS raw_records, (SELECT count(*) FROM imports WHERE seq % 41 = 0) AS rejected_records, count(*) AS accepted_records,
  count(*) FILTER (WHERE o.account_key IS NULL) AS added_count, count(*) FILTER (WHERE o.account_key IS NOT NULL) AS existing_count,
  (SELECT count(*) FROM keyed) - count(*) AS duplicate_records_removed FROM pool p LEFT JOIN old o ON o.account_key = p.account_key AND o.canonical_url = p.canonical_url""")
def import_preview(t: Tables) -> DataFrame:
    rows = checkpointed(_articles(t).select(*P.PREVIEW_FIELDS))
    stored = P.merge_import(rows.filter("seq % 2 = 0"))
    return P.preview_import(rows, stored).select("raw_records", "rejected_records", "accepted_records", "added_count", "existing_count",
                                                 "duplicate_records_removed")


@query("pool_upsert", "S11 A6", f"""
WITH {_ARTICLES}, ranked AS (SELECT *, CASE WHEN seq % 3 = 0 THEN -1 ELSE seq END AS ord FROM keyed)
SELECT account_key, canonical_url, bool_or(is_deleted) AS is_deleted, max(CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END) = 1 AS was_stored FROM ranked GROUP BY 1, 2""")
def pool_upsert(t: Tables) -> DataFrame:
    rows = _articles(t)
    stored = P.merge_import(rows.filter("seq % 3 = 0")).withColumns({"id": c("seq"), "mark": F.lit("old")}).drop("seq")
    return P.upsert(stored, P.merge_import(rows.filter("seq % 3 <> 0"))).select(
        "account_key", "canonical_url", "is_deleted", (c("mark") == "old").alias("was_stored"))


@query("url_owner", "D5", f"""
WITH {_POOL} SELECT canonical_url, arg_min(account_key, (CASE WHEN body = '' THEN 1 ELSE 0 END, CASE WHEN publish_time IS NULL THEN 1 ELSE 0 END, id)) AS account_id FROM pool GROUP BY 1""")
def owner_of_url(t: Tables) -> DataFrame:
    return url_owner(_pool(t).withColumn("account_id", c("account_key"))).select("canonical_url", "account_id")


@query("articles_with_accounts", "J6", "SELECT o_custkey AS account, c_name AS account_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def articles_with_accounts(t: Tables) -> DataFrame:
    accounts = t.customer.select(c("c_custkey").alias("account_key"), c("c_name").alias("account_name"), F.lit("").alias("fakeid"))
    rows = P.with_accounts(t.orders.select(c("o_custkey").alias("account_key")), accounts)
    return rows.groupBy(c("account_key").alias("account"), "account_name").agg(F.count(F.lit(1)).alias("n"))


@query("new_and_known", "J7", """
SELECT d.doc_id, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def new_and_known(t: Tables) -> DataFrame:
    return J.new_and_known(t.documents, t.labels, ["doc_id"])


@query("history_flatten", "S1 S3 W11 F50 F51", """
SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS source, CAST(i AS VARCHAR) AS itemidx, CASE i WHEN 1 THEN role ELSE role || i END AS title, 'msgid:' || conv_id AS group_key, 'acc' || conv_id % 5 AS account_name,
  2 AS secrets FROM conversations, (SELECT unnest([1, 2, 3]) AS i)""")
def history_flatten(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://mp.weixin.qq.com/s/"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string"))
    child = lambda n: F.struct(F.concat("role", F.lit(n)).alias("title"), F.concat(url, F.lit(f"-{n}")).alias("content_url"))
    ext = F.struct(c("role").alias("title"), url.alias("content_url"), c("text").alias("digest"),
                   F.array(child("2"), child("3")).alias("multi_app_msg_item_list"))
    group = F.struct(F.struct(c("conv_id").alias("id"), F.lit(1705276800).alias("datetime")).alias("comm_msg_info"), ext.alias("app_msg_ext_info"))
    doc = F.struct(F.concat(F.lit("acc"), (c("conv_id") % 5).cast("string")).alias("nickname"), F.lit("x").alias("auth_key"),
                   F.struct(F.lit("y").alias("token"), F.array(group).alias("list")).alias("data"))
    docs = t.conversations.select((c("conv_id") * 1000 + c("turn")).cast("string").alias("source"), F.to_json(doc).alias("text"))
    docs = docs.withColumn("secrets", P.credential_key_count("text"))
    return H.flatten_history(docs).select("source", "itemidx", "title", "group_key", "account_name", "secrets")


# -- discovery ----------------------------------------------------------------------------------------

def _page_hits(t: Tables) -> DataFrame:
    canonical = lambda u: U.canonical_url(u, identity_keys=["page"])["url"]
    rows = t.hits.withColumnRenamed("seq", "row_pos")
    return V.url_hits(rows, canonical, lambda u: F.lit(False))


_CANON = ("'https://' || regexp_extract(trim(url), '^https?://([^?#]*)', 1) || CASE WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) <> '' THEN '?page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1) ELSE '' END")


@query("discovery_rollup", "A9 F5 F52", f"""
WITH k AS (SELECT *, {_CANON} AS canonical_url, query_pos * 1000000 + seq AS ord FROM hits)
SELECT canonical_url, count(*) AS hits, coalesce(arg_min(title, ord) FILTER (WHERE title <> ''), '') AS title, CAST(count(DISTINCT provider) AS INT) AS providers, count(DISTINCT query) AS queries FROM k GROUP BY 1""")
def discovery_rollup(t: Tables) -> DataFrame:
    results, _ = V.discover(_page_hits(t))
    return results.select("canonical_url", "hits", "title", c("retrieval_provider_count").alias("providers"), c("query_hit_count").alias("queries"))


@query("discovery_stats", "A9 A12", f"""
WITH k AS (SELECT *, {_CANON} AS canonical_url, query_pos * 1000000 + seq AS ord FROM hits), f AS (SELECT canonical_url, min(ord) AS ord, arg_min(query_pos, ord) AS qp FROM k GROUP BY 1),
tk AS (SELECT * FROM f ORDER BY ord LIMIT 30), l AS (SELECT max(qp) AS last FROM tk), r AS (SELECT k.*, canonical_url IN (SELECT canonical_url FROM tk) AS taken FROM k, l WHERE query_pos <= last)
SELECT count(DISTINCT query_pos) AS queries_run, count(*) AS raw_results, count(*) AS accepted_hits, 30 AS unique_results, count(*) FILTER (WHERE NOT taken) AS new_urls_capped, count(*) FILTER (WHERE taken) - 30 AS duplicates_removed FROM r""")
def discovery_stats(t: Tables) -> DataFrame:
    _, stats = V.discover(_page_hits(t), new_url_limit=30)
    return stats.select("queries_run", "raw_results", "accepted_hits", "unique_results", "new_urls_capped", "duplicates_removed")


@query("search_leads", "K15 F12", """
SELECT seq, 'T3' AS source_tier, CASE WHEN seq % 2 = 0 THEN 'T1' ELSE 'T2' END AS discovery_source_tier, 'declared' AS traceability, true AS discovery_only FROM hits""")
def search_leads(t: Tables) -> DataFrame:
    rows = t.hits.select("seq", c("url").alias("source_url"), "title", "query", "provider", F.when(c("seq") % 2 == 0, "official").otherwise("other").alias("discovery_source_pack"))
    return V.search_leads(rows).select("seq", "source_tier", "discovery_source_tier", "traceability", "discovery_only")


@query("leads_to_pool", "K14", """
SELECT url, CASE WHEN seq % 3 = 0 THEN '待归属:全网发现' ELSE provider END AS account_name, query AS discovery_query, '' AS body_markdown_path, CAST(NULL AS VARCHAR) AS publish_time FROM hits""")
def leads_to_pool(t: Tables) -> DataFrame:
    rows = t.hits.select(c("url").alias("canonical_url"), "title", F.when(c("seq") % 3 == 0, " ").otherwise(c("provider")).alias("author"),
                         F.array("provider").alias("providers"), "query", c("seq").alias("discovery_rank"))
    return V.leads_to_pool(rows, f"{AS_OF}T00:00:00Z").select("url", "account_name", "discovery_query", "body_markdown_path", "publish_time")


@query("capture_provenance", "K20 S7 F9", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T1' ELSE 'T3' END AS source_tier, CASE WHEN page_id % 2 = 0 THEN 'primary_official' ELSE 'unknown' END AS evidence_tier, 2 AS providers, 'general' AS session_platform FROM pages""")
def capture_provenance(t: Tables) -> DataFrame:
    final = F.when(c("page_id") % 2 == 0, F.concat(F.lit("https://www.gov.cn/"), c("page_id").cast("string"))).otherwise(c("url"))
    rows = t.pages.select("page_id", c("url").alias("requested_url"), final.alias("final_url"), F.array(F.lit("a"), F.lit("b")).alias("providers"))
    return V.capture_provenance(rows).select("page_id", "source_tier", "evidence_tier", c("retrieval_provider_count").alias("providers"), "session_platform")


@query("top_domains", "A10", """
WITH h AS (SELECT rtrim(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '.') AS d, provider FROM hits), x AS (SELECT d AS value, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, value LIMIT 20)
SELECT 'domain' AS kind, value, n FROM x UNION ALL SELECT 'provider', provider, count(*) FROM h GROUP BY 2 UNION ALL SELECT 'source_pack', '未知来源', count(*) FROM h UNION ALL SELECT 'platform', d, count(*) FROM h GROUP BY 2""")
def top_domains(t: Tables) -> DataFrame:
    rows = V.classify_urls(t.hits.select(c("url").alias("u"), F.array("provider").alias("retrieval_providers")), "u")
    return V.coverage(rows)


@query("result_meta", "A18 U4", """
WITH s AS (SELECT rtrim(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '.') AS domain, 1 AS s, 0 AS e FROM pages UNION ALL SELECT regexp_extract(source_url, '^https://([^/]*)', 1), 0, 1 FROM evidence)
SELECT domain, sum(s)::BIGINT AS source_count, sum(e)::BIGINT AS evidence_count FROM s GROUP BY 1""")
def result_meta(t: Tables) -> DataFrame:
    return V.result_meta(t.pages.select(c("url").alias("source_url")), t.evidence.select("source_url"))


SECTORS = [("legal", ["license", "copyright"]), ("insult", ["trash", "disgusting"]), ("french", ["avec", "pour"])]
EVENTS = [("secret", ["token", "password"]), ("plain", ["the", "que"]), ("german", ["und", "keit"])]


def _cells() -> str:
    return " UNION ALL ".join(
        f"SELECT {i * 3 + j + 1} AS cell, '{s}' AS sector, '{e}' AS event, count(*) FILTER (WHERE regexp_matches(lower(text), '{'|'.join(sw)}') AND regexp_matches(lower(text), '{'|'.join(ew)}')) AS n FROM documents"
        for i, (s, sw) in enumerate(SECTORS) for j, (e, ew) in enumerate(EVENTS))


@query("coverage_matrix", "J11", _cells())
def coverage_matrix(t: Tables) -> DataFrame:
    return J.coverage_matrix(t.documents, SECTORS, EVENTS, budget=len(SECTORS) * len(EVENTS))


@query("search_text_rows", "S8", """
SELECT page_id, url, CASE WHEN i = 1 THEN 'Page ' || page_id ELSE 'link' END AS title FROM (SELECT page_id, 'https://a.example/' || page_id || '/' || i AS url, i FROM pages, (SELECT unnest([1, 2]) AS i))""")
def search_text_rows(t: Tables) -> DataFrame:
    n = c("page_id").cast("string")
    text = F.concat(F.lit("Title: Page "), n, F.lit("\nURL: https://a.example/"), n, F.lit("/1.\nAuthor: none\n---\n see [link](https://a.example/"), n,
                    F.lit("/2) and https://a.example/"), n, F.lit("/1"))
    return search.text_rows(t.pages.select("page_id", text.alias("text"))).select("page_id", "url", "title")


@query("search_json_rows", "S8", "SELECT page_id, url, 'T' || page_id AS title FROM pages")
def search_json_rows(t: Tables) -> DataFrame:
    hit = F.struct(c("url").alias("link"), F.concat(F.lit("T"), c("page_id").cast("string")).alias("name"))
    text = F.when(c("page_id") % 3 == 0, F.to_json(F.struct(F.array(hit).alias("results")))).when(
        c("page_id") % 3 == 1, F.to_json(F.array(hit))).otherwise(F.to_json(F.struct(F.struct(F.array(hit).alias("items")).alias("data"))))
    return search.json_rows(t.pages.select("page_id", text.alias("text"))).select("page_id", "url", "title")


@query("url_list", "S9", """
SELECT url, min(page_id) AS line FROM pages WHERE page_id % 4 <> 0 GROUP BY 1""")
def url_list(t: Tables) -> DataFrame:
    value = F.when(c("page_id") % 4 == 0, "# note").otherwise(F.concat(F.lit("  "), "url", F.lit(" ，ftp://x")))
    return files.url_list(t.pages.select(c("page_id").alias("line"), value.alias("value")), None).select("url", "line")


@query("dated_links", "S5", """
SELECT 'https://mp.weixin.qq.com/s/' || page_id AS url, 'story ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN '2024-01-05' ELSE '' END AS publish_time FROM pages WHERE page_id % 5 <> 0""")
def dated_links(t: Tables) -> DataFrame:
    n = c("page_id").cast("string")
    rows = t.pages.select(F.when(c("page_id") % 5 == 0, c("url")).otherwise(F.concat(F.lit("http://mp.weixin.qq.com/s/"), n, F.lit("?x=1"))).alias("url"),
                          F.concat(F.lit("story "), n, F.when(c("page_id") % 2 == 0, " - 2024-01-05").otherwise("")).alias("title"), F.lit(None).cast("string").alias("account_name"))
    return files.dated_links(rows).select("url", "title", "publish_time")


@query("feed_items", "S6", "SELECT page_id, 'News ' || page_id AS title, url FROM pages")
def feed_items(t: Tables) -> DataFrame:
    n = c("page_id").cast("string")
    item = F.concat(F.lit("<title>News "), n, F.lit(" - Desk &amp;amp; Co</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")),
                    F.lit("</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate><source url=\"https://d.example\">Desk &amp;amp; Co</source>"))
    return files.feed_records(t.pages.select(c("page_id").alias("feed"), F.lit(0).alias("pos"), item.alias("item"))).select(c("feed").alias("page_id"), "title", "url")


@query("reconcile_batch", "J5 S10", """
WITH idx AS (SELECT l_orderkey AS k, arg_min(l_returnflag, (l_linenumber, l_partkey, l_extendedprice, l_returnflag)) AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey AS seq, CASE f WHEN 'A' THEN 'success' WHEN 'N' THEN 'invalid_body_path' WHEN 'R' THEN 'download_failed' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'download_failed' ELSE 'missing_result' END END AS status FROM orders LEFT JOIN idx ON k = o_orderkey""")
def reconcile_batch(t: Tables) -> DataFrame:
    index = t.lineitem.select(c("l_orderkey").alias("url"), F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag").alias("seq"),
                              F.when(c("l_returnflag") == "R", "failed").otherwise("success").alias("status"), (c("l_returnflag") == "A").alias("body_ok"), F.lit("").alias("error"))
    errors = t.orders.filter("o_orderkey % 2 = 0").select(c("o_orderkey").alias("url"), c("o_orderkey").alias("seq"), F.lit("token=abc").alias("error"))
    out = J.reconcile_batch(t.orders.select(c("o_orderkey").alias("url"), c("o_orderkey").alias("seq")), index, errors)
    return out.select(c("request_seq").alias("seq"), "status")


# -- reports and quality --------------------------------------------------------------------------------

@query("status_rollup", "A12", """
SELECT CAST(ts AS DATE) AS day, CASE WHEN count(*) FILTER (WHERE event_type <> 'error') = 0 THEN 'error' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'partial' ELSE 'ok' END AS status,
  count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1""")
def status_rollup(t: Tables) -> DataFrame:
    rows = t.events.select(F.to_date("ts").alias("day"), (c("event_type") != "error").alias("ok"), F.lit(1).alias("items"))
    return R.status_rollup(rows, ["day"]).select("day", "status", "succeeded", "failed")


@query("error_summary", "A17", """
WITH e AS (SELECT user_id, props AS m, min(event_id) AS o FROM events WHERE event_type = 'error' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS rn FROM e)
SELECT user_id, string_agg(m, '；' ORDER BY rn) AS error_summary FROM r WHERE rn <= 2 GROUP BY 1""")
def error_summary(t: Tables) -> DataFrame:
    rows = t.events.filter("event_type = 'error'").select("user_id", c("event_id").alias("seq"), c("props").alias("error"))
    return R.error_summary(rows, ["user_id"])


@query("report_freshness", "F46", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN CAST(o_orderdate AS DATE) = DATE '1998-08-02' THEN 'fresh' ELSE 'stale' END AS state,
  CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE greatest(0, DATE '1998-08-02' - CAST(o_orderdate AS DATE)) END::INT AS age FROM orders""")
def report_freshness(t: Tables) -> DataFrame:
    day = F.when(c("o_orderkey") % 7 != 0, F.substring(c("o_orderdate").cast("string"), 1, 10))
    rows = R.freshness(t.orders.select("o_orderkey", day.alias("window_end"), day.alias("generated_at")), "1998-08-02")
    return rows.select("o_orderkey", c("freshness_state").alias("state"), c("cache_age_days").cast("int").alias("age"))


@query("publish_decision", "S13", """
WITH r AS (SELECT o_orderkey, o_orderkey % 3 AS u, o_orderkey % 2 AS d, o_orderkey % 5 AS n, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 - 1 END AS old FROM orders)
SELECT o_orderkey, CASE WHEN u = 0 AND old IS NOT NULL THEN 'stale_cache' WHEN u = 0 THEN 'refresh_failed' WHEN d > 0 AND n = 0 AND coalesce(old, 0) > 0 THEN 'stale_cache' WHEN d > 0 AND n > 0 THEN 'partial' WHEN n > 0 THEN 'ok' ELSE 'empty' END AS weekly,
  CASE WHEN u = 0 THEN 'no_verified_evidence' WHEN n = 0 THEN 'no_candidate_entities' ELSE 'ok' END AS deep FROM r""")
def publish_decision(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    runs = t.orders.select("o_orderkey", (k % 3).alias("usable_sources"), (k % 2).alias("degraded_sources"), (k % 5).alias("candidates"),
                           F.when(k % 4 > 0, k % 4 - 1).alias("old_candidates"), (k % 3).alias("evidence"))
    weekly = R.weekly_decision(runs).withColumnRenamed("status", "weekly").drop("publish")
    return R.deep_decision(weekly).select("o_orderkey", "weekly", c("status").alias("deep"))


@query("last_good_report", "S16", """
SELECT o_custkey, max(o_orderkey) AS run_id FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def last_good_report(t: Tables) -> DataFrame:
    done = F.when(c("o_orderstatus") != "F", "{}")
    runs = t.orders.select("o_custkey", c("o_orderkey").alias("run_id"), c("o_orderdate").alias("window_end"), F.lit("ok").alias("status"),
                           done.alias("source_status"), F.lit(1).alias("candidates"), F.lit(4).alias("empty_slots"))
    return R.last_good(runs, ["o_custkey"]).select("o_custkey", "run_id")


@query("report_stats", "A11")
def report_stats(t: Tables) -> DataFrame:
    return R.report_stats(S.score_companies(t.evidence, NOW))


@query("candidate_view", "K18 F39 F38")
def candidate_view(t: Tables) -> DataFrame:
    return R.candidate_view(S.score_companies(t.evidence, NOW))


@query("evidence_view", "K18 F39", """
SELECT seq, CASE WHEN importance IS NULL THEN 0 ELSE importance END AS importance, CASE WHEN retrieval_provider_count >= 2 THEN retrieval_provider_count || ' 个检索渠道命中（非独立互证）' ELSE '' END AS provider_text, '未标注' AS traceability_label FROM evidence""")
def evidence_view(t: Tables) -> DataFrame:
    rows = t.evidence.withColumns({"provider_count": F.lit(None).cast("int"), "traceability": F.lit("")})
    return R.evidence_view(rows).select("seq", "importance", "provider_text", "traceability_label")


@query("evidence_coverage", "A11 U4", """
SELECT count(*) AS result_count, count(*) FILTER (WHERE quote <> '') AS traceable_result_count, count(DISTINCT regexp_extract(source_url, '^https://([^/]*)', 1)) AS source_domain_count FROM evidence""")
def evidence_coverage(t: Tables) -> DataFrame:
    return R.evidence_coverage(t.evidence)


@query("leak_scan", "P8", f"""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN text || ' /home/me' ELSE text END AS x FROM documents)
SELECT doc_id, 'private_marker:/home/' AS violation FROM d WHERE contains(lower(x), '/home/') UNION ALL
SELECT doc_id, 'secret:2' FROM d WHERE regexp_matches(x, '(?i)\\b(?:{T.SECRET_KEYS})\\b\\s*[:=]\\s*[^\\s,;]+') UNION ALL
SELECT doc_id, 'secret:0' FROM d WHERE regexp_matches(x, '-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----')""")
def leak_scan(t: Tables) -> DataFrame:
    text = F.when(c("doc_id") % 50 == 0, F.concat("text", F.lit(" /home/me"))).otherwise(c("text"))
    # The twin does not state rule secret:1 (quoted secrets); a test compares it with brute force.
    return Q.leak_scan(t.documents.select("doc_id", text.alias("text")), patterns=Q.secret_patterns()).select("doc_id", "violation")


@query("demo_quarantine", "F53", """
SELECT page_id % 10 AS report_id, bool_or(page_id % 13 = 0) AS is_demo, count(*) FILTER (WHERE page_id % 13 = 0) AS demo_rows FROM pages GROUP BY 1""")
def demo_quarantine(t: Tables) -> DataFrame:
    url = F.when(c("page_id") % 13 == 0, "https://demo.invalid/a").otherwise(F.concat(F.lit("https://r.example.org/x"), c("page_id").cast("string")))
    return Q.demo_reports(t.pages.select((c("page_id") % 10).alias("report_id"), url.alias("source_url")))


@query("refresh_due", "T2", """
WITH r AS (SELECT user_id AS source, arg_max(CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END, event_id) AS status, max(substr(CAST(ts AS VARCHAR), 1, 19)) AS f FROM events GROUP BY 1)
SELECT source, status, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(CAST(f AS TIMESTAMP)) >= CASE WHEN status = 'error' THEN 3600 ELSE 86400 END AS due FROM r""")
def refresh_runs(t: Tables) -> DataFrame:
    runs = t.events.select(c("user_id").alias("source"), F.when(c("event_type") == "error", "error").otherwise("ok").alias("status"),
                           F.substring(c("ts").cast("string"), 1, 19).alias("finished_at"))
    return refresh_due(runs, NOW).select("source", "status", "due")


@query("clean_terms", "J11", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS INT) AS terms FROM nation")
def clean_terms(t: Tables) -> DataFrame:
    terms = F.array(F.concat(F.lit('"'), "n_name", F.lit('"')), F.lower("n_name"), F.when(c("n_nationkey") % 2 == 0, "").otherwise("x"))
    return t.nation.select("n_nationkey", F.size(J.clean_terms(c("n_name"), terms)).alias("terms"))
