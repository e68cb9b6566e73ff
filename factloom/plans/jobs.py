"""Queries of the evidence, scoring and radar jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import entity as N
from factloom.functions import html as H
from factloom.functions import url as U
from factloom.operators import dedupe as P
from factloom.operators import evidence as E
from factloom.operators import joins as J
from factloom.operators import radar as R
from factloom.operators import scoring as S
from factloom.operators.common import checkpointed, indexed
from factloom.plans.columns import HOST_RULES, HOST_SQL, _rule_values, _page_text_sql
from factloom.plans.registry import AS_OF, NOW, Tables, query
from factloom.rules import radar as RR
from factloom.rules import scoring as SR
from factloom.rules import sources as SS
from factloom.rules import text as T

c = F.col
TOPIC = "量产 国产替代，license avec"

# -- building blocks of the twins ---------------------------------------------------------------------

_KEY = (f"regexp_replace(regexp_replace(regexp_replace(lower(trim(entity)), '[（(][^）)]{{0,60}}[）)]', '', 'g'), "
        f"'[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g'), '^(.{{2,}}?)(?:{'|'.join(T.LEGAL_SUFFIXES)})+$', '\\1')")
_ALIAS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SS.TIER_ALIASES.items())
_POINTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SS.TIER_SCORES["score"].items())
_ITEMS = f"""
items AS (SELECT e.*, {_KEY} AS entity_key, regexp_extract(source_url, '^https://([^/]*)', 1) AS domain,
    CASE WHEN source_tier = 'T1/T2' THEN 'T1/T2' WHEN source_tier <> '' THEN CASE source_tier {_ALIAS} END
      ELSE CASE regexp_extract(source_url, '^https://([^/]*)', 1) WHEN 'www.gov.cn' THEN 'T1' WHEN 'cninfo.com.cn' THEN 'T1' WHEN '36kr.com' THEN 'T2'
        WHEN 'www.qcc.com' THEN 'T1/T2' WHEN 'mp.weixin.qq.com' THEN 'T2/T3' ELSE 'T3' END END AS tier,
    CASE WHEN platform <> '' THEN platform ELSE CASE regexp_extract(source_url, '^https://([^/]*)', 1) WHEN 'mp.weixin.qq.com' THEN '微信公众号'
      WHEN 'www.zhihu.com' THEN '知乎' ELSE 'other' END END AS plat,
    CASE WHEN CAST(coalesce(event_date, published_at) AS TIMESTAMP) <= TIMESTAMP '2024-01-31 00:00:00' THEN
      CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(CAST(coalesce(event_date, published_at) AS TIMESTAMP))) / 86400) AS INT) END AS age,
    stance = 'negative' OR claim_type IN ('risk_signal', 'contradiction') OR regexp_matches(lower(source_title || ' ' || quote || ' ' || claim_type), '{'|'.join(T.NEGATIVE_PHRASES)}') AS negative
  FROM evidence e WHERE evidence_eligible AND NOT (discovery_only AND NOT coalesce(quote_verified, false))),
pts AS (SELECT *, CASE tier {_POINTS} ELSE 40 END AS pts, coalesce(quote_verified, false) AS verified, plat IN ('微信公众号', '知乎') AS social,
    independently_corroborated AND independent_source_count >= 2 AS corr FROM items)"""
_STATS = """
st AS (SELECT entity_key, count(*) AS n, count(age) AS dated, count(*) FILTER (WHERE age <= 90) AS recent_90, count(*) FILTER (WHERE age <= 180) AS recent_180,
    count(DISTINCT domain) AS domains, count(*) AS traceable, count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE tier = 'T1') AS t1,
    count(*) FILTER (WHERE tier <> 'T1' AND pts >= 78) AS t2, count(*) FILTER (WHERE pts >= 78) AS authoritative, count(*) FILTER (WHERE tier IN ('T1', 'T1/T2')) AS official,
    count(*) FILTER (WHERE social) AS social, count(*) FILTER (WHERE retrieval_provider_count >= 2) AS multi_provider, count(*) FILTER (WHERE corr) AS corroborated
  FROM pts GROUP BY 1),
s2 AS (SELECT *, round_even(social / n, 2) AS social_ratio, least(100.0, recent_90 * 22 + (recent_180 - recent_90) * 11 + dated * 4) AS freshness,
    round_even(least(100.0, (verified + (traceable - verified) * 0.65::DOUBLE) / n * 100), 1) AS traceability_score,
    least(100.0, t1 * 28 + t2 * 16 + domains * 6) AS authority, least(100.0, corroborated * 35) AS cross_validation,
    least(100.0, n * 10 + domains * 9 + recent_90 * 10 + recent_180 * 5 + verified * 6 + authoritative * 4) AS strength FROM st),
s3 AS (SELECT *, least(100.0, greatest(0.0, official * 18 + greatest(0, authoritative - official) * 7 + corroborated * 30 + verified * 6 + least(domains, 6) * 5
    + least(recent_180, 5) * 4 - CASE WHEN social_ratio >= 0.6 AND official = 0 THEN 18 ELSE 0 END)) AS chain FROM s2)"""


def _stat_columns() -> str:
    doubles = ["social_ratio", "freshness", "traceability_score", "authority", "cross_validation", "chain", "strength"]
    return ", ".join(f"{k}::DOUBLE AS {k}" if k in doubles else k for k in E.EVIDENCE_STATS if k != "reliability")


def _items(t: Tables) -> DataFrame:
    return E.normalize(E.admit(t.evidence), NOW)


# -- evidence -----------------------------------------------------------------------------------------

_RULES_SQL = _rule_values(HOST_RULES)


@query("evidence_rank", "F2 F13 F36 P3 J3 A2 W4", f"""
WITH rules(domain, rule_tier, ord) AS (VALUES {_RULES_SQL}),
texts AS ({_page_text_sql()}),
p AS (SELECT page_id, {HOST_SQL} AS host, regexp_extract({HOST_SQL}, '([^.]+\\.[^.]+)$', 1) AS site FROM pages JOIN texts USING (page_id) WHERE long_enough),
q AS (SELECT *, (SELECT arg_min(rule_tier, ord) FROM rules WHERE host = domain OR host LIKE '%.' || domain) AS tier FROM p),
st AS (SELECT site, count(*) AS n, count(DISTINCT host) AS domains, count(*) FILTER (WHERE tier = 'T1') AS t1, count(*) FILTER (WHERE tier = 'T2') AS t2 FROM q GROUP BY 1),
s2 AS (SELECT *, least(100.0, t1 * 28 + t2 * 16 + domains * 6)::DOUBLE AS authority,
  least(100.0, t1 * 18 + t2 * 7 + n * 6 + least(domains, 6) * 5)::DOUBLE AS chain FROM st),
s3 AS (SELECT *, round_even(100.0::DOUBLE * 0.25::DOUBLE + authority * 0.2::DOUBLE + chain * 0.2::DOUBLE, 1) AS reliability FROM s2)
SELECT row_number() OVER (ORDER BY reliability DESC, n DESC, site) AS rank, site AS entity, n, domains, authority, chain, reliability FROM s3""")
def evidence_rank(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(HOST_RULES, "domain string, source_tier string, ord int")
    pages = t.pages.select(c("page_id").alias("seq"), c("url").alias("source_url"), U.host("url").alias("host"),
                           H.page_title("html").alias("source_title"), H.page_text("html").alias("quote"))
    pages = J.host_lookup(pages.filter(F.length("quote") >= 80), "host", rules).drop("ord")
    rows = pages.withColumns({"entity": F.regexp_extract("host", "([^.]+\\.[^.]+)$", 1), "quote_verified": F.lit(True),
                              "claim_type": F.lit("product_signal"), "stance": F.lit("neutral")})
    items = E.normalize(E.admit(rows), NOW)
    stats = E.evidence_stats(items).join(E.entity_names(items).select("entity_key", "entity"), "entity_key")
    ranked = indexed(stats, [F.desc("reliability"), F.desc("n"), F.asc("entity")], "rank")
    return ranked.select((c("rank") + 1).alias("rank"), "entity", "n", "domains", "authority", "chain", "reliability")


@query("evidence_admission", "P1", """
SELECT CASE WHEN NOT evidence_eligible THEN 'not_eligible' WHEN discovery_only AND NOT coalesce(quote_verified, false) THEN 'unverified_lead' ELSE 'admitted' END AS reason,
  count(*) AS n FROM evidence GROUP BY 1""")
def evidence_admission(t: Tables) -> DataFrame:
    return E.admission_counts(t.evidence)


@query("evidence_dedupe7", "D1 U1", """
WITH u AS (SELECT doc_id * 2 AS seq, lang, text FROM documents UNION ALL SELECT doc_id * 2 + 1, lang, text FROM documents WHERE doc_id % 3 = 0),
k AS (SELECT seq, lang, row_number() OVER (PARTITION BY lang, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 240) ORDER BY seq) AS rn FROM u)
SELECT lang, count(*) AS kept, sum(seq) AS seq_sum FROM k WHERE rn = 1 GROUP BY 1""")
def evidence_dedupe7(t: Tables) -> DataFrame:
    def rows(df: DataFrame, shift: int) -> DataFrame:
        blank = {k: F.lit("") for k in ("claim_type", "stance", "source_url", "source_title", "published_at")}
        return df.select((c("doc_id") * 2 + shift).alias("seq"), c("lang").alias("entity"), c("text").alias("quote")).withColumns(blank)

    both = rows(t.documents, 0).unionByName(rows(t.documents.filter("doc_id % 3 = 0"), 1), allowMissingColumns=True)
    return P.dedupe_evidence(both).groupBy(c("entity").alias("lang")).agg(
        F.count(F.lit(1)).alias("kept"), F.sum("seq").alias("seq_sum"))


@query("evidence_dedupe4", "D2", """
SELECT seq, claim_type, importance FROM (SELECT *, row_number() OVER (PARTITION BY entity, claim_type, source_url, quote ORDER BY seq) AS rn FROM evidence) WHERE rn = 1""")
def evidence_dedupe4(t: Tables) -> DataFrame:
    return P.dedupe_grounded(t.evidence).select("seq", "claim_type", "importance")


@query("source_dedupe_provenance", "A5 W8 F52", """
WITH k AS (SELECT *, regexp_replace(trim(url), '[?#].*$', '') AS canonical_url FROM hits),
f AS (SELECT canonical_url, min(seq) AS seq, coalesce(arg_min(title, seq) FILTER (WHERE title <> ''), '') AS title, count(DISTINCT query) AS query_hit_count FROM k GROUP BY 1),
p AS (SELECT canonical_url, string_agg(provider, '|' ORDER BY s) AS providers, count(*) AS provider_count FROM (SELECT canonical_url, provider, min(seq) AS s FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT canonical_url AS source_key, seq, title, providers, CAST(provider_count AS INT) AS provider_count, query_hit_count, provider_count > 1 AS multi FROM f JOIN p USING (canonical_url)""")
def source_dedupe_provenance(t: Tables) -> DataFrame:
    rows = t.hits.withColumns({"canonical_url": F.regexp_replace("url", "[?#].*$", ""), "source_url": c("url"), "domain": U.host("url"),
                               "traceability": F.lit("declared"), "source_tier": F.lit("T3")})
    merged = P.dedupe_sources(rows)
    return merged.orderBy(*P.source_order()).select(
        "source_key", "seq", "title", F.array_join("retrieval_providers", "|").alias("providers"),
        c("retrieval_provider_count").alias("provider_count"), "query_hit_count", c("multi_provider_retrieval").alias("multi"))


@query("source_query_hits", "A5 F52", """
SELECT regexp_replace(trim(url), '[?#].*$', '') AS source_key, query, min(seq) AS first_seq FROM hits GROUP BY 1, 2""")
def source_query_hits(t: Tables) -> DataFrame:
    rows = t.hits.withColumns({"canonical_url": F.regexp_replace("url", "[?#].*$", ""), "source_url": c("url"), "domain": F.lit("")})
    return P.source_hits(rows, "query").select("source_key", "query", c("first_seen.seq").alias("first_seq"))


@query("keep_best_page", "D3", """
WITH k AS (SELECT seq, regexp_replace(url, '[?#].*$', '') AS url, provider_no > 0 AS lead FROM hits)
SELECT url, arg_min(seq, (lead, seq)) AS seq FROM k GROUP BY 1""")
def keep_best_page(t: Tables) -> DataFrame:
    rows = t.hits.select("seq", F.regexp_replace("url", "[?#].*$", "").alias("url"), (c("provider_no") > 0).alias("discovery_only"))
    return P.keep_best_page(rows).select("url", "seq")


_QUOTE = "CASE WHEN doc_id % 3 = 0 THEN 'altered ' || substr(text, 1, 40) ELSE substr(text, CAST(length(text) // 3 AS INT) + 1, 60) END"


@query("quote_grounding", "J1 P2 P3", f"""
WITH q AS (SELECT doc_id, text, trim({_QUOTE}, E' \\t\\n\\r') AS quote, CASE WHEN doc_id % 5 = 0 THEN 'zzz_signal' ELSE 'product_signal' END AS claim FROM documents)
SELECT doc_id AS seq, CASE WHEN claim = 'zzz_signal' THEN 'claim_type' WHEN doc_id % 7 = 0 THEN 'page_missing' WHEN quote = '' OR NOT contains(text, quote) THEN 'quote_not_in_page' END AS reject_reason FROM q""")
def quote_grounding(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://docs.example/"), F.when(c("doc_id") % 7 == 0, "none/").otherwise(""), c("doc_id").cast("string"))
    quote = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("altered "), F.substring("text", 1, 40))).otherwise(
        F.substring("text", F.floor(F.length("text") / 3).cast("int") + 1, F.lit(60)))
    rows = t.documents.select(c("doc_id").alias("seq"), F.lit("docs company").alias("entity"), url.alias("source_url"), quote.alias("quote"),
                              F.when(c("doc_id") % 5 == 0, "zzz_signal").otherwise("product_signal").alias("claim_type"),
                              F.lit("positive").alias("stance"), F.lit("3").alias("importance"))
    pages = t.documents.select(F.concat(F.lit("https://docs.example/"), c("doc_id").cast("string")).alias("url"),
                               F.lit("Docs Company news").alias("page_title"), c("text").alias("page_text"))
    return E.ground_quotes(rows, pages).select("seq", "reject_reason")


@query("quote_corpus_search", "J2", """
SELECT b.item_id AS quote_id, d.doc_id AS page_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def quote_corpus_search(t: Tables) -> DataFrame:
    return E.search_quotes(t.benchmark.select(c("item_id").alias("quote_id"), c("text").alias("quote")),
                           t.documents.select(c("doc_id").alias("page_id"), c("text").alias("page_text")))


@query("keyword_table_join", "J4", """
WITH k AS (SELECT n_nationkey AS ord, n_name AS name, lower(split_part('license|password|trash|copyright|disgusting|api', '|', n_nationkey % 6 + 1)) AS keyword FROM nation),
h AS (SELECT d.doc_id, arg_min(k.name, k.ord) AS name FROM documents d JOIN k ON contains(lower(d.text), k.keyword) GROUP BY 1)
SELECT d.doc_id AS text_id, h.name FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id""")
def keyword_table_join(t: Tables) -> DataFrame:
    words = t.nation.select(c("n_nationkey").alias("keyword_id"), c("n_nationkey").alias("ord"), c("n_name").alias("name"),
                            F.split_part(F.lit("license|password|trash|copyright|disgusting|api"), F.lit("|"), c("n_nationkey") % 6 + 1).alias("keyword"))
    return J.first_keyword(t.documents.select(c("doc_id").alias("text_id"), "text"), words).select("text_id", "name")


@query("evidence_stats", "A2 K1", f"WITH {_ITEMS}, {_STATS} SELECT entity_key, {_stat_columns()}, "
       "round_even(freshness * 0.2::DOUBLE + traceability_score * 0.25::DOUBLE + authority * 0.2::DOUBLE + cross_validation * 0.15::DOUBLE + chain * 0.2::DOUBLE, 1) AS reliability FROM s3")
def evidence_stats(t: Tables) -> DataFrame:
    return E.evidence_stats(_items(t))


_HINTS = _rule_values([(d, h) for d, hs in SR.CLAIM_HINTS.items() for h in (hs or T.CLAIM_TYPES)])


@query("dimension_support", "A3", f"""
WITH {_ITEMS}, hints(dimension, claim) AS (VALUES {_HINTS}),
g AS (SELECT entity_key, dimension, count(*) AS n, count(DISTINCT domain) AS domains, count(*) FILTER (WHERE pts >= 90) AS authoritative,
  count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE age <= 180) AS recent_180, count(*) FILTER (WHERE retrieval_provider_count >= 2) AS multi_provider,
  count(*) FILTER (WHERE corr) AS corroborated, count(*) FILTER (WHERE social) AS social FROM pts JOIN hints ON claim = claim_type GROUP BY 1, 2),
a AS (SELECT e.entity_key, d.dimension, coalesce(n, 0) AS n, coalesce(domains, 0) AS domains, coalesce(authoritative, 0) AS authoritative, coalesce(verified, 0) AS verified,
  coalesce(recent_180, 0) AS recent_180, coalesce(multi_provider, 0) AS multi_provider, coalesce(corroborated, 0) AS corroborated, coalesce(social, 0) AS social
  FROM (SELECT DISTINCT entity_key FROM pts) e CROSS JOIN (SELECT DISTINCT dimension FROM hints) d LEFT JOIN g ON g.entity_key = e.entity_key AND g.dimension = d.dimension)
SELECT entity_key, dimension, n, domains, authoritative, verified, recent_180, multi_provider, corroborated, n > 0 AND social = n AND authoritative = 0 AS social_only,
  CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, n * 10 + authoritative * 14 + verified * 12 + recent_180 * 8 + domains * 10 + corroborated * 22
    - CASE WHEN social = n AND authoritative = 0 THEN 12 ELSE 0 END)) END::DOUBLE AS support_score FROM a""")
def dimension_support(t: Tables) -> DataFrame:
    return E.dimension_support(_items(t))


def _hit(group: str, positive: bool = True) -> str:
    words = {**SR.HIT_GROUPS, "financing": SR.FINANCING_WORDS, "risk": SR.RISK_WORDS}[group]
    test = f"regexp_matches(blob, '{'|'.join(words)}')"
    extra = " AND age <= 365" if group == "financing" else ""
    return f"count(*) FILTER (WHERE {'NOT negative AND ' if positive else ''}{test}{extra}) AS hit_{group}"


_EVENT_TEXT = "lower(claim_type || ' ' || source_title || ' ' || quote)"


@query("signal_profile", "A4 K9", f"""
WITH {_ITEMS}, b AS (SELECT *, lower(entity || ' ' || source_title || ' ' || trim(quote) || '  ' || claim_type || ' ' || stance) AS blob FROM pts)
SELECT entity_key, sum(CASE WHEN stance <> 'negative' THEN greatest(1, importance) ELSE 0 END)::BIGINT AS positive_importance, count(*) FILTER (WHERE negative) AS negatives,
  sum(CASE WHEN negative OR age IS NULL OR age > 90 THEN 0 {' '.join(f"WHEN regexp_matches({_EVENT_TEXT}, '{'|'.join(w)}') THEN {int(v * 10)}" for _, v, w in SR.MOMENTUM)} ELSE 0 END)::BIGINT AS momentum_tenths,
  {_hit("financing")}, {_hit("risk", False)}, {", ".join(_hit(g) for g in SR.HIT_GROUPS)} FROM b GROUP BY 1""")
def signal_profile(t: Tables) -> DataFrame:
    return E.signal_profile(_items(t))


@query("claim_counts", "A4", f"WITH {_ITEMS} SELECT entity_key, claim_type, count(*) AS n FROM pts GROUP BY 1, 2")
def claim_counts(t: Tables) -> DataFrame:
    return E.claim_counts(_items(t))


_ORDERED = "string_agg(lower(source_title || ' ' || q || '  ' || claim_type || ' ' || full_plat), ' ' ORDER BY importance DESC, coalesce(age, 99999), seq)"
_PLATFORM = "CASE WHEN platform <> '' THEN platform ELSE CASE domain " + " ".join(
    f"WHEN '{h}' THEN '{p}'" for h, p in [("cninfo.com.cn", "巨潮资讯"), ("36kr.com", "36氪"), ("mp.weixin.qq.com", "微信公众号"),
                                          ("www.qcc.com", "企查查"), ("www.zhihu.com", "知乎")]) + " ELSE domain END END"
_TRIM = r"regexp_replace(quote, '^\s+|\s+$', '', 'g')"


def _sql_pattern(pattern: str) -> str:
    return "(?i)" + pattern


@query("text_facts", "A4 W5 F29 F30", f"""
WITH {_ITEMS}, b AS (SELECT *, CASE WHEN {_TRIM} <> '' THEN {_TRIM} ELSE source_title END AS q, {_PLATFORM} AS full_plat FROM pts),
a AS (SELECT entity_key, lower(max_by(entity, (length(entity), entity))) || ' ' || {_ORDERED} AS x FROM b GROUP BY 1)
SELECT entity_key, regexp_extract(x, '{_sql_pattern(SR.ROUND_PATTERN)}', 1) AS latest_round, regexp_extract(x, '{_sql_pattern(SR.AMOUNT_PATTERN)}', 1) AS funding_total,
  regexp_extract(x, '{_sql_pattern(SR.VALUATION_PATTERN)}', 1) AS latest_valuation, regexp_extract(x, '{_sql_pattern(SR.MARGIN_PATTERN)}', 1) AS gross_margin_text,
  regexp_extract(x, '{_sql_pattern(SR.REVENUE_PATTERN)}', 1) AS revenue_text,
  array_to_string(regexp_extract_all(x, '{_sql_pattern(SR.GROWTH_PATTERN)}')[1:2], '；') AS growth_text,
  array_to_string(regexp_extract_all(x, '{_sql_pattern(SR.RIVAL_PATTERN)}', 1)[1:3], '|') AS rivals FROM a""")
def text_facts(t: Tables) -> DataFrame:
    items = _items(t)
    out = E.text_facts(items, E.entity_names(items))
    return out.withColumn("rivals", F.array_join("rivals", "|"))


_RISK = "CASE " + " ".join(f"WHEN regexp_matches(blob, '{'|'.join(w)}') THEN '{n}'" for n, w in SR.RISK_TYPES) + f" ELSE '{SR.RISK_TYPE_DEFAULT}' END"
_MOMENT = "CASE " + " ".join(f"WHEN regexp_matches({_EVENT_TEXT}, '{'|'.join(w)}') THEN '{n}'" for n, _, w in SR.MOMENTUM) + " END"


@query("leading_evidence", "W5 A14 K6 K9", f"""
WITH {_ITEMS}, b AS (SELECT *, lower(entity || ' ' || source_title || ' ' || trim(quote) || '  ' || claim_type || ' ' || stance) AS blob FROM pts),
r AS (SELECT entity_key, {_RISK} AS kind, CASE WHEN importance >= 4 THEN '高' WHEN importance >= 3 THEN '中' ELSE '低' END AS severity,
  row_number() OVER (PARTITION BY entity_key ORDER BY importance DESC, coalesce(age, 99999), seq) AS rn FROM b WHERE negative),
m AS (SELECT entity_key, signal, row_number() OVER (PARTITION BY entity_key ORDER BY importance DESC, age, seq) AS rn FROM (SELECT *, {_MOMENT} AS signal FROM b WHERE NOT negative AND age <= 90) WHERE signal IS NOT NULL),
t AS (SELECT entity_key, source_title, row_number() OVER (PARTITION BY entity_key ORDER BY importance DESC, coalesce(age, 99999), seq) AS rn FROM b)
SELECT k.entity_key, coalesce((SELECT string_agg(kind || severity, '|' ORDER BY rn) FROM r WHERE r.entity_key = k.entity_key AND rn <= 5), '') AS risks,
  coalesce((SELECT string_agg(signal, '|' ORDER BY rn) FROM m WHERE m.entity_key = k.entity_key AND rn <= 6), '') AS signals,
  (SELECT string_agg(source_title, '；' ORDER BY rn) FROM t WHERE t.entity_key = k.entity_key AND rn <= 3) AS core_product FROM (SELECT DISTINCT entity_key FROM b) k""")
def leading_evidence(t: Tables) -> DataFrame:
    rows = E.leading_evidence(_items(t))
    return rows.select("entity_key", F.array_join(F.transform("risks", lambda r: F.concat(r["risk_type"], r["severity"])), "|").alias("risks"),
                       F.array_join("momentum_signals", "|").alias("signals"), "core_product")


@query("topic_overlap", "A16", f"""
WITH {_ITEMS}, w AS (SELECT unnest(['量产', '国产替代', 'license', 'avec']) AS word)
SELECT entity_key, least(10.0, 2.0 * count(*) FILTER (WHERE hit))::DOUBLE AS fit FROM (
  SELECT entity_key, word, bool_or(contains(lower(entity || ' ' || quote), word)) AS hit FROM pts CROSS JOIN w GROUP BY 1, 2) GROUP BY 1""")
def topic_overlap(t: Tables) -> DataFrame:
    counters = E.entity_counters(_items(t), TOPIC)
    hits = sum((c(f"topic_{i}") for i in range(len(E.topic_words(TOPIC)))), F.lit(0))
    return counters.select("entity_key", S.X.word_overlap_score(TOPIC, hits).alias("fit"))


@query("view_diagnostics", "A13", """
WITH r AS (SELECT split_part(entity, '科技', 1) AS entity, regexp_extract(source_url, '^https://([^/]*)', 1) AS d, epoch(CAST(coalesce(event_date, published_at) AS TIMESTAMP)) AS e,
  quote <> '' AND coalesce(quote_verified, false) AS traced, independently_corroborated AND independent_source_count >= 2 AS cr, CASE source_tier WHEN 'primary_official' THEN 100 WHEN 'mainstream_media' THEN 78
  WHEN 'social_post' THEN 52 WHEN 'aggregator' THEN 40 WHEN 'T1/T2' THEN 90 ELSE 35 END AS a FROM evidence),
g AS (SELECT entity, count(*) AS n, count(DISTINCT d) AS domains, count(*) FILTER (WHERE traced) * 100.0::DOUBLE / count(*) AS traced, avg(a) AS authority, least(100.0, count(*) FILTER (WHERE cr) * 35.0)::DOUBLE AS cross_score FROM r GROUP BY 1)
SELECT entity, least(100.0, n * 9.0 + domains * 8.0)::DOUBLE AS evidence_strength, round_even(traced, 1) AS traceability_score, round_even(authority, 1) AS source_authority_score,
  cross_score AS cross_validation_score, round_even(traced * 0.35::DOUBLE + authority * 0.3::DOUBLE + cross_score * 0.35::DOUBLE, 1) AS data_quality FROM g""")
def view_diagnostics(t: Tables) -> DataFrame:
    rows = t.evidence.withColumn("entity", F.split_part("entity", F.lit("科技"), F.lit(1)))
    return E.view_diagnostics(rows, NOW, ["entity"]).select("entity", "evidence_strength", "traceability_score", "source_authority_score",
                                                            "cross_validation_score", "data_quality")


# -- scoring ------------------------------------------------------------------------------------------

_BASE_WEIGHTS = _rule_values(list(S.S.DIMENSION_WEIGHTS.items()))
_WEIGHT_CHANGES = _rule_values([(sector, d, f) for sector, changes in S.S.SECTOR_ADJUSTMENTS.items() for d, f in changes.items()])
_WEIGHT_SECTORS = _rule_values([(sector,) for sector in S.S.SECTOR_ADJUSTMENTS])


@query("adjusted_weights", "K2 F24", f"""
WITH b(dimension, base) AS (VALUES {_BASE_WEIGHTS}), a(sector_type, dimension, factor) AS (VALUES {_WEIGHT_CHANGES}), s(sector_type) AS (VALUES {_WEIGHT_SECTORS}),
r AS (SELECT sector_type, dimension, base::DOUBLE * coalesce(factor, 1)::DOUBLE AS raw FROM s CROSS JOIN b LEFT JOIN a USING (sector_type, dimension)),
w AS (SELECT sector_type, dimension, round_even(raw * 100 / sum(raw) OVER (PARTITION BY sector_type), 2) AS weight FROM r),
d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'software' WHEN doc_id % 3 = 1 THEN 'hardware' ELSE 'default' END AS sector_type, count(*) AS n FROM documents GROUP BY 1)
SELECT sector_type, dimension, weight::DOUBLE AS weight, n FROM d JOIN w USING (sector_type)""")
def adjusted_weights(t: Tables) -> DataFrame:
    text = F.when(c("doc_id") % 3 == 0, "SaaS 数据").when(c("doc_id") % 3 == 1, "传感 设备").otherwise("plain")
    sectors = t.documents.select(S.X.sector_type(text).alias("sector_type")).groupBy("sector_type").agg(F.count(F.lit(1)).alias("n"))
    return sectors.join(S.adjusted_weights(t.spark), "sector_type")


def _split_entities(t: Tables) -> DataFrame:
    """The evidence over many small companies, so that all levels and gates occur."""
    return t.evidence.withColumn("entity", F.concat(F.lit("公司"), F.floor(c("seq") / 4).cast("string"), c("entity")))


@query("priority_rank", "K5 K7 K8 K10 K11 K12 K19 W4 W6 F38")
def priority_rank(t: Tables) -> DataFrame:
    return S.rank_candidates(S.score_companies(t.evidence, NOW, TOPIC).select(*S.REPORT_COLUMNS))


@query("dimension_scores", "K3 K4 K5 K7")
def dimension_scores(t: Tables) -> DataFrame:
    return S.dimension_rows(S.score_companies(_split_entities(t), NOW))


@query("sub_dimension_levels", "K4 A15")
def sub_dimension_levels(t: Tables) -> DataFrame:
    return S.sub_dimension_rows(S.score_companies(_split_entities(t), NOW))


@query("score_gates", "K8")
def score_gates(t: Tables) -> DataFrame:
    return S.gate_rows(S.score_companies(_split_entities(t), NOW))


# -- radar --------------------------------------------------------------------------------------------

def _pattern(words: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{w})" for w in words)


def _gate_sql() -> str:
    """Gates in SQL for records whose company is given."""
    core = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w.lower() for w in ws)}') THEN '{n}'" for n, ws in RR.CORE_VARIABLES) + " END"
    done = "CASE v " + " ".join(f"WHEN '{n}' THEN regexp_matches(text, '{_pattern(ws)}')" for n, ws in RR.CONFIRMED_EVENTS.items()) + " ELSE true END"
    sectors = " OR ".join(f"regexp_matches(lower(text), '{'|'.join(w.lower() for w in ws)}')" for _, ws in RR.SECTORS)
    principle = " OR ".join(f"contains(text, '{p}')" for p in RR.PRINCIPLES)
    return f"""
day AS (SELECT r.seq, CASE WHEN r.seq % 4 = 2 AND event_date IS NULL THEN CAST(CAST(substr(CAST(e.ts AS VARCHAR), 1, 19) AS TIMESTAMP) + INTERVAL 8 HOUR AS DATE) ELSE CAST(e.ts AS DATE) END AS event_day,
  r.title, r.title || ' ' || r.summary AS text, r.company, r.publisher_url, r.source_type, r.discovery_only, r.url FROM records r JOIN events e ON e.event_id = r.seq),
core AS (SELECT *, {core} AS v FROM day),
gated AS (SELECT *, source_type = 'google_news_rss' OR discovery_only AS lead, regexp_replace(lower(company), '^(.{{2,}}?)(?:{'|'.join(T.RADAR_SUFFIXES)})+$', '\\1') AS company_key,
  CASE WHEN source_type = 'google_news_rss' AND publisher_url LIKE '%eastmoney.com/' THEN 'blocked_publisher'
    WHEN regexp_matches(title, '[（(]\\s*\\d{{6}}\\s*[）)]') THEN 'stock_code' WHEN v IS NULL THEN 'core_variable'
    WHEN regexp_matches(text, '{_pattern(RR.NON_EVENTS)}') OR NOT ({done}) THEN 'not_completed'
    WHEN v = '{RR.CAPITAL_VARIABLE}' AND regexp_matches(text, '{_pattern(RR.LATE_STAGE)}') THEN 'late_stage'
    WHEN NOT ({sectors} OR {principle}) THEN 'fit_tags' END AS reject_reason FROM core)"""


@query("radar_gates", "P4 F25 F26 F27 F44 F45", f"""
WITH {_gate_sql()} SELECT CASE WHEN event_day NOT BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}' THEN 'window' ELSE coalesce(reject_reason, 'accepted') END AS reason, count(*) AS n FROM gated GROUP BY 1""")
def radar_gates(t: Tables) -> DataFrame:
    return R.gate_counts(t.records, AS_OF)


@query("radar_windows", "T3 F45 W10", f"""
WITH {_gate_sql()}, d AS (SELECT unnest(generate_series(DATE '2024-01-20', DATE '{AS_OF}', INTERVAL 1 DAY))::DATE AS as_of)
SELECT as_of, count(*) AS n, count(DISTINCT company_key) AS companies FROM d JOIN gated ON reject_reason IS NULL AND event_day BETWEEN as_of - 6 AND as_of GROUP BY 1""")
def radar_windows(t: Tables) -> DataFrame:
    rows = R.accepted(t.records, "2024-01-20", AS_OF, 7)
    return rows.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("company_key").alias("companies"))


def _ranked_sql() -> str:
    priority = " ".join(f"WHEN '{n}' THEN {len(RR.CORE_VARIABLES) - i}" for i, (n, _) in enumerate(RR.CORE_VARIABLES))
    return f"""{_gate_sql()},
cand AS (SELECT row_number() OVER (ORDER BY CASE WHEN lead THEN 0 ELSE 1 END DESC, CASE v {priority} END DESC, event_day DESC, company_key DESC, seq) AS rn, seq, company, company_key AS ck,
  lower(url) AS uk, regexp_replace(lower(title), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') AS tk FROM gated WHERE reject_reason IS NULL AND event_day BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}')"""


_SAME = """(x.k = r.ck OR (least(length(x.k), length(r.ck)) >= 4 AND abs(length(x.k) - length(r.ck)) <= 4 AND
  CASE WHEN length(x.k) >= length(r.ck) THEN starts_with(x.k, r.ck) OR ends_with(x.k, r.ck) ELSE starts_with(r.ck, x.k) OR ends_with(r.ck, x.k) END))"""


@query("radar_order", "W3 P4", f"WITH {_ranked_sql()} SELECT rn AS rank, seq, company FROM cand")
def radar_order(t: Tables) -> DataFrame:
    rows = R.accepted(t.records, AS_OF, AS_OF, 7)
    # Stored, as the sort reads its rows twice: for its ranges and to deal them.
    rows = checkpointed(rows.select("rank_exact", "entity_confidence", "rank_variable", "event_day", "company_key", "seq", "company"))
    ranked = indexed(rows, R.radar_order(), "rank")
    return ranked.select((c("rank") + 1).alias("rank"), "seq", "company")


_TOP = f"""
WITH RECURSIVE {_ranked_sql()[1:] if _ranked_sql().startswith(chr(10)) else _ranked_sql()},
g AS (SELECT 0::BIGINT AS rn, []::STRUCT(c VARCHAR, k VARCHAR, u VARCHAR, t VARCHAR, s BIGINT)[] AS p
  UNION ALL SELECT r.rn, CASE WHEN length(g.p) >= 5 OR len(list_filter(g.p, lambda x: x.u = r.uk OR x.t = r.tk)) > 0 THEN g.p
    WHEN len(list_filter(g.p, lambda x: {_SAME})) > 0 THEN list_transform(g.p, lambda x, i: CASE WHEN i = list_position(list_transform(g.p, lambda x: {_SAME}), true) AND length(r.company) > length(x.c)
      THEN struct_pack(c := r.company, k := r.ck, u := x.u, t := x.t, s := x.s) ELSE x END)
    ELSE list_append(g.p, struct_pack(c := r.company, k := r.ck, u := r.uk, t := r.tk, s := r.seq)) END FROM g JOIN cand r ON r.rn = g.rn + 1),
f AS (SELECT p FROM g ORDER BY rn DESC LIMIT 1)
SELECT CAST(i AS INT) AS rank, p[i].s AS seq, p[i].c AS company FROM f, (SELECT unnest(range(1, 6)) AS i) WHERE i <= length(p)"""


@query("radar_top5", "D4 J8 W3 P4 F28", _TOP)
def radar_top5(t: Tables) -> DataFrame:
    return R.weekly_radar(t.records, AS_OF).select("rank", "seq", "company")


_ROOM = R.ORIGIN_ROOM
_MIXED = f"""mixed AS (SELECT *, 'feed' AS origin FROM records WHERE seq % 3 = 0 UNION ALL
  SELECT * REPLACE (seq + {_ROOM} AS seq), 'pool' FROM (SELECT * FROM records WHERE seq % 3 = 1 QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1) UNION ALL
  SELECT * REPLACE (seq + {2 * _ROOM} AS seq, NULL AS summary), 'followup' FROM records WHERE seq % 3 = 2)"""


def _mixed_records(t: Tables) -> DataFrame:
    """The records as three origins; follow-ups have no summary."""
    rows = t.records
    return R.union_records(rows.filter("seq % 3 = 0"), rows.filter("seq % 3 = 1"), rows.filter("seq % 3 = 2").drop("summary"))


@query("record_union", "U2", f"WITH {_MIXED} SELECT seq, seq % {_ROOM} AS origin_seq, origin, company, url, summary FROM mixed")
def record_union(t: Tables) -> DataFrame:
    return _mixed_records(t).select("seq", "origin_seq", "origin", "company", "url", "summary")


_MIXED_TOP = _TOP.replace("FROM records r JOIN events e ON e.event_id = r.seq", f"FROM mixed r JOIN events e ON e.event_id = r.seq % {_ROOM}").replace("r.summary AS text", "coalesce(r.summary, '') AS text")


@query("union_radar", "U2 D4 W3", _MIXED_TOP.replace("WITH RECURSIVE ", f"WITH RECURSIVE {_MIXED}, ", 1))
def union_radar(t: Tables) -> DataFrame:
    return R.weekly_radar(_mixed_records(t), AS_OF).select("rank", "seq", "company")


@query("radar_replay", "D4 T3 J8")
def radar_replay(t: Tables) -> DataFrame:
    return R.weekly_radar(t.records, AS_OF, first_as_of="2024-01-08").select("as_of", "rank", "seq", "company", "entry_reason",
                                                                             F.size("company_aliases").alias("aliases"))


@query("alias_pairs", "J8 F16", """
WITH k AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') AS key FROM part UNION SELECT DISTINCT regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') || CAST(p_size % 3 AS VARCHAR) FROM part),
s AS (SELECT DISTINCT regexp_replace(key, '^(.{2,}?)(?:inc|ltd)+$', '\\1') AS key FROM k)
SELECT a.key AS long_key, b.key AS short_key FROM s a JOIN s b ON length(b.key) >= 4 AND length(a.key) - length(b.key) BETWEEN 1 AND 4 AND (starts_with(a.key, b.key) OR ends_with(a.key, b.key))""")
def alias_pairs(t: Tables) -> DataFrame:
    names = t.part.select(c("p_name").alias("company")).unionByName(
        t.part.select(F.concat("p_name", (c("p_size") % 3).cast("string")).alias("company")))
    return R.alias_keys(names)


@query("followup_seeds", "P7 W2", f"""
WITH {_gate_sql()}, l AS (SELECT r.seq, r.title, r.company, CAST(substr(CAST(e.ts AS VARCHAR), 1, 19) AS TIMESTAMP) AS ts FROM records r JOIN events e ON e.event_id = r.seq),
x AS (SELECT l.*, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, CASE {' '.join(f"WHEN regexp_matches(lower(title), '{'|'.join(w.lower() for w in ws)}') THEN '{n}'" for n, ws in RR.CORE_VARIABLES)} END AS core FROM l),
y AS (SELECT *, regexp_replace(company, '^(.{{2,}}?)(?:{'|'.join(T.RADAR_SUFFIXES)})+$', '\\1') AS company_key,
  CASE WHEN core = '{RR.CAPITAL_VARIABLE}' THEN 3 WHEN core IN ('{RR.CUSTOMER_VARIABLE}', '{RR.SCALE_VARIABLE}') THEN 2 ELSE 1 END + CASE WHEN regexp_matches(title, '(?i){RR.FOLLOWUP_EARLY_STAGE}') THEN 2 ELSE 0 END AS priority
  FROM x WHERE day BETWEEN DATE '{AS_OF}' - 2 AND DATE '{AS_OF}' AND core IS NOT NULL AND NOT regexp_matches(title, '(?i){RR.FOLLOWUP_LATE_STAGE}')),
z AS (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY priority DESC, ts DESC, seq) AS rn FROM y)
SELECT company_key, seq, core, CAST(priority AS INT) AS priority FROM z WHERE rn = 1 ORDER BY priority DESC, ts DESC, seq LIMIT 10""")
def followup_seeds(t: Tables) -> DataFrame:
    stamp = t.events.select(c("event_id").alias("seq"), F.concat(F.substring(c("ts").cast("string"), 1, 10), F.lit("T"), F.substring(c("ts").cast("string"), 12, 8), F.lit("Z")).alias("discovered_at"))
    # The account carries the company, as lead titles do not quote it.
    leads = t.records.select("seq", "title", "url", c("company").alias("account_name")).join(stamp, "seq").withColumn("discovery_rank", F.lit(1))
    leads = leads.withColumn("title", F.concat(F.lit("。"), F.substring("title", F.length("account_name") + 1, F.lit(100))))
    return R.followup_seeds(leads, AS_OF).select("company_key", "seq", "core", c("priority").cast("int").alias("priority"))


@query("followup_news", "J9")
def followup_news(t: Tables) -> DataFrame:
    leads = t.records.select("seq", "title", "url", c("company").alias("account_name"), F.lit(f"{AS_OF}T01:00:00Z").alias("discovered_at"),
                             F.lit(1).alias("discovery_rank"))
    seeds = R.followup_seeds(leads, AS_OF)
    return R.followup_news(seeds, t.records.drop("company"), AS_OF).select("seq", "url", "company", "core", "seed_url")


@query("fetch_list", "J10 W9", """
WITH k AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, page_id % 10 AS rank FROM pages),
f AS (SELECT url, arg_min(page_id, (rank, page_id)) AS page_id, min(rank) AS rank FROM k GROUP BY 1),
p AS (SELECT url, arg_min(page_id, page_id) AS pid FROM k WHERE page_id % 2 = 0 GROUP BY 1),
w AS (SELECT f.* FROM f LEFT JOIN p USING (url) WHERE p.pid IS NULL OR (p.pid % 4 <> 0 AND p.pid % 6 <> 0))
SELECT url, row_number() OVER (ORDER BY CASE WHEN rank > 0 THEN rank ELSE 10000 END, page_id) > 20 AS deferred FROM w""".replace(
    "arg_min(page_id, (rank, page_id))", "arg_min(page_id, (CASE WHEN rank > 0 THEN rank ELSE 10000 END, page_id))").replace(
    "min(rank) AS rank", "arg_min(rank, (CASE WHEN rank > 0 THEN rank ELSE 10000 END, page_id)) AS rank"))
def fetch_list(t: Tables) -> DataFrame:
    url = F.regexp_replace("url", "[?#].*$", "")
    cands = t.pages.select(url.alias("url"), F.lit(f"{AS_OF}T00:00:00Z").alias("discovered_at"), (c("page_id") % 10).alias("discovery_rank"), c("page_id").alias("seq"))
    pool = t.pages.filter("page_id % 2 = 0").select(
        url.alias("canonical_url"), F.when(c("page_id") % 4 == 0, "2020-01-01").otherwise(AS_OF).alias("publish_time"),
        F.when(c("page_id") % 6 == 0, "text").otherwise("").alias("body"), c("page_id").alias("seq"))
    return R.fetch_list(cands, pool, AS_OF).select("url", "deferred")


@query("pool_records", "K13 S15", """
SELECT d.doc_id AS seq, d.doc_id % 2 = 0 AS has_body, CASE WHEN d.doc_id % 2 = 0 THEN 'wechat_pool_body' ELSE 'wechat_pool_history' END AS source_type,
  CASE WHEN d.doc_id % 3 = 0 THEN 'desk' ELSE d.source END AS publisher FROM documents d JOIN events e ON e.event_id = d.doc_id""")
def pool_records(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://mp.weixin.qq.com/s/"), c("doc_id").cast("string"))
    pool = t.documents.join(t.events.select(c("event_id").alias("doc_id"), D.ntz_epoch("ts").alias("publish_time")), "doc_id").select(
        c("doc_id").alias("seq"), url.alias("canonical_url"), F.lit("title").alias("title"), "publish_time", F.lit("d").alias("digest"),
        F.when(c("doc_id") % 3 == 0, "待归属:全网发现").otherwise(c("source")).alias("account_name"), F.lit("desk").alias("author"))
    bodies = t.documents.filter("doc_id % 2 = 0").select(url.alias("canonical_url"), c("text").alias("body"))
    rows = R.pool_to_records(pool, bodies)
    return rows.select("seq", (~c("discovery_only")).alias("has_body"), "source_type", "publisher")


@query("discovery_rank", "W1", "SELECT query_pos, seq, row_number() OVER (ORDER BY query_pos, seq) AS rank FROM hits")
def discovery_rank(t: Tables) -> DataFrame:
    return indexed(t.hits.select("query_pos", "seq"), [F.asc("query_pos"), F.asc("seq")], "rank").withColumn("rank", c("rank") + 1)


@query("company_in_text", "F16 J1", """
SELECT s_suppkey, 'supplier' || regexp_extract(s_name, '(\\d+)', 1) AS token, s_suppkey % 2 = 0 AS grounded FROM supplier""")
def company_in_text(t: Tables) -> DataFrame:
    page = F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("The "), "s_name", F.lit(" reports growth"))).otherwise("other page")
    return t.supplier.select("s_suppkey", N.grounding_key("s_name").alias("token"), N.is_grounded(c("s_name"), page).alias("grounded"))
