"""Search leads: normal form, roll-up by URL, coverage and hand-over to the pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions import url as U
from factloom.operators.common import beside, constant_table, first_non_blank, ordered_distinct
from factloom.rules import sources as S

c = F.col
NO_ACCOUNT = "待归属:全网发现"
URL_FIELDS = ["url", "source_url", "link", "href", "canonical_url"]
TEXT_FIELDS = ["text", "snippet", "summary", "description", "content"]


def classify_urls(df: DataFrame, url: str) -> DataFrame:
    """Add what each URL itself says: host, pack, label, tier, credibility, platform."""
    names = ["source_url", "domain", "source_pack", "source_pack_label", "source_tier", "credibility", "platform"]
    return df.withColumn("_u", U.classify(url)).withColumns({n: c(f"_u.{n}") for n in names}).drop("_u")


def search_leads(hits: DataFrame) -> DataFrame:
    """Search hits as lead rows: tier and pack of the observed URL, never of the query that found it.

    ``hits`` has source_url, title, summary, query, provider and discovery_source_pack.
    """
    labels = {p[0]: p[1] for p in S.SOURCE_PACKS}
    tiers = {p[0]: p[2] for p in S.SOURCE_PACKS}
    pack = c("discovery_source_pack")
    rows = classify_urls(hits.withColumnRenamed("source_url", "_url"), "_url").drop("_url")
    return rows.withColumns({
        "requested_url": c("source_url"), "canonical_url": F.lit(""),
        "discovery_source_pack_label": F.coalesce(F.try_element_at(X.constant_map(labels), pack), F.lit("自定义站点")),
        "discovery_source_tier": F.coalesce(F.try_element_at(X.constant_map(tiers), pack), F.lit("T2")),
        "discovery_only": F.lit(True), "evidence_eligible": F.lit(False),
        "evidence_status": F.lit("search_result_only"),
        "traceability": F.when(c("source_url") != "", "declared").otherwise("missing")})


def capture_provenance(captures: DataFrame) -> DataFrame:
    """Captured pages classified by their final URL; discovery fields stay apart.

    ``captures`` has requested_url, final_url, providers, query and discovery_source_pack.
    """
    final = F.when(U.safety_class("final_url") == "public", U.web_url("final_url"))
    rows = captures.withColumn("_final", final)
    rows = classify_urls(rows, "_final")
    return rows.withColumns({
        "canonical_url": c("_final"), "requested_url": U.web_url("requested_url"),
        "session_platform": U.capture_platform(U.host(U.web_url("requested_url"))),
        "evidence_tier": U.capture_tier(c("domain")),
        "retrieval_provider_count": F.size(F.coalesce("providers", F.array().cast("array<string>"))),
        "provider_count_kind": F.lit("retrieval_channels"),
        "independent_source_count": F.when(U.web_url("requested_url") != "", 1).otherwise(0),
        "independently_corroborated": F.lit(False), "source_fields_locked": F.lit(True),
        "quote_match_required": F.lit(True)}).drop("_final")


def attach_capture(evidence: DataFrame, captures: DataFrame) -> DataFrame:
    """Evidence rows with the provenance of the page they were taken from."""
    fields = ["platform", "source_tier", "source_pack", "retrieval_provider_count", "session_platform"]
    right = captures.select(c("canonical_url").alias("source_url"), *[c(f).alias(f"capture_{f}") for f in fields])
    return evidence.join(right.dropDuplicates(["source_url"]), "source_url", "left")


def lead_urls(df: DataFrame) -> Column:
    """Candidate URLs of a search row: from its URL fields, then from its texts; ordered distinct."""
    fields = [f for f in URL_FIELDS + TEXT_FIELDS if f in df.columns]
    return F.array_distinct(F.flatten(F.array(*[U.url_candidates(f) for f in fields])))


def url_hits(rows: DataFrame, canonical: Callable[[Column], Column] = U.discovered_article_url,
             hint: Callable[[Column], Column] = U.looks_like_article) -> DataFrame:
    """One row per candidate URL of a search row, with its class.

    ``rows`` has query_pos and row_pos (their order) besides the search fields.  The class is accepted,
    rejected_invalid (names the host but is no article), rejected_other or no_url.
    """
    hits = rows.select("*", F.posexplode_outer(lead_urls(rows)).alias("url_pos", "candidate"))
    hits = hits.withColumn("canonical_url", canonical(c("candidate")))
    return hits.withColumn("url_class", F.when(c("candidate").isNull(), "no_url")
                           .when(c("canonical_url").isNotNull(), "accepted")
                           .when(hint(c("candidate")), "rejected_invalid").otherwise("rejected_other"))


def discover(hits: DataFrame, new_url_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge accepted URLs with provenance; and count what happened.

    URLs are taken in the order in which they are first seen, up to the limit; queries that come after the
    one that reached the limit are skipped, as the search would have stopped there.
    """
    place = F.struct("query_pos", "row_pos", "url_pos")
    accepted = hits.filter(c("url_class") == "accepted")
    firsts = accepted.groupBy("canonical_url").agg(F.min(place).alias("first_seen"))
    if new_url_limit is not None:
        # At most ``new_url_limit`` rows: a bounded table, and one row with the last query that runs.
        taken = firsts.orderBy("first_seen").limit(new_url_limit)
        last = taken.agg(F.when(F.count(F.lit(1)) >= new_url_limit, F.max("first_seen")["query_pos"]).alias("last_query"))
        run = beside(hits, last).filter(c("last_query").isNull() | (c("query_pos") <= c("last_query")))
        kept = run.filter(c("url_class") == "accepted").join(F.broadcast(taken), "canonical_url")
        capped = run.filter(c("url_class") == "accepted").join(F.broadcast(taken), "canonical_url", "left_anti").agg(
            F.count(F.lit(1)).alias("new_urls_capped"))
    else:
        run, kept, taken = hits, accepted, firsts
        capped = constant_table(hits.sparkSession, [(0,)], "new_urls_capped bigint")
    order = F.struct("query_pos", "row_pos", "url_pos")
    merged = kept.groupBy("canonical_url").agg(
        F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("hits"),
        *[first_non_blank(f, order) for f in ("title", "author", "snippet") if f in kept.columns])
    providers = ordered_distinct(kept, ["canonical_url"], "provider", order)
    queries = ordered_distinct(kept, ["canonical_url"], "query", order).groupBy("canonical_url").agg(
        F.count(F.lit(1)).alias("query_hit_count"))
    lists = providers.groupBy("canonical_url").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("first_seen", "provider"))), lambda x: x["provider"]).alias("providers"))
    results = (merged.join(lists, "canonical_url", "left").join(queries, "canonical_url", "left").withColumns({
        "retrieval_provider_count": F.coalesce(F.size("providers"), F.lit(0)),
        "independent_source_count": F.lit(0), "independently_corroborated": F.lit(False),
        "discovery_only": F.lit(True), "evidence_eligible": F.lit(False),
        "evidence_status": F.lit("search_result_only"), "verification_status": F.lit("source_page_not_fetched")}))
    is_class = lambda name: F.count_if(c("url_class") == name)
    counts = run.agg(F.count_distinct("query_pos").alias("queries_run"),
                     F.count_distinct("query_pos", "row_pos").alias("raw_results"),
                     F.count("candidate").alias("url_candidates"), is_class("accepted").alias("accepted_hits"),
                     is_class("rejected_other").alias("rejected_other"),
                     is_class("rejected_invalid").alias("rejected_invalid"),
                     is_class("no_url").alias("results_without_url"))
    unique = taken.agg(F.count(F.lit(1)).alias("unique_results"))
    stats = beside(counts, unique, capped)
    return results, stats.withColumn("duplicates_removed",
                                     c("accepted_hits") - c("unique_results") - c("new_urls_capped"))


def leads_to_pool(results: DataFrame, discovered_at: str) -> DataFrame:
    """Pool rows of leads: no snippet and no search date is stored as evidence.

    ``results`` has canonical_url, title, author, providers, query and discovery_rank.
    """
    return results.select(
        c("canonical_url").alias("url"), X.clean("title").alias("title"),
        X.first_text(X.clean("author"), default=NO_ACCOUNT).alias("account_name"),
        F.lit("web_discovery").alias("fetch_mode"), F.lit("not_required").alias("credential_status"),
        F.substring("query", 1, 2000).alias("discovery_query"),
        F.substring(F.array_join("providers", ", "), 1, 120).alias("discovery_provider"),
        F.lit(discovered_at).alias("discovered_at"), "discovery_rank",
        F.lit(None).cast("string").alias("publish_time"), F.lit("").alias("body_markdown_path"),
        F.lit("").alias("error"))


def coverage(sources: DataFrame, top: int = 20) -> DataFrame:
    """Source counts by pack, platform and provider, and the top hosts (long form)."""
    def count(kind: str, value: Column, rows: DataFrame) -> DataFrame:
        return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), "value", "n")

    hosts = count("domain", c("domain"), sources.filter(c("domain") != ""))
    hosts = hosts.orderBy(F.desc("n"), F.asc("value")).limit(top)
    providers = sources.select(F.explode("retrieval_providers").alias("p")).filter(c("p") != "")
    return (count("source_pack", c("source_pack_label"), sources).unionByName(count("platform", c("platform"), sources))
            .unionByName(count("provider", c("p"), providers)).unionByName(hosts))


def result_meta(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts and the hosts of a search result: one row per host with its rows, and the totals."""
    host = lambda df, url: F.when(c("domain") != "", F.lower(X.strip("domain"))).otherwise(U.host(url)) \
        if "domain" in df.columns else U.host(url)
    rows = sources.select(host(sources, "source_url").alias("domain"), F.lit(1).alias("s"), F.lit(0).alias("e")) \
        .unionByName(evidence.select(host(evidence, "source_url").alias("domain"), F.lit(0).alias("s"),
                                     F.lit(1).alias("e")))
    return rows.groupBy("domain").agg(F.sum("s").alias("source_count"), F.sum("e").alias("evidence_count"))
