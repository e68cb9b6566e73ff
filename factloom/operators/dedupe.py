"""Removal of duplicates that keeps provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import url as U
from factloom.functions.text import constant_map, strip
from factloom.operators.common import first_non_blank, keep_first, last_non_blank, ordered_distinct
from factloom.rules import sources as S

SOURCE_FIELDS = ["title", "summary", "domain", "published_at", "source_pack", "source_pack_label",
                 "source_tier", "platform", "credibility", "clean_text", "fetched_title",
                 "link_status", "traceability"]


def dedupe_evidence(evidence: DataFrame, order: str = "seq") -> DataFrame:
    """First row of every evidence text: entity, claim, stance, URL, title, date, first 240 of the quote."""
    keys = {f"_k{i}": strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for i, c in enumerate(
        ["entity", "claim_type", "stance", "source_url", "source_title", "published_at", "quote"])}
    keys["_k6"] = F.substring(keys["_k6"], 1, 240)
    return keep_first(evidence.withColumns(keys), list(keys), F.col(order)).drop(*keys)


def dedupe_grounded(evidence: DataFrame, order: str = "seq") -> DataFrame:
    """First row per entity, claim, URL and quote; best importance and tier text first."""
    kept = keep_first(evidence, ["entity", "claim_type", "source_url", "quote"], F.col(order))
    return kept.orderBy(F.desc("importance"), F.desc("source_tier"), F.asc(order))


def source_key(url: Column, title: Column, domain: Column) -> Column:
    """Key of a source record: its URL, else its title and domain."""
    web = U.web_url(url)
    return F.when(web != "", web).otherwise(
        F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(domain, F.lit(""))))


def _keyed(records: DataFrame) -> DataFrame:
    canonical = F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.col("source_url"))
    return records.withColumn("source_key", source_key(canonical, F.col("title"), F.col("domain")))


def source_hits(records: DataFrame, value: str, order: str = "seq") -> DataFrame:
    """Distinct values of a provenance column per source, with their first row (long form)."""
    return ordered_distinct(_keyed(records), ["source_key"], value, F.col(order))


def dedupe_sources(records: DataFrame, order: str = "seq") -> DataFrame:
    """One row per source: first non-blank of every field, distinct providers, counts.

    ``retrieval_provider_count`` counts search channels; it is never corroboration.  The queries that
    found a source are counted here and listed, one per row, by :func:`source_hits`.
    """
    keyed = _keyed(records)
    fields = [c for c in SOURCE_FIELDS if c in records.columns]
    merged = keyed.groupBy("source_key").agg(
        F.min(order).alias(order), F.min_by(U.web_url("source_url"), F.col(order)).alias("source_url"),
        *[first_non_blank(c, F.col(order)) for c in fields])
    # The provider names are a short list, so the array per source is short as well.
    providers = (ordered_distinct(keyed, ["source_key"], "provider", F.col(order)).groupBy("source_key")
                 .agg(F.array_sort(F.collect_list(F.struct("first_seen", "provider"))).alias("_p")))
    queries = (keyed.filter(F.col("query") != "").groupBy("source_key", "query").agg(F.lit(1).alias("_q"))
               .groupBy("source_key").agg(F.count(F.lit(1)).alias("query_hit_count")))
    out = merged.join(providers, "source_key", "left").join(queries, "source_key", "left")
    names = F.coalesce(F.transform("_p", lambda x: x["provider"]), F.array().cast("array<string>"))
    return (out.withColumn("retrieval_providers", names).drop("_p")
            .withColumn("query_hit_count", F.coalesce("query_hit_count", F.lit(0)))
            .withColumn("retrieval_provider_count", F.size("retrieval_providers"))
            .withColumn("independent_source_count", (F.col("source_url") != "").cast("int"))
            .withColumn("independently_corroborated", F.lit(False))
            .withColumn("multi_provider_retrieval", F.col("retrieval_provider_count") > 1))


def source_order() -> list[Column]:
    """Order of merged sources: traceability, provider count, tier score, title."""
    rank = constant_map(S.TRACEABILITY_RANK)
    trace = F.coalesce(F.try_element_at(rank, F.col("traceability")), F.lit(1))
    return [trace.desc(), F.desc("retrieval_provider_count"), U.tier_score(F.col("source_tier"), "search").desc(),
            F.asc("title"), F.asc("seq")]


def merge_last_non_blank(rows: DataFrame, keys: list[str], order: str = "seq",
                         any_true: list[str] | None = None) -> DataFrame:
    """One row per key with the last non-blank value of every field, and the last position.

    Flags in ``any_true`` take the maximum.
    """
    any_true = any_true or []
    fields = [c for c in rows.columns if c not in keys and c not in any_true and c != order]
    return rows.groupBy(*keys).agg(*[last_non_blank(c, F.col(order)) for c in fields],
                                   *[F.max(c).alias(c) for c in any_true], F.max(order).alias(order))


def keep_best_page(records: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """One record per URL: a read page before a lead, else the first."""
    return keep_first(records, [key], F.coalesce("discovery_only", F.lit(False)), F.col(order))


def url_owner(articles: DataFrame) -> DataFrame:
    """Account that owns a URL across accounts: with a body, then with a date, then the lowest id."""
    body = F.coalesce(F.col("body_markdown_path"), F.lit(""))
    best = F.struct(body == "", F.col("publish_time").isNull(), F.col("id"))
    return articles.groupBy("canonical_url").agg(
        F.min_by("account_id", best).alias("account_id"), F.min_by("id", best).alias("article_id"))
