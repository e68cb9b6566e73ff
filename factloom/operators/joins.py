"""Rule-table joins, batch reconciliation and coverage matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions import url as U
from factloom.operators.common import constant_table, keep_first, small
from factloom.operators.evidence import search_quotes

c = F.col


def host_lookup(df: DataFrame, host: str, rules: DataFrame, order: str = "ord") -> DataFrame:
    """Left join a host column with a table of host rules; the rule with the lowest order wins.

    ``rules`` has domain, the order column and any labels.  Only distinct hosts are looked up: each is
    exploded into its suffixes and equi-joined, so there is no comparison of every host with every rule.
    """
    labels = [x for x in rules.columns if x != "domain"]
    hosts = df.select(host).filter(c(host) != "").distinct()
    suffixes = hosts.select(host, F.explode(U.host_suffixes(c(host))).alias("domain"))
    best = (suffixes.join(small(rules), "domain").groupBy(host)
            .agg(F.min_by(F.struct(*labels), c(order)).alias("_rule")).select(host, *[f"_rule.{x}" for x in labels]))
    return df.join(best, host, "left")


def keyword_hits(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(text_id, keyword_id) pairs where a text holds a keyword, for keyword tables that are data.

    A short fixed keyword list should be a generated column (:func:`factloom.functions.text.has_any`).
    """
    found = search_quotes(
        keywords.select(c("keyword_id").alias("quote_id"), F.lower("keyword").alias("quote")),
        texts.select(c("text_id").alias("page_id"), F.lower("text").alias("page_text")))
    return found.select(c("page_id").alias("text_id"), c("quote_id").alias("keyword_id"))


def first_keyword(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """First keyword (by its ``ord``) of every text; texts without one stay with NULL."""
    ranked = keyword_hits(texts, keywords).join(small(keywords), "keyword_id")
    best = ranked.groupBy("text_id").agg(F.min_by(F.struct("name", "keyword"), c("ord")).alias("hit"))
    return texts.join(best, "text_id", "left").select(*texts.columns, c("hit.name").alias("name"),
                                                      c("hit.keyword").alias("keyword"))


def reconcile_batch(requested: DataFrame, index: DataFrame, errors: DataFrame) -> DataFrame:
    """Status of every requested URL against a download index and an error list.

    ``requested`` has url and seq, ``index`` url, seq, status, body_ok, error, ``errors`` url, seq, error.
    The first index row of a URL counts, the last error row of a URL counts.
    """
    first = keep_first(index.select("url", "seq", "status", "body_ok", "error"), ["url"], c("seq"))
    last = errors.groupBy("url").agg(F.max_by("error", "seq").alias("listed_error"))
    df = (requested.select("url", c("seq").alias("request_seq")).join(first, "url", "left")
          .join(last, "url", "left"))
    success = F.lower("status") == "success"
    status = (F.when(success & c("body_ok"), "success").when(success, "invalid_body_path")
              .when(c("status").isNotNull() | c("listed_error").isNotNull(), "download_failed")
              .otherwise("missing_result"))
    message = (F.when(status == "success", "").when(status == "invalid_body_path",
                                                    "downloaded body path is missing or outside the run directory")
               .when(status == "missing_result", "downloader produced no result for this URL")
               .otherwise(X.first_text("error", "listed_error", default="download failed")))
    return df.select("url", "request_seq", status.alias("status"), X.redact_quoted(message).alias("error"))


def batch_status(reconciled: DataFrame) -> DataFrame:
    """One row: success, partial or failed, with counts."""
    good, bad = F.count_if(c("status") == "success"), F.count_if(c("status") != "success")
    return reconciled.agg(
        F.when((good > 0) & (bad > 0), "partial").when(good > 0, "success").otherwise("failed").alias("status"),
        F.count(F.lit(1)).alias("requested_count"), good.alias("success_count"), bad.alias("failure_count"))


def new_and_known(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct incoming keys with whether they are stored already."""
    mine = incoming.select(*keys).distinct()
    stored = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    return mine.join(stored, keys, "left").withColumn("known", c("_known").isNotNull()).drop("_known")


def coverage_matrix(texts: DataFrame, sectors: list[tuple[str, list[str]]], events: list[tuple[str, list[str]]],
                    budget: int = 30, text: str = "text") -> DataFrame:
    """Rows per sector and event cell, in matrix order, within the budget of cells; empty cells count 0."""
    budget = max(1, min(budget, 200))
    lowered = F.lower(text)

    def seen(rules: list[tuple[str, list[str]]]) -> Column:
        return F.filter(F.array(*[F.when(X.has_any(lowered, [w.lower() for w in words]), F.lit(name))
                                  for name, words in rules]), lambda x: x.isNotNull())

    cells = [(i * len(events) + j + 1, s, e) for i, (s, _) in enumerate(sectors) for j, (e, _) in enumerate(events)]
    matrix = constant_table(texts.sparkSession, cells[:budget], "cell int, sector string, event string")
    hits = (texts.select(F.explode(seen(sectors)).alias("sector"), seen(events).alias("_e"))
            .select("sector", F.explode("_e").alias("event")).groupBy("sector", "event").agg(F.count(F.lit(1)).alias("n")))
    return hits.join(matrix, ["sector", "event"], "right").select(
        "cell", "sector", "event", F.coalesce("n", F.lit(0)).alias("n"))


def clean_terms(name: Column, terms: Column) -> Column:
    """Search terms of a dimension: no quotes, ordered distinct without case; the name when none is left."""
    tidy = F.filter(F.transform(terms, lambda t: F.replace(X.clean(t, 80), F.lit('"'), F.lit(""))), lambda t: t != "")
    out = X.distinct_ignoring_case(tidy)
    return F.when(F.size(out) > 0, out).otherwise(F.array(name))
