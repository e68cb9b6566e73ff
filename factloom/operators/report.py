"""Reports: statistics, source status, freshness, views, and the rule when to publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import labels as L
from factloom.functions import text as X
from factloom.functions import url as U
from factloom.functions.numbers import half_even
from factloom.operators.common import beside, top_per_group
from factloom.operators.scoring import dimension_rows
from factloom.rules import scoring as S

c = F.col


def report_stats(scored: DataFrame) -> DataFrame:
    """Candidates, evidence, mean confidence and candidates per bucket (one row)."""
    buckets = [b for _, b in S.BUCKETS] + [S.BUCKET_DEFAULT]
    names = ["recommended", "tracking", "watchlist", "pending", "low_priority"]
    return scored.agg(
        F.count(F.lit(1)).alias("candidate_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_evidence"),
        F.coalesce(half_even(F.avg("confidence_score"), 1), F.lit(0.0)).alias("average_confidence_score"),
        *[F.count_if(c("score_bucket") == b).alias(n) for b, n in zip(buckets, names)])


def domain_set(evidence: DataFrame, url: str = "source_url") -> DataFrame:
    """Distinct hosts of evidence URLs, without the blank one."""
    return evidence.select(U.host(url).alias("domain")).filter(c("domain") != "").distinct()


def evidence_coverage(evidence: DataFrame) -> DataFrame:
    """Rows, traceable rows and hosts of the evidence of a run (one row)."""
    traced = (F.coalesce("source_url", F.lit("")) != "") & (F.coalesce("quote", F.lit("")) != "")
    return evidence.agg(F.count(F.lit(1)).alias("result_count"), F.count_if(traced).alias("traceable_result_count"),
                        F.count_distinct(F.when(U.host("source_url") != "", U.host("source_url"))).alias("source_domain_count"))


def status_rollup(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Status per source from its attempts: skipped, ok, partial or error; empty when ok without items.

    ``attempts`` has ok (boolean) and items (rows it gave).
    """
    good, bad = F.count_if("ok"), F.count_if(~c("ok"))
    items = F.coalesce(F.sum("items"), F.lit(0))
    status = (F.when(good + bad == 0, "skipped").when(good == 0, "error").when(bad > 0, "partial")
              .when(items == 0, "empty").otherwise("ok"))
    return attempts.groupBy(*keys).agg(good.alias("succeeded"), bad.alias("failed"), items.alias("items_seen"),
                                       status.alias("status"))


def radar_status(picks: DataFrame, statuses: DataFrame) -> DataFrame:
    """Status of a radar run (one row): partial, ok or empty, with its picks and open places."""
    degraded = statuses.agg(F.count_if(c("status").isin("partial", "error")).alias("degraded"))
    total = picks.agg(F.count(F.lit(1)).alias("candidates"))
    return beside(degraded, total).select(
        F.when((c("degraded") > 0) & (c("candidates") > 0), "partial").when(c("candidates") > 0, "ok").otherwise("empty")
        .alias("status"), "candidates", (5 - c("candidates")).alias("empty_slots"), c("degraded").alias("degraded_sources"))


def error_summary(errors: DataFrame, keys: list[str], order: str = "seq", limit: int = 2) -> DataFrame:
    """First two distinct error messages per key, in order, joined to one text."""
    clean = errors.withColumn("_e", X.strip(F.coalesce("error", F.lit("")))).filter(c("_e") != "")
    first = clean.groupBy(*keys, "_e").agg(F.min(order).alias("_o"))
    top = top_per_group(first, keys or [], [F.asc("_o")], limit) if keys else \
        first.orderBy("_o").limit(limit).withColumn("_rank", c("_o"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_e"))), lambda x: x["_e"])
    return (top.groupBy(*keys) if keys else top).agg(F.array_join(texts, "；").alias("error_summary"))


def freshness(reports: DataFrame, today: str) -> DataFrame:
    """Freshness of stored reports: missing, stale or fresh, their age in days and a label."""
    now = F.to_date(F.lit(today))
    end, made = D.local_date(D.iso_epoch(X.strip("window_end"))), D.local_date(D.iso_epoch(X.strip("generated_at")))
    df = reports.withColumns({"_end": end, "_made": made})
    known = c("_end").isNotNull() | c("_made").isNotNull()
    oldest = F.least("_end", "_made")
    future = F.coalesce(F.greatest("_end", "_made") > now, F.lit(False))
    stale = c("_end").isNull() | c("_made").isNull() | (c("_end") < now) | (c("_made") < now) | future
    age = F.greatest(F.lit(0), F.coalesce(F.datediff(now, oldest), F.lit(0)))
    as_of = F.coalesce(c("_end").cast("string"), F.lit("待确认"))
    state = F.when(~known, "missing").when(future | F.coalesce(stale, F.lit(True)), "stale").otherwise("fresh")
    label = (F.when(~known, "尚无可用缓存，正在等待首次更新。")
             .when(future, F.concat(F.lit("数据截至 "), as_of, F.lit("，缓存日期异常，请重新更新。")))
             .when((state == "stale") & (age > 0), F.concat(F.lit("数据截至 "), as_of, F.lit("，缓存已过期 "),
                                                            age.cast("string"), F.lit(" 天。")))
             .when(state == "stale", F.concat(F.lit("数据截至 "), as_of, F.lit("，缓存生成时间不可确认。")))
             .otherwise(F.concat(F.lit("数据截至 "), as_of, F.lit("，缓存为今日最新。"))))
    return df.withColumns({"data_as_of": as_of, "cache_age_days": age, "freshness_state": state,
                           "freshness_label": label}).drop("_end", "_made")


# -- views ------------------------------------------------------------------------------------------

def candidate_view(scored: DataFrame) -> DataFrame:
    """Display row of a candidate: neutral label, badge, risks, momentum text, counts."""
    signals = F.when(F.size("momentum_signals") > 0, F.array_join("momentum_signals", " / ")).otherwise("暂无明显交易动量")
    return scored.select(
        c("entity").alias("name"), "summary", "total_score", L.view_bucket(c("total_score")).alias("score_bucket"),
        L.view_badge(c("total_score")).alias("badge_class"), c("pre_gate_score").alias("opportunity_score"),
        "confidence_score", "priority_score", c("momentum_bonus").alias("deal_momentum_bonus"),
        signals.alias("deal_momentum_text"), "high_risks", "medium_risks", "low_risks", F.size("risks").alias("total_risks"),
        F.size("gates").alias("gate_count"), F.size("penalties").alias("penalty_count"),
        (c("social_ratio") * 100).alias("social_dependency_pct"), "strength", "freshness", "traceability_score",
        "authority", "cross_validation", "chain", "data_quality", "execution_readiness")


def dimension_view(scored: DataFrame) -> DataFrame:
    """Display rows of dimensions: label, level, bar width, confidence label and support text."""
    width = F.when(c("weight") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("score") / c("weight") * 100.0)))
    return dimension_rows(scored).select(
        c("entity").alias("name"), "dimension", "label", "weight", "score",
        F.when(c("level") > 0, c("level")).otherwise(L.level_of_score(c("score"), c("weight"))).alias("level"),
        half_even(F.coalesce(width, F.lit(0.0)), 1).alias("width_pct"),
        L.confidence_label(c("confidence")).alias("confidence_label"), "model_level", "objective_level", "support",
        "support_score")


def evidence_view(evidence: DataFrame) -> DataFrame:
    """Display rows of evidence with labels."""
    providers = F.coalesce("provider_count", "retrieval_provider_count", F.lit(0))
    return evidence.select(
        "seq", L.claim_label(c("claim_type")).alias("claim_type_label"),
        L.platform_label(c("platform"), c("source_url")).alias("platform_label"),
        L.tier_label(c("source_tier")).alias("source_tier_label"),
        F.coalesce("importance", F.lit(0)).alias("importance"),
        X.first_text("quote", default="无引用摘要").alias("quote"), "source_url",
        L.traceability_label(F.coalesce("traceability", F.lit(""))).alias("traceability_label"),
        F.when(providers >= 2, F.concat(providers.cast("string"), F.lit(" 个检索渠道命中（非独立互证）"))).otherwise("")
        .alias("provider_text"))


def radar_view(picks: DataFrame) -> DataFrame:
    """Display rows of radar picks with defaults for what is missing."""
    text = lambda name, default: X.first_text(name, default=default).alias(name)
    verified = c("verification_status").isin("verified", "已核验", "原文核验通过", "cross_checked")
    return picks.select(
        "as_of", "rank", X.first_text("company", default="主体待确认").alias("company_name"),
        X.first_text("event", default="事件事实待核实").alias("event_fact"),
        c("event_day").cast("string").alias("event_date"), text("date_basis", "事件发生日"),
        text("core_variable", "核心变量待判断"),
        X.first_text("entry_reason", default="发现了需要核实的新变化，因此进入待核验清单。").alias("admission_sentence"),
        F.slice("tags", 1, 3).alias("fit_tags"), text("publisher", "发布主体待确认"),
        X.first_text("source_type", default="信源类型待确认").alias("publisher_type"),
        X.first_text("title", default="原文标题待核实").alias("source_title"), c("url").alias("source_url"),
        c("verification_status").alias("verification"), verified.alias("verified"), "key_unknown",
        c("next_verification").alias("next_action"), "company_aliases")


def report_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts, one per row."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


# -- publishing -------------------------------------------------------------------------------------

def weekly_decision(runs: DataFrame) -> DataFrame:
    """What each refresh attempt may do: publish, keep the last good report, or report a failure.

    ``runs`` has usable_sources, degraded_sources, candidates and old_candidates (NULL: no old report).
    """
    no_source = c("usable_sources") == 0
    status = (F.when(no_source & c("old_candidates").isNotNull(), "stale_cache").when(no_source, "refresh_failed")
              .when((c("degraded_sources") > 0) & (c("candidates") == 0) & (F.coalesce("old_candidates", F.lit(0)) > 0),
                    "stale_cache")
              .when((c("degraded_sources") > 0) & (c("candidates") > 0), "partial")
              .when(c("candidates") > 0, "ok").otherwise("empty"))
    return runs.withColumn("status", status).withColumn("publish", c("status").isin("ok", "partial", "empty"))


def deep_decision(runs: DataFrame) -> DataFrame:
    """The same for the deep report, which needs evidence and a candidate.  ``runs`` has evidence, candidates."""
    status = (F.when(c("evidence") == 0, "no_verified_evidence").when(c("candidates") == 0, "no_candidate_entities")
              .otherwise("ok"))
    return runs.withColumn("status", status).withColumn("publish", c("status") == "ok")


REQUIRED_FIELDS = ["window_end", "status", "source_status", "candidates", "empty_slots"]


def last_good(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Newest complete run per key; a run that lacks a required field is not read."""
    complete = F.lit(True)
    for name in REQUIRED_FIELDS:
        complete = complete & c(name).isNotNull()
    rest = [x for x in runs.columns if x not in keys]
    picked = runs.filter(complete).groupBy(*keys).agg(F.max_by(F.struct(*rest), "run_id").alias("_r"))
    return picked.select(*keys, "_r.*")


class ReportStore:
    """Reports in run folders with a log; a run that must not be published leaves the last good one."""

    _LOG = "run_id bigint, path string, status string, candidates bigint"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def last(self) -> tuple[int, str | None, int | None]:
        """Run id, path and number of candidates of the last published report."""
        try:
            row = self.spark.read.schema(self._LOG).json(f"{self.root}/log").agg(
                F.max(F.struct("run_id", "path", "candidates")).alias("r")).first()["r"]
        except Exception as error:  # no report yet
            if "PATH_NOT_FOUND" in str(error):
                return 0, None, None
            raise
        return (row["run_id"], row["path"], row["candidates"]) if row else (0, None, None)

    def publish(self, picks: DataFrame, statuses: DataFrame) -> str:
        """Write a weekly report when the rule allows it; returns the status of the attempt."""
        run_id, _, old = self.last()
        run = statuses.agg(F.count_if(c("status").isin("ok", "partial")).alias("usable_sources"),
                           F.count_if(c("status").isin("partial", "error")).alias("degraded_sources"))
        run = run.withColumn("candidates", F.lit(picks.count())).withColumn("old_candidates", F.lit(old).cast("bigint"))
        decision = weekly_decision(run).first()
        if decision["publish"]:
            path = f"{self.root}/reports/run={run_id + 1}"
            picks.write.mode("overwrite").json(path)
            self.spark.createDataFrame([(run_id + 1, path, decision["status"], decision["candidates"])], self._LOG) \
                .write.mode("append").json(f"{self.root}/log")
        return decision["status"]

    def load(self) -> DataFrame | None:
        """The last good report."""
        path = self.last()[1]
        return self.spark.read.json(path) if path else None
