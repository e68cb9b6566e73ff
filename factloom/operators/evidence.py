"""Evidence rows: admission, normal form, grounding and per-entity counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.functions import url as U
from factloom.functions.entity import entity_key, is_grounded
from factloom.functions.numbers import half_even
from factloom.operators.common import beside, checkpointed, constant_table, indexed, small, top_per_group, with_columns_default
from factloom.rules import scoring as S
from factloom.rules import sources as R
from factloom.rules import text as T

EVIDENCE_COLUMNS = {
    "seq": "bigint", "entity": "string", "claim_type": "string", "event_type": "string",
    "stance": "string", "source_tier": "string", "importance": "int", "source_url": "string",
    "source_title": "string", "quote": "string", "platform": "string", "tags": "array<string>",
    "published_at": "string", "event_date": "string", "captured_at": "string",
    "quote_verified": "boolean", "discovery_only": "boolean", "evidence_eligible": "boolean",
    "retrieval_provider_count": "int", "provider_count": "int", "independent_source_count": "int",
    "independently_corroborated": "boolean",
}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# -- admission and normal form -------------------------------------------------------------------

def admission_reason(strict: bool = False) -> Column:
    """Why an evidence row is not scored; NULL for a row that is."""
    verified = F.coalesce(F.col("quote_verified"), F.lit(False))
    reason = (F.when(F.coalesce(F.col("evidence_eligible"), F.lit(True)) == F.lit(False), "not_eligible")
              .when(F.coalesce(F.col("discovery_only"), F.lit(False)) & ~verified, "unverified_lead")
              .when(X.strip(_text("entity")) == "", "no_entity")
              .when(entity_key("entity") == "", "no_entity_key"))
    return reason.when(~verified, "quote_not_verified") if strict else reason


def admit(evidence: DataFrame, strict: bool = False) -> DataFrame:
    """Rows that may be scored; ``strict`` also asks for a verified quote."""
    return with_columns_default(evidence, EVIDENCE_COLUMNS).filter(admission_reason(strict).isNull())


def admission_counts(evidence: DataFrame, strict: bool = False) -> DataFrame:
    """Rows admitted and ignored, by reason."""
    rows = with_columns_default(evidence, EVIDENCE_COLUMNS)
    reason = F.coalesce(admission_reason(strict), F.lit("admitted"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def normalize(evidence: DataFrame, now: int) -> DataFrame:
    """Normal form of evidence rows at the instant ``now`` (epoch seconds).

    Adds the entity key, host, tier, dates, age, traceability, platform, texts and the negative flag.
    """
    df = with_columns_default(evidence, EVIDENCE_COLUMNS)
    df = df.withColumns({
        "entity": X.strip(_text("entity")), "entity_key": entity_key("entity"),
        "source_url": U.web_url("source_url"), "title": X.strip(_text("source_title")),
        "quote": X.strip(_text("quote")), "claim_type": X.strip(_text("claim_type")),
        "stance": F.when(X.strip(_text("stance")) != "", X.strip(_text("stance"))).otherwise("neutral"),
        "tags": F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), X.strip),
                         lambda t: t != ""),
        "event_epoch": D.fact_epoch("event_date"), "published_epoch": D.fact_epoch("published_at"),
    })
    df = df.withColumns({
        "source_domain": U.host("source_url"), "tag_text": F.array_join("tags", " "),
        "event_type": F.when(_text("event_type") != "", F.col("event_type")).otherwise(F.col("claim_type")),
        "summary": F.when(F.col("quote") != "", F.col("quote")).otherwise(F.col("title")),
        "fact_epoch": F.when(F.coalesce("event_epoch", "published_epoch") <= now,
                             F.coalesce("event_epoch", "published_epoch")),
    })
    has_text = (F.col("title") != "") | (F.col("quote") != "")
    verified = F.coalesce(F.col("quote_verified"), F.lit(False))
    df = df.withColumns({
        "source_tier": U.normal_tier(F.col("source_tier"), F.col("source_domain")),
        "age": D.age_days(F.col("fact_epoch"), now),
        "traceability": F.when(F.col("source_url") == "", "missing")
        .when((F.col("title") != "") & (F.col("quote") != "") & verified, "verified")
        .when(has_text, "matched").otherwise("declared"),
        "platform": F.when(X.strip(_text("platform")) != "", X.strip(_text("platform")))
        .otherwise(U.score_platform(F.col("source_domain"))),
        "blob": F.lower(F.concat_ws(" ", "entity", "title", "quote", "tag_text", "claim_type", "stance")),
        "event_text": F.lower(F.concat_ws(" ", "event_type", "title", "summary")),
        "profile_text": F.lower(F.concat_ws(" ", "title", "summary", "tag_text", "event_type", "platform")),
        "_said": X.near_han(F.concat_ws(" ", "title", "quote", "event_type")),
    })
    return df.withColumns({
        "negative": X.is_negative(F.col("stance"), F.when(F.col("claim_type") != "", F.col("claim_type"))
                                  .otherwise(F.col("event_type")), F.col("_said")),
        **{f"{k}_near": X.near_han(k) for k in ("blob", "event_text", "profile_text")},
    }).drop("_said")


# -- grounding ------------------------------------------------------------------------------------

def eligible_sources(sources: DataFrame, text: str = "clean_text", minimum: int = 80) -> DataFrame:
    """Sources that were read, have a canonical URL and enough text."""
    return sources.filter((F.col("link_status") == "ok") & (_text("canonical_url") != "")
                          & (F.length(X.squash(text)) >= minimum))


def ground_quotes(evidence: DataFrame, pages: DataFrame, squashed: bool = False) -> DataFrame:
    """Join evidence to its page by URL and test quote and entity against the page.

    ``pages`` needs url, page_title and page_text.  Exact mode looks for the trimmed quote; squashed
    mode collapses white space on both sides and keeps the first 300 characters of a found quote.
    Every evidence row stays, with ``reject_reason`` (NULL when it is grounded).
    """
    url = X.strip(_text("source_url"))
    joined = evidence.withColumn("_url", url).join(pages.withColumnRenamed("url", "_url"), "_url", "left")
    quote = X.squash(_text("quote")) if squashed else X.strip(_text("quote"))
    body = X.squash(_text("page_text")) if squashed else _text("page_text")
    importance = F.col("importance").try_cast("int")
    page = F.concat_ws(" ", "page_title", "page_text")
    reason = (F.when(~X.strip(_text("claim_type")).isin(T.CLAIM_TYPES), "claim_type")
              .when(~F.lower(X.strip(_text("stance"))).isin(T.STANCES), "stance")
              .when(X.strip(_text("entity")) == "", "entity")
              .when(~F.col("_url").rlike("^https?://[^/?#]+"), "url")
              .when(F.col("page_text").isNull(), "page_missing")
              .when(~is_grounded(F.col("entity"), page), "entity_not_in_page")
              .when((quote == "") | ~F.contains(body, quote), "quote_not_in_page")
              .when(F.col("importance").isNotNull() & importance.isNull(), "importance"))
    kept = F.substring(quote, 1, 300) if squashed else quote
    return (joined.withColumn("reject_reason", reason)
            .withColumn("quote", F.when(F.col("reject_reason").isNull(), kept).otherwise(F.col("quote")))
            .withColumn("importance", N.clamp(F.coalesce(importance, F.lit(2)), 1, 5).cast("int"))
            .withColumn("quote_verified", F.col("reject_reason").isNull())
            .withColumn("entity_verified", F.col("reject_reason").isNull())
            .withColumn("source_title", F.when(_text("page_title") != "", F.col("page_title"))
                        .otherwise(F.col("_url")))
            .drop("_url"))


#: Lengths of anchors in characters: a quote has the longest that it can fill.
ANCHORS = (1, 2, 4, 8)
#: Anchors of a quote whose pages are counted, spread over it; any of them finds all its places.
CANDIDATES = 32
#: Up to so many distinct quotes, and bytes of them, are looked for one by one: cheaper than the substrings of the pages.
DIRECT_QUOTES, DIRECT_BYTES = 2_000, 1_000_000
#: Quotes, and bytes of them, that one scan of the pages looks for.
SCAN_QUOTES, SCAN_BYTES = 200_000, 64_000_000
#: Bits of the filter that a scan tests grams with: sixteen per key, within these bounds (32 kB to 8 MB).
FILTER_BITS = (1 << 18, 1 << 26)


def _gram_keys(text: Column, size: int, starts: Column | None = None) -> Column:
    """Hashes of the substrings of ``size`` characters (those at the given starts, counted from 0)."""
    def of(chars: Column) -> Column:
        every = F.when(F.size(chars) >= size, F.sequence(F.lit(0), F.size(chars) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(every if starts is None else starts, lambda i: F.xxhash64(*[F.get(chars, i + k) for k in range(size)]))
    return X.bind(F.split(text, ""), of)


def _key_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """One row with the words of a bitmap of the keys, and its number of bits."""
    low, high = FILTER_BITS
    bits = min(high, max(low, 1 << max(0, 16 * keys.count() - 1).bit_length()))
    slot = F.pmod("key", F.lit(bits))
    words = keys.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 64 as int))")).alias("bits"))
    held = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))  # at most bits / 64 words
    gaps = lambda w: F.flatten(F.transform(w, lambda x, i: F.concat(
        F.array_repeat(F.lit(0).cast("bigint"), x["word"] - F.coalesce(F.get(w, i - 1)["word"], F.lit(-1)) - 1), F.array(x["bits"]))))
    return held.select(gaps(F.col("w")).alias("_words")), bits


def _page_keys(pages: DataFrame, keys: DataFrame, sizes: list[int], *columns: str) -> DataFrame:
    """Distinct keys of every page that may be among ``keys``, found inside the scan: (columns, key)."""
    words, bits = _key_filter(keys)
    slot = lambda k: F.pmod(k, F.lit(bits))
    may = lambda k: F.coalesce(F.getbit(F.get("_words", F.floor(slot(k) / 64).cast("int")), (slot(k) % 64).cast("int")), F.lit(0)) == 1
    found = F.flatten(F.array(*[F.filter(_gram_keys(F.col("page_text"), n), may) for n in sizes]))
    return beside(pages.select("page_id", "page_text"), words).select(*columns, F.explode(F.array_distinct(found)).alias("key"))


def search_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that hold a quote when its URL is unknown: exact containment over the whole corpus.

    A quote is looked for by one anchor: of up to ``CANDIDATES`` of its substrings of 8 (4, 2, 1) characters, the one that the fewest
    pages hold.  A first scan counts the pages of the candidates, a second one tests ``contains`` where a page has an
    anchor; both drop all other substrings by a bitmap before they leave the row, and no page is shuffled.  A quote with a
    candidate that no page holds is nowhere.  More than ``SCAN_QUOTES`` quotes take more scans, so what is broadcast is
    bounded.  A few quotes (``DIRECT_QUOTES``) are looked for in one scan without anchors.  ``quotes`` needs quote_id and quote, ``pages`` page_id and page_text; a pair of quote and page row comes once.
    """
    given = quotes.select("quote_id", "quote").filter(F.col("quote") != "")
    wanted = checkpointed(given.withColumn("_batch", F.xxhash64("quote")))
    size = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("quote").cast("bigint")), F.lit(0)).alias("b")]
    total, different = wanted.agg(*size).first(), wanted.select("quote").distinct().agg(*size).first()
    if different["n"] <= DIRECT_QUOTES and different["b"] <= DIRECT_BYTES:
        return _search_directly(wanted.select("quote_id", "quote"), pages)
    scans = max(1, -(-total["n"] // SCAN_QUOTES), -(-total["b"] // SCAN_BYTES))
    out = None
    for k in range(scans):
        part = wanted.filter(F.pmod("_batch", F.lit(scans)) == k).drop("_batch")
        found = _search_once(part, pages)
        out = found if out is None else out.unionByName(found)
    return out


def _search_directly(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Search of few quotes: each page is asked for every distinct one, and no text leaves its row."""
    held = quotes.agg(F.collect_set("quote").alias("_quotes"))  # bounded by DIRECT_QUOTES and DIRECT_BYTES
    found = beside(pages.select("page_id", "page_text"), held).select(
        "page_id", F.explode(F.filter("_quotes", lambda q: F.contains("page_text", q))).alias("quote"))
    return found.join(small(quotes), "quote").select("quote_id", "page_id")


def _search_once(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    length = F.length("quote")
    size = F.lit(ANCHORS[0])
    for n in ANCHORS[1:]:
        size = F.when(length >= n, n).otherwise(size)
    quotes = quotes.withColumn("_size", size)
    # At most one row per length of anchors.
    sizes = sorted(r[0] for r in quotes.select("_size").distinct().collect())
    if not sizes:
        return quotes.crossJoin(pages.select("page_id").limit(0)).select("quote_id", "page_id")
    spread = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(CANDIDATES - 1)), lambda i: F.floor(
        i * (F.length("quote") - n) / (CANDIDATES - 1)).cast("int")))
    keys = F.lit(None).cast("array<bigint>")
    for n in sizes:
        keys = F.when(F.col("_size") == n, _gram_keys(F.col("quote"), n, spread(n))).otherwise(keys)
    candidates = checkpointed(quotes.select("quote_id", "quote", F.explode(F.array_distinct(keys)).alias("key")))
    distinct = candidates.select("key").distinct()
    counts = _page_keys(pages, distinct, sizes, "page_id").groupBy("key").agg(F.count(F.lit(1)).alias("pages"))
    rated = candidates.join(counts, "key", "left").groupBy("quote_id", "quote").agg(
        F.count_if(F.col("pages").isNull()).alias("nowhere"), F.min_by("key", F.struct("pages", "key")).alias("key"))
    # Its bounds were checked: SCAN_QUOTES rows and SCAN_BYTES bytes.
    anchors = checkpointed(rated.filter("nowhere = 0").select("quote_id", "quote", "key"))
    near = _page_keys(pages, anchors.select("key").distinct(), sizes, "page_id", "page_text").join(F.broadcast(anchors), "key")
    return near.filter(F.contains("page_text", "quote")).select("quote_id", "page_id")


# -- per-entity counters ---------------------------------------------------------------------------

def entity_aliases(evidence: DataFrame) -> DataFrame:
    """Distinct spellings per entity key with their row counts (long form)."""
    named = evidence if "entity_key" in evidence.columns else evidence.withColumn("entity_key", entity_key("entity"))
    return (named.withColumn("entity", X.strip(_text("entity"))).filter(F.col("entity_key") != "")
            .groupBy("entity_key", "entity").agg(F.count(F.lit(1)).alias("rows")))


def entity_names(evidence: DataFrame) -> DataFrame:
    """Display name per entity key: the longest spelling, then the greatest; and how many there are."""
    return entity_aliases(evidence).groupBy("entity_key").agg(
        F.max(F.struct(F.length("entity").alias("n"), F.col("entity").alias("name"))).alias("_m"),
        F.count(F.lit(1)).alias("alias_count"), F.sum("rows").alias("evidence_count"),
    ).select("entity_key", F.col("_m.name").alias("entity"), "alias_count", "evidence_count")


def momentum_class() -> tuple[Column, Column]:
    """Deal-momentum signal of a row and its points in tenths (NULL and 0 when it has none)."""
    recent = ~F.col("negative") & F.coalesce(F.col("age") <= 90, F.lit(False))
    signal, points = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for name, value, words in S.MOMENTUM:
        test = recent & F.expr(_words("event_text", words))
        signal, points = signal.when(test, name), points.when(test, int(value * 10))
    return signal, F.coalesce(points, F.lit(0))


def _words(column: str, words: list[str]) -> str:
    """SQL of whether a text has any of the words; words with Han characters are looked for in its short form only."""
    return "(" + " OR ".join(f"contains({column}{'_near' if X.is_near_han(w) else ''}, {X.sql_text(w)})" for w in words) + ")"


def _row_counters(topic: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """SQL of the per-row numbers to sum and of the flags to take the maximum of."""
    positive, strict = "NOT negative AND ", R.TIER_SCORES["score"]
    counts = {
        "n": "true", "dated": "age IS NOT NULL", "recent_90": "age <= 90", "recent_180": "age <= 180",
        "traceable": "source_url <> ''", "verified": "traceability = 'verified'", "t1": "source_tier = 'T1'",
        "t2": f"source_tier <> 'T1' AND tier_points >= {strict['T2']}",
        "authoritative": f"tier_points >= {strict['T2']}",
        "authoritative_strict": f"tier_points >= {strict['T1/T2']}", "official": "source_tier IN ('T1', 'T1/T2')",
        "social": "platform IN (" + ", ".join(map(X.sql_text, R.SOCIAL_PLATFORMS)) + ")",
        "multi_provider": "coalesce(retrieval_provider_count, provider_count) >= 2",
        "corroborated": "independently_corroborated AND independent_source_count >= 2", "negatives": "negative",
    }
    counts |= {f"hit_{k}": positive + _words("blob", w) for k, w in S.HIT_GROUPS.items()}
    counts |= {
        "hit_financing": positive + "age <= 365 AND " + _words("blob", S.FINANCING_WORDS),
        "hit_financing_close": positive + "age <= 365 AND " + _words("blob", S.FINANCING_CLOSE_WORDS),
        "hit_risk": _words("blob", S.RISK_WORDS),
        "objective_customer": positive + _words("event_text", S.OBJECTIVE_CUSTOMER),
        "objective_depth": positive + _words("event_text", S.OBJECTIVE_DEPTH),
        "objective_commercial": positive + _words("event_text", S.OBJECTIVE_COMMERCIAL),
    }
    sums = {k: f"int({v})" for k, v in counts.items()}
    sums["positive_importance"] = "CASE WHEN lower(stance) <> 'negative' THEN greatest(1, coalesce(importance, 2)) END"
    sums["momentum_tenths"] = "momentum_tenths"
    flags = {f"text_{k}": _words("profile_text", w) for k, w in S.TEXT_FLAGS.items()}
    flags |= {f"sector_{k}": _words("sector_text", w) for k, w in T.SECTOR_RULES}
    flags |= {f"topic_{i}": f"contains(overlap_text, {X.sql_text(w)})" for i, w in enumerate(topic)}
    return ({k: f"coalesce(bigint({v}), 0)" for k, v in sums.items()},
            {k: f"coalesce(int({v}), 0)" for k, v in flags.items()})


SUPPORT_COUNTERS = ["n", "authoritative_strict", "verified", "recent_180", "social", "multi_provider",
                    "corroborated"]


def topic_words(topic: str) -> list[str]:
    """Distinct lowercase words of a research topic."""
    return list(dict.fromkeys(topic.replace("，", " ").replace(",", " ").lower().split()))


def counter_rows(items: DataFrame, topic: str = "", keep: list[str | Column] = ()) -> DataFrame:
    """The numbers and flags of every normalised row that :func:`summed_counters` adds up, beside the columns to ``keep``."""
    sums, flags = _row_counters(topic_words(topic))
    rows = items.withColumns({
        "tier_points": U.tier_score(F.col("source_tier")), "momentum_tenths": momentum_class()[1],
        "sector_text": F.lower(F.concat_ws(" ", "title", "summary", "tag_text")),
        "overlap_text": F.lower(F.concat_ws(" ", "entity", "quote", "tag_text")),
        "claim": X.strip(F.when(F.col("claim_type") != "", F.col("claim_type")).otherwise(F.col("event_type"))),
    }).withColumn("sector_text_near", X.near_han("sector_text"))
    return rows.select("entity_key", "source_domain", "claim", *keep, *[F.expr(v).alias(k) for k, v in {**sums, **flags}.items()])


def entity_counters(items: DataFrame, topic: str = "") -> DataFrame:
    """All counters of an entity in one pass over its normalised evidence."""
    return summed_counters(counter_rows(items, topic), topic)


def summed_counters(rows: DataFrame, topic: str = "") -> DataFrame:
    """All counters of an entity from the rows of :func:`counter_rows`.

    Rows are summed per (entity, host, claim), then per (entity, host), then per entity.  Sums run
    before each shuffle, and distinct hosts are counted as groups, so a hot entity is spread over its
    hosts and claims and no distinct set is kept in memory.
    """
    sums, flags = _row_counters(topic_words(topic))
    totals = ", ".join([f"sum({k}) AS {k}" for k in sums] + [f"max({k}) AS {k}" for k in flags])
    spark = rows.sparkSession
    by_claim = spark.sql(f"SELECT entity_key, source_domain, claim, {totals} FROM {{rows}} "
                         "GROUP BY entity_key, source_domain, claim", rows=rows)
    support = {}
    for dim, hints in S.CLAIM_HINTS.items():
        fits = "claim IN (" + ", ".join(map(X.sql_text, hints)) + ")" if hints else "true"
        support |= {f"{dim}__{k}": f"sum(CASE WHEN {fits} THEN {k} ELSE 0 END)" for k in SUPPORT_COUNTERS}
    by_host = spark.sql(
        f"SELECT entity_key, source_domain, {totals}, " + ", ".join(f"{v} AS {k}" for k, v in support.items())
        + " FROM {by_claim} GROUP BY entity_key, source_domain", by_claim=by_claim)
    known = "source_domain <> ''"
    hosts = [f"count_if({known}) AS domains"] + [f"count_if({known} AND {d}__n > 0) AS {d}__domains"
                                                 for d in S.CLAIM_HINTS]
    return spark.sql(f"SELECT entity_key, {totals}, " + ", ".join([f"sum({k}) AS {k}" for k in support] + hosts)
                     + " FROM {by_host} GROUP BY entity_key", by_host=by_host)


def _capped(value: Column, digits: int = 1) -> Column:
    return half_even(F.least(F.lit(100.0), value.cast("double")), digits)


def evidence_scores() -> dict[str, Column]:
    """Composite scores of an entity's counters, in the order they build on each other."""
    c = F.col
    any_rows = c("n") > 0
    ratio = half_even(c("social") / F.greatest(c("n"), F.lit(1)), 2)
    traced = (c("verified") + F.greatest(F.lit(0), c("traceable") - c("verified")) * 0.65) / c("n") * 100
    chain = (c("official") * 18 + F.greatest(F.lit(0), c("authoritative") - c("official")) * 7
             + c("corroborated") * 18 + c("corroborated") * 12 + c("verified") * 6
             + F.least(c("domains"), F.lit(6)) * 5 + F.least(c("recent_180"), F.lit(5)) * 4
             - F.when((ratio >= 0.60) & (c("official") == 0), 18).otherwise(0))
    zero = F.lit(0.0)
    return {
        "social_ratio": ratio,
        "freshness": _capped(c("recent_90") * 22 + F.greatest(F.lit(0), c("recent_180") - c("recent_90")) * 11
                             + c("dated") * 4),
        "traceability_score": F.when(any_rows, _capped(traced)).otherwise(zero),
        "authority": F.when(any_rows, _capped(c("t1") * 28 + c("t2") * 16 + c("domains") * 6)).otherwise(zero),
        "cross_validation": F.when(any_rows, _capped(c("corroborated") * 35)).otherwise(zero),
        "chain": F.when(any_rows, half_even(F.greatest(F.lit(0.0), F.least(F.lit(100.0), chain.cast("double"))), 1))
        .otherwise(zero),
        "strength": _capped(c("n") * 10 + c("domains") * 9 + c("recent_90") * 10 + c("recent_180") * 5
                            + c("verified") * 6 + c("authoritative") * 4),
    }


def with_evidence_scores(counters: DataFrame) -> DataFrame:
    """Add the composite scores and the reliability to entity counters."""
    c = F.col
    reliability = (c("freshness") * 0.20 + c("traceability_score") * 0.25 + c("authority") * 0.20
                   + c("cross_validation") * 0.15 + c("chain") * 0.20)
    return counters.withColumns(evidence_scores()).withColumn(
        "reliability", F.when(c("n") > 0, half_even(reliability, 1)).otherwise(0.0))


EVIDENCE_STATS = ["n", "dated", "recent_90", "recent_180", "domains", "traceable", "verified", "t1", "t2",
                  "authoritative", "official", "social", "multi_provider", "corroborated",
                  "social_ratio", "freshness", "traceability_score", "authority", "cross_validation",
                  "chain", "reliability", "strength"]


def evidence_stats(items: DataFrame) -> DataFrame:
    """Evidence statistics per entity."""
    return with_evidence_scores(entity_counters(items)).select("entity_key", *EVIDENCE_STATS)


def support_score(prefix: str) -> Column:
    """Support score of a dimension from its counters."""
    c = lambda k: F.col(f"{prefix}__{k}")
    raw = (c("n") * 10 + c("authoritative_strict") * 14 + c("verified") * 12 + c("recent_180") * 8
           + c("domains") * 10 + c("corroborated") * 22
           - F.when(social_only(prefix), 12).otherwise(0))
    return F.when(c("n") > 0, half_even(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw.cast("double"))), 1)) \
        .otherwise(0.0)


def social_only(prefix: str) -> Column:
    """Whether all support of a dimension is social and none is authoritative."""
    c = lambda k: F.col(f"{prefix}__{k}")
    return (c("n") > 0) & (c("social") == c("n")) & (c("authoritative_strict") == 0)


def dimension_support(items: DataFrame) -> DataFrame:
    """Evidence support per entity and dimension (long form)."""
    counters = entity_counters(items)
    rows = F.array(*[F.struct(
        F.lit(d).alias("dimension"), F.col(f"{d}__n").alias("n"), F.col(f"{d}__domains").alias("domains"),
        F.col(f"{d}__authoritative_strict").alias("authoritative"), F.col(f"{d}__verified").alias("verified"),
        F.col(f"{d}__recent_180").alias("recent_180"), F.col(f"{d}__multi_provider").alias("multi_provider"),
        F.col(f"{d}__corroborated").alias("corroborated"), social_only(d).alias("social_only"),
        support_score(d).alias("support_score")) for d in S.DIMENSION_KEYS])
    return counters.select("entity_key", F.inline(rows))


def claim_counts(items: DataFrame) -> DataFrame:
    """Rows per entity and claim type."""
    return items.filter(F.col("claim_type") != "").groupBy("entity_key", "claim_type").agg(
        F.count(F.lit(1)).alias("n"))


SIGNALS = (["positive_importance", "negatives", "momentum_tenths", "hit_financing", "hit_risk"]
           + [f"hit_{k}" for k in S.HIT_GROUPS])


def signal_profile(items: DataFrame) -> DataFrame:
    """Keyword hit counters per entity."""
    return entity_counters(items).select("entity_key", *SIGNALS)


# -- ordered evidence ------------------------------------------------------------------------------

def evidence_order() -> list[Column]:
    """Order inside an entity: importance, youngest first with undated last, then arrival."""
    return [F.desc(F.coalesce("importance", F.lit(0))), F.asc(F.coalesce("age", F.lit(99999))), F.asc("seq")]


def evidence_roles() -> Column:
    """The roles a normalised row can have in the lists of :func:`leading_evidence`."""
    importance = N.clamp(F.coalesce(F.col("importance"), F.lit(2)), 1, 5)
    risk_type = F.when(F.lit(False), "")
    for name, words in S.RISK_TYPES:
        risk_type = risk_type.when(F.expr(_words("blob", words)), name)
    risk_type = risk_type.otherwise(S.RISK_TYPE_DEFAULT)
    description = F.when(F.col("quote") != "", F.col("quote")).when(F.col("title") != "", F.col("title")) \
        .otherwise("公开来源出现风险或矛盾表述。")
    severity = F.when(importance >= 4, "高").when(importance >= 3, "中").otherwise("低")
    probability = F.when(importance >= 4, "高").otherwise("中")
    blank = F.lit("")
    role = lambda name, a, b=blank, c=blank, d=blank: F.struct(
        F.lit(name).alias("role"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    return F.filter(F.array(
        F.when(F.col("negative"), role("risk", risk_type, F.substring(description, 1, 120), severity, probability)),
        F.when(momentum_class()[0].isNotNull(), role("momentum", momentum_class()[0])),
        role("title", F.col("title"))), lambda r: r.isNotNull())


def leading_evidence(items: DataFrame) -> DataFrame:
    """First five risks, six momentum signals and three titles per entity, in evidence order.

    All three lists come from one shuffle, and only rows that can reach a list are shuffled. Rows may bring their ``roles``.
    """
    roles = F.col("roles") if "roles" in items.columns else evidence_roles()
    rows = items.select("entity_key", "seq", "importance", "age", F.inline(roles))
    limit = F.when(F.col("role") == "risk", 5).when(F.col("role") == "momentum", 6).otherwise(3)
    top = top_per_group(rows, ["entity_key", "role"], evidence_order(), 6).filter(F.col("_rank") <= limit)
    pick = lambda name: F.sort_array(F.collect_list(F.when(
        F.col("role") == name, F.struct("_rank", "a", "b", "c", "d"))))
    return top.groupBy("entity_key").agg(
        F.transform(pick("risk"), lambda r: F.struct(
            r["a"].alias("risk_type"), r["b"].alias("description"), r["c"].alias("severity"),
            r["d"].alias("probability"))).alias("risks"),
        F.transform(pick("momentum"), lambda r: r["a"]).alias("momentum_signals"),
        F.array_join(F.filter(F.transform(pick("title"), lambda r: r["a"]), lambda t: t != ""), "；")
        .alias("core_product"))


# Facts of a company text: kind, pattern, group, how many; and words of which every lowercase match holds one.
TEXT_FACTS = [
    ("latest_round", S.ROUND_PATTERN, 1, 1), ("funding_total", S.AMOUNT_PATTERN, 1, 1),
    ("latest_valuation", S.VALUATION_PATTERN, 1, 1), ("gross_margin_text", S.MARGIN_PATTERN, 1, 1),
    ("revenue_text", S.REVENUE_PATTERN, 1, 1), ("growth_text", S.GROWTH_PATTERN, 0, 2),
    ("rivals", S.RIVAL_PATTERN, 1, 3),
]
FACT_HEADS = {
    "latest_round": ["pre-", "pre ipo", "seed", "angel", "轮"], "funding_total": ["亿", "万"], "latest_valuation": ["估值", "valuation"],
    "gross_margin_text": ["毛利率"], "revenue_text": ["营收"], "growth_text": ["同比", "yoy", "增长", "提升"],
    "rivals": ["对标", "相比", "竞争对手为", "替代"],
}
BLOCK_ROWS = 256
TAIL_ROWS = 32


def fact_matches(text: Column, own: Column, pattern: str, group: int, count: int) -> Column:
    """First matches (array) of a pattern that start within the first ``own`` characters."""
    rule = F.lit("(?i)" + pattern)

    def step(state: Column, _i: Column) -> Column:
        rest = state["rest"]
        at, whole = F.regexp_instr(rest, rule), F.regexp_extract(rest, "(?i)" + pattern, 0)
        hit = (at > 0) & (state["offset"] + at <= own)
        end = at + F.length(whole) - 1
        return F.when(hit, F.struct(
            F.substring(rest, end + 1, F.length(rest)).alias("rest"), (state["offset"] + end).alias("offset"),
            F.concat(state["found"], F.array(F.regexp_extract(rest, "(?i)" + pattern, group))).alias("found"),
        )).otherwise(F.struct(F.lit("").alias("rest"), state["offset"].alias("offset"),
                              state["found"].alias("found")))

    start = F.struct(text.alias("rest"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, step, lambda s: s["found"])


def text_facts(items: DataFrame, names: DataFrame) -> DataFrame:
    """Financing, growth, margin, revenue and rival facts of the ordered text of an entity.

    The text of an entity is the concatenation of its evidence in order.  It is never built whole: rows
    get their exact position, blocks of consecutive rows are joined with the start of the next block as
    context, and the first matches over all blocks win.  A block holds at most 288 rows however hot the
    entity is.
    """
    order = [F.asc("entity_key"), *evidence_order()]
    rows = indexed(items.select("entity_key", "importance", "age", "seq", "profile_text"), order)
    block = F.floor(F.col("index") / BLOCK_ROWS).cast("bigint")
    spread = F.when(F.col("index") % BLOCK_ROWS < TAIL_ROWS, F.array(block, block - 1)).otherwise(F.array(block))
    parts = rows.select("entity_key", "index", "profile_text", block.alias("home"), F.explode(spread).alias("block"))
    blocks = parts.groupBy("entity_key", "block").agg(
        F.sort_array(F.collect_list(F.struct("index", "home", "profile_text"))).alias("rows"))
    join = lambda own: F.array_join(F.transform(F.filter(
        "rows", (lambda r: r["home"] == F.col("block")) if own else (lambda r: F.lit(True))),
        lambda r: r["profile_text"]), " ")
    texts = blocks.withColumns({"own": join(True), "text": join(False)}).filter(F.col("own") != "").drop("rows")
    # The name of the entity stands before its first row.
    firsts = parts.filter(F.col("home") == F.col("block")).groupBy("entity_key").agg(F.min("block").alias("first"))
    lead = firsts.join(names.select("entity_key", "entity"), "entity_key").select(
        "entity_key", F.col("first").alias("block"), F.concat(F.lower("entity"), F.lit(" ")).alias("lead"))
    texts = texts.join(lead, ["entity_key", "block"], "left").withColumn("lead", F.coalesce("lead", F.lit("")))
    texts = texts.select("entity_key", "block", F.concat("lead", "text").alias("text"),
                         (F.length("lead") + F.length("own")).alias("own"))

    def rows_of(kind: str, matches: Column) -> Column:
        return F.transform(matches, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), v.alias("value")))

    def found(kind: str, pattern: str, group: int, count: int) -> Column:
        heads = F.expr(" OR ".join(f"contains(text, {X.sql_text(w)})" for w in FACT_HEADS[kind]))
        return F.when(heads, fact_matches(F.col("text"), F.col("own"), pattern, group, count)).otherwise(F.array().cast("array<string>"))

    facts = F.flatten(F.array(*[rows_of(k, found(k, p, g, n)) for k, p, g, n in TEXT_FACTS]))
    rows = texts.select("entity_key", "block", F.inline(facts))
    top = top_per_group(rows, ["entity_key", "kind"], [F.asc("block"), F.asc("i")], 3)
    limits = X.constant_map([(k, n) for k, _, _, n in TEXT_FACTS])
    top = top.filter(F.col("_rank") <= F.element_at(limits, F.col("kind")))
    values = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(
        F.col("kind") == kind, F.struct("_rank", "value")))), lambda r: r["value"])
    singles = {k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("value"))), F.lit(""))
               for k, _, _, n in TEXT_FACTS if n == 1}
    return top.groupBy("entity_key").agg(
        *[v.alias(k) for k, v in singles.items()],
        F.array_join(values("growth_text"), "；").alias("growth_text"), values("rivals").alias("rivals"))


def hint_table(spark) -> DataFrame:
    """Claim types that support each dimension; a dimension without hints has one blank row."""
    return constant_table(spark, [(d, h) for d, hs in S.CLAIM_HINTS.items() for h in (hs or [""])],
                          "dimension string, claim string")


def view_diagnostics(evidence: DataFrame, now: int, keys: list[str]) -> DataFrame:
    """Fallback diagnostics straight from evidence rows: strength, freshness, traceability, authority, quality."""
    df = with_columns_default(evidence, EVIDENCE_COLUMNS)
    epoch = F.coalesce(D.fact_epoch("event_date"), D.fact_epoch("published_at"))
    age = F.greatest(F.lit(0.0), (F.lit(now) - epoch) / 86400.0)
    fresh = F.when(epoch.isNull(), 0.0).otherwise(F.greatest(F.lit(12.0), 100.0 - F.least(age, F.lit(365.0)) * 0.22))
    traced = ((_text("source_url") != "") & (_text("quote") != "")
              & F.coalesce(F.col("quote_verified"), F.lit(False)))
    cross = (F.coalesce("independently_corroborated", F.lit(False))
             & (F.coalesce("independent_source_count", F.lit(0)) >= 2))
    domain = F.when(_text("source_url") != "", F.lower(U.authority(F.col("source_url"))))
    rows = df.select(*keys, domain.alias("_d"), fresh.alias("_f"), traced.cast("bigint").alias("_t"),
                     cross.cast("bigint").alias("_c"),
                     U.tier_score(F.when(_text("source_tier") == "", "unknown").otherwise(F.col("source_tier")),
                                  "view").alias("_a"))
    hosts = rows.groupBy(*keys, "_d").agg(F.sum("_f").alias("_f"), F.sum("_t").alias("_t"), F.sum("_c").alias("_c"),
                                          F.sum("_a").alias("_a"), F.count(F.lit(1)).alias("_n"))
    total = hosts.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count("_d").alias("domains"), (F.sum("_f") / F.sum("_n")).alias("fresh"),
        (F.sum("_a") / F.sum("_n")).alias("authority"), (F.sum("_t") / F.sum("_n") * 100.0).alias("traced"),
        F.least(F.lit(100.0), F.sum("_c") * 35.0).alias("cross"))
    c = F.col
    strength = F.least(F.lit(100.0), c("n") * 9.0 + c("domains") * 8.0)
    return total.select(
        *keys, half_even(strength, 1).alias("evidence_strength"), half_even(c("fresh"), 1).alias("freshness_score"),
        half_even(F.least(F.lit(100.0), c("traced")), 1).alias("traceability_score"),
        half_even(c("authority"), 1).alias("source_authority_score"),
        half_even(c("cross"), 1).alias("cross_validation_score"),
        half_even(c("traced") * 0.35 + c("authority") * 0.30 + c("cross") * 0.35, 1).alias("data_quality"),
        half_even(strength * 0.45 + c("fresh") * 0.20 + c("cross") * 0.35, 1).alias("execution_readiness"))


