"""Article pool: normal form of imported rows, merge, upsert, statistics and window queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.functions import url as U
from factloom.functions.entity import account_key
from factloom.operators.common import beside, checkpointed, indexed, small, spread
from factloom.operators.dedupe import merge_last_non_blank, url_owner
from factloom.operators.joins import new_and_known
from factloom.rules import text as T

c = F.col
KEYS = ["account_key", "canonical_url"]
# Names under which histories and exports carry a field.
ALIASES = {
    "url": ["url", "content_url", "article_url", "source_url", "link"],
    "account_name": ["account_name", "nickname", "nick_name", "wx_name", "mp_name", "account"],
    "fakeid": ["fakeid", "fake_id"],
    "publish_time": ["publish_time", "publishTime", "publish_time_iso", "create_time", "datetime", "timestamp"],
    "msgid": ["msgid", "msg_id"], "appmsgid": ["appmsgid", "appmsg_id", "aid"],
    "itemidx": ["itemidx", "item_idx", "idx"], "title": ["title", "name"], "author": ["author", "author_name"],
    "digest": ["digest", "summary", "description"],
    "cover_url": ["cover_url", "cover", "cover_img", "cover_img_url", "cdn_url"],
    "body_markdown_path": ["body_markdown_path", "markdown_path", "md_path"], "html_path": ["html_path"],
    "image_dir": ["image_dir", "images_dir"], "read_count": ["read_count", "read_num", "readNum"],
    "like_count": ["like_count", "like_num", "old_like_num"], "share_count": ["share_count", "share_num"],
    "favorite_count": ["favorite_count", "favorite_num", "fav_count", "collect_count"],
    "comment_count": ["comment_count", "comment_num"], "comments_path": ["comments_path"],
    "comment_replies_path": ["comment_replies_path", "replies_path"], "copyright_type": ["copyright_type"],
    "copyright_stat": ["copyright_stat"], "is_deleted": ["is_deleted", "deleted"], "fetch_mode": ["fetch_mode"],
    "exported_at": ["exported_at", "downloaded_at", "fetched_at"], "credential_status": ["credential_status"],
    "discovery_query": ["discovery_query", "query_name"], "discovery_provider": ["discovery_provider", "search_provider"],
    "discovered_at": ["discovered_at"], "discovery_rank": ["discovery_rank", "search_rank"], "error": ["error"],
    "group_key": ["group_key"],
}
TEXT_LIMITS = {"title": 1000, "author": 500, "digest": 20_000, "cover_url": 4000, "body_markdown_path": 4000,
               "html_path": 4000, "image_dir": 4000, "comments_path": 4000, "comment_replies_path": 4000,
               "discovery_query": 2000, "discovery_provider": 120}
COUNTS = ["read_count", "like_count", "share_count", "favorite_count", "comment_count", "discovery_rank", "itemidx",
          "copyright_type", "copyright_stat"]
# Fields of a normalised row that a preview reads.
PREVIEW_FIELDS = ["seq", *KEYS, "reject_reason", "publish_time", "group_key", "copyright_type", "copyright_stat", "is_deleted"]


def alias_value(df: DataFrame, names: list[str], raw: str = "raw") -> str:
    """SQL of the first non-blank of alias columns, then of the same fields of a nested ``raw`` struct."""
    options = [f"`{n}`" for n in names if n in df.columns]
    if raw in df.columns and hasattr(df.schema[raw].dataType, "names"):
        options += [f"`{raw}`.`{n}`" for n in names if n in df.schema[raw].dataType.names]
    return "coalesce(" + ", ".join([f"nullif(string({o}), '')" for o in options] + ["string(NULL)"]) + ")"


def normalize_articles(rows: DataFrame, fallback_account: str, fetch_mode: str = "unknown",
                       exported_at: str = "") -> DataFrame:
    """Normal form of imported article rows; rows with a bad URL keep their ``reject_reason``.

    Only the listed fields are kept, so credentials in the input are never stored.
    """
    # Rows that bring their order are dealt to all cores first: reading URLs, texts and dates is the cost of an import.
    rows, seq = (spread(rows, "seq"), "seq") if "seq" in rows.columns else (rows, "monotonically_increasing_id()")
    values = {k: alias_value(rows, names) for k, names in ALIASES.items()}
    # A field that no column carries is a constant, so that nothing is computed for it.
    field = {k: k if v != alias_value(rows, []) else "NULL" for k, v in values.items()}
    v = rows.selectExpr(f"{seq} AS seq", *[f"{v} AS {k}" for k, v in values.items() if field[k] == k or k == "url"])
    # One element per row: filters on the reason stay above this step, so no URL is read twice. Plain links need no lambda.
    v = v.withColumn("_link", U.link_text("url")).withColumn("_asked", U.query_of_plain_article(c("_link"))).withColumn("_plain", U.plain_article(c("_link"), c("_asked")))
    plain = F.struct(c("_plain").alias("url"), F.lit(None).cast("string").alias("reason"))
    v = v.select("*", F.explode_outer(F.array(F.when(c("_plain").isNotNull(), plain).otherwise(U.article_url("url")))).alias("_u"))
    df = v.withColumns({"account_name": X.clean(field["account_name"], 300),
                        "fakeid": X.clean(field["fakeid"], 300)})
    df = df.withColumn("account_name", F.when((c("account_name") == "") & (c("fakeid") == ""), fallback_account)
                       .otherwise(c("account_name")))
    df = df.select(
        "seq", c("_u.url").alias("canonical_url"), c("_u.reason").alias("reject_reason"), "account_name", "fakeid",
        account_key(c("account_name"), c("fakeid")).alias("account_key"),
        D.stamp_epoch(F.expr(field["publish_time"])).alias("publish_time"),
        *[X.clean(field[k], n).alias(k) for k, n in {**TEXT_LIMITS, "msgid": 200, "appmsgid": 200, "group_key": 300}.items()],
        *[N.lenient_long(F.expr(field[k])).alias(k) for k in COUNTS], N.lenient_bool(F.expr(field["is_deleted"])).alias("is_deleted"),
        X.allow_listed(field["fetch_mode"], T.FETCH_MODES, fetch_mode).alias("fetch_mode"),
        X.allow_listed(field["credential_status"], T.CREDENTIAL_STATUSES, "not_stored").alias("credential_status"),
        D.iso_text(F.expr(field["exported_at"]), exported_at).alias("exported_at"),
        D.iso_text(F.expr(field["discovered_at"])).alias("discovered_at"), X.redact(field["error"]).alias("error"))
    group = (F.when(c("group_key") != "", c("group_key"))
             .when(c("msgid") != "", F.concat(F.lit("msgid:"), "msgid"))
             .when(c("appmsgid") != "", F.concat(F.lit("appmsgid:"), "appmsgid"))
             .otherwise(X.fallback_group_key(c("account_key"), c("canonical_url"),
                                             F.coalesce(c("publish_time").cast("string"), F.lit("None")))))
    return df.withColumn("group_key", group)


def original() -> Column:
    """Whether an article is original and not deleted."""
    return F.coalesce((c("copyright_type") == 1) & (c("copyright_stat") == 1) & ~c("is_deleted"), F.lit(False))


def _blank_texts(articles: DataFrame) -> DataFrame:
    """A missing text is stored as ''."""
    return articles.fillna("", subset=[n for n, t in articles.dtypes if t == "string" and n not in KEYS])


def merge_import(articles: DataFrame, also_max: list[str] | None = None, sparse: bool = False) -> DataFrame:
    """One row per account and URL of an import: the last non-blank value of every field wins.

    Columns of ``also_max`` take their largest value.  With ``sparse``, for rows that are stored, only those whose key
    comes more than once are grouped; the others, mostly all, stay where they are.
    """
    good = articles.filter(c("reject_reason").isNull()).drop("reject_reason")
    several, single = good, None
    if sparse:
        again = small(checkpointed(good.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*KEYS)))
        several, single = good.join(again, KEYS, "left_semi"), good.join(again, KEYS, "left_anti")
    merged = merge_last_non_blank(several, KEYS, any_true=["is_deleted", *(also_max or [])])
    merged = _blank_texts(merged if single is None else merged.unionByName(single))
    return merged.withColumn("date_status", F.when(c("publish_time").isNull(), "pending").otherwise("known"))


def scope_counts(articles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Publish groups, distinct URLs and original articles, overall or per account."""
    groups = F.count_distinct("account_key", "group_key").alias("publish_groups")
    urls = F.count_distinct("canonical_url").alias("expanded_url_items")
    originals = F.count_if(original()).alias("original_articles")
    return (articles.groupBy(*by) if by else articles).agg(groups, urls, originals)


def preview_import(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: what an import would add, what exists, what is rejected, and its date range."""
    articles = articles.select(*PREVIEW_FIELDS)
    # Stored, as four counts read them.
    merged = checkpointed(merge_import(articles))
    keys = new_and_known(merged, stored, KEYS).agg(
        F.count_if(~c("known")).alias("added_count"), F.count_if("known").alias("existing_count"))
    raw = articles.agg(F.count(F.lit(1)).alias("raw_records"),
                       F.count_if(c("reject_reason").isNotNull()).alias("rejected_records"))
    kept = merged.agg(F.count(F.lit(1)).alias("accepted_records"),
                      D.local_date(F.min("publish_time")).alias("date_start"),
                      D.local_date(F.max("publish_time")).alias("date_end"))
    one = beside(raw, kept, keys, scope_counts(merged))
    return one.withColumn("duplicate_records_removed",
                          c("raw_records") - c("rejected_records") - c("accepted_records"))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored articles after an import, one row per account and URL.

    A non-blank incoming value replaces the stored one; the error is always the incoming one; a deletion
    mark stays.  New rows get the next ids in the order of arrival.
    """
    known = stored.withColumns({"_seq": F.lit(-1).cast("bigint"), "_in": F.lit(False)})
    arriving = incoming.withColumns({"_seq": c("seq"), "_in": F.lit(True)})
    both = known.unionByName(arriving, allowMissingColumns=True).drop("seq", "date_status")
    fields = [x for x in both.columns if x not in KEYS + ["_seq", "_in", "error", "is_deleted", "id"]]
    merged = both.groupBy(*KEYS).agg(
        *[F.max_by(c(x), F.when(c(x).isNotNull() & (c(x).cast("string") != ""), c("_seq"))).alias(x) for x in fields],
        F.max_by("error", "_seq").alias("error"), F.max("is_deleted").alias("is_deleted"), F.max("id").alias("id"),
        F.min("_seq").alias("_seq"))
    merged = _blank_texts(merged)
    merged = merged.withColumn("date_status", F.when(c("publish_time").isNull(), "pending").otherwise("known"))
    # Only new rows are numbered; stored rows keep their ids.
    fresh = indexed(merged.filter(c("id").isNull()).select(*KEYS, "_seq"), [F.asc("_seq"), *map(F.asc, KEYS)], "_i")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = beside(fresh, top).select(*KEYS, (c("_top") + c("_i") + 1).alias("_id"))
    return (merged.join(numbered, KEYS, "left").withColumn("id", F.coalesce("id", "_id")).drop("_id", "_seq"))


def assign_global_owner(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Give incoming rows the account that owns their URL already, whatever account they came with."""
    owner = url_owner(stored.withColumn("account_id", c("account_key"))).select(
        "canonical_url", c("account_id").alias("_owner"))
    return (incoming.join(owner, "canonical_url", "left")
            .withColumn("account_key", F.coalesce("_owner", "account_key")).drop("_owner"))


def import_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Added, existing and updated rows of an import against the stored articles."""
    compared = [x for x in incoming.columns if x in stored.columns and x not in KEYS + ["seq", "id"]]
    old = stored.select(*KEYS, F.struct(*compared).alias("_old"))
    joined = incoming.join(old, KEYS, "left")
    differs = F.lit(False)
    for x in compared:
        blank = c(x).isNull() | (c(x).cast("string") == "")
        changed = ~c(x).eqNullSafe(c(f"_old.{x}"))
        differs = differs | (changed if x == "error" else (~blank & changed))
    return joined.agg(F.count_if(c("_old").isNull()).alias("added"), F.count_if(c("_old").isNotNull()).alias("existing"),
                      F.count_if(c("_old").isNotNull() & differs).alias("updated"))


# -- read side ------------------------------------------------------------------------------------

def in_scope(scope: str | dict | None) -> Column:
    """Predicate of a scope: all, pending, failed, ready, discovered, an account id or an account name."""
    no_error, has_body = c("error") == "", c("body_markdown_path") != ""
    if not scope or scope == "all":
        return F.lit(True)
    if isinstance(scope, dict):
        if scope.get("fakeid"):
            return c("fakeid") == scope["fakeid"]
        return c("account_name") == scope["account_name"] if scope.get("account_name") else F.lit(True)
    named = {"pending": no_error & (c("publish_time").isNull() | ~has_body), "failed": ~no_error,
             "ready": no_error & c("publish_time").isNotNull() & has_body, "discovered": c("discovered_at") != ""}
    if scope in named:
        return named[scope]
    if scope.startswith("fakeid:"):
        return c("account_key") == scope.casefold()
    return (c("account_name") == scope) | (c("fakeid") == scope)


def select_articles(articles: DataFrame, scope: str | dict | None = None, start: int | None = None,
                    end: int | None = None) -> DataFrame:
    """Articles of a scope and a range of publish times (epoch seconds, both ends included)."""
    df = articles.filter(in_scope(scope))
    if start is not None:
        df = df.filter(c("publish_time") >= start)
    return df.filter(c("publish_time") <= end) if end is not None else df


def list_articles(articles: DataFrame, scope: str | dict | None = None, start: int | None = None,
                  end: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of articles: newest first, undated last."""
    rows = select_articles(articles, scope, start, end)
    limit = max(1, min(int(limit), 10_000))
    return rows.orderBy(c("publish_time").desc_nulls_last(), F.desc("id")).offset(max(0, offset)).limit(limit)


def pool_stats(articles: DataFrame, scope: str | dict | None = None, start: int | None = None,
               end: int | None = None) -> DataFrame:
    """Thirteen statistics of the selected articles in one scan."""
    no_error, has_body, dated = c("error") == "", c("body_markdown_path") != "", c("publish_time").isNotNull()
    found = c("discovered_at") != ""
    group = F.when(c("group_key") != "", F.struct("account_key", "group_key"))
    return select_articles(articles, scope, start, end).agg(
        F.count(F.lit(1)).alias("stored_article_rows"), F.count_distinct("canonical_url").alias("expanded_url_items"),
        F.count_distinct(group).alias("publish_groups"), F.count_distinct("account_key").alias("account_count"),
        F.count_if(original()).alias("original_articles"), F.count_if(~dated).alias("pending_date_items"),
        F.count_if(no_error & dated & has_body).alias("ready"),
        F.count_if(no_error & (~dated | ~has_body)).alias("pending"), F.count_if(~no_error).alias("failed"),
        F.count_if(found).alias("discovered_total"),
        F.count_distinct(F.when(found, c("account_key"))).alias("discovered_accounts"),
        F.max(F.when(found, c("discovered_at"))).alias("last_discovery_at"),
        F.min("publish_time").alias("first_publish_time"), F.max("publish_time").alias("last_publish_time"))


def recent_bounds(as_of: str, days: int) -> tuple[int, int]:
    """First and last second of the ``days`` days that end with a Shanghai day."""
    end = D.day_bounds(None, as_of)[1]
    return end - max(1, days) * 86_400 + 1, end


def recent_articles(articles: DataFrame, as_of: str, days: int = 7, scope: str | dict | None = None,
                    limit: int = 100) -> DataFrame:
    """Articles of the last days, newest first."""
    start, end = recent_bounds(as_of, days)
    return list_articles(articles, scope, start, end, limit)


def recent_summary(articles: DataFrame, as_of: str, days: int = 7, scope: str | dict | None = None) -> DataFrame:
    """Statistics of the same window."""
    start, end = recent_bounds(as_of, days)
    return pool_stats(articles, scope, start, end)


def row_status() -> Column:
    """failed, discovered, ready or pending."""
    body = X.first_text("body_markdown_path", "html_path", default="") != ""
    return (F.when(X.strip(F.coalesce("error", F.lit(""))) != "", "failed")
            .when((X.strip(F.coalesce("discovered_at", F.lit(""))) != "") & ~body, "discovered")
            .when(body & (F.coalesce("publish_time", F.lit(0)) != 0), "ready").otherwise("pending"))


def source_kind() -> Column:
    """How a row came into the pool."""
    return (F.when(X.strip(F.coalesce("discovered_at", F.lit(""))) != "", "discovery")
            .when(c("fetch_mode").isin("known_url", "manual_url", "known_url_public_exporter"), "manual")
            .when(c("fetch_mode").isin("enhanced_export", "body_export"), "exporter").otherwise("import"))


def public_rows(articles: DataFrame) -> DataFrame:
    """Rows that may be shown: status and kind added, private fields dropped."""
    name = F.lower(X.strip("account_name"))
    day = F.when(c("publish_time") > 0, D.local_date(c("publish_time")).cast("string")).otherwise("")
    return articles.withColumns({
        "status": row_status(), "source_kind": source_kind(), "published_at": day,
        "account_name": F.when(name.isin("n/a", "na", "none", "unknown"), "公众号待识别").otherwise(c("account_name")),
    }).drop(*T.PRIVATE_POOL_FIELDS)


def with_accounts(articles: DataFrame, accounts: DataFrame) -> DataFrame:
    """Articles with their account names (inner join)."""
    return articles.drop("account_name", "fakeid").join(
        accounts.select("account_key", "account_name", "fakeid"), "account_key")


def account_rows(articles: DataFrame) -> DataFrame:
    """One row per account: the last non-blank name and id."""
    return merge_last_non_blank(articles.select("account_key", "account_name", "fakeid", c("id").alias("seq")),
                                ["account_key"]).drop("seq")


def credential_key_count(json_text: Column | str) -> Column:
    """Number of credential-like keys in a JSON text (they are never stored)."""
    keys = F.regexp_extract_all(X.as_column(json_text), F.lit('"([^"\\\\]+)"\\s*:'), F.lit(1))
    normal = F.transform(keys, lambda k: F.regexp_replace(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    return F.size(F.filter(normal, lambda k: k.isin(T.CREDENTIAL_KEYS)))
