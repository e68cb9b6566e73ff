"""Saved archives, feeds, captures, bodies, URL lists, batch outputs and rule files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import html as H
from factloom.functions import text as X
from factloom.functions import url as U
from factloom.operators.common import checkpointed, keep_first, small, top_per_group

c = F.col
MAX_BODY_BYTES = 2 * 1024 * 1024
MAX_HTML_BYTES = 4 * 1024 * 1024
DATE_SUFFIX = "\\s*[-–—]\\s*(20\\d{2}-\\d{2}-\\d{2})\\s*$"

# Start tag of a feed item that is not empty; fields of an item, of which the first of each name counts.
ITEM_START = r"<item(?:\s(?:[^>]*[^/>])?)?>"
ITEM_SCHEMA = ("title array<string>, link array<string>, pubDate array<string>, source array<struct<_VALUE: string, _url: string>>, "
               "description array<string>, _corrupt string")

META_SCHEMA = ("canonical_url string, source_url string, resolved_url string, article_url string, url string, "
               "title string, account_name string, account string, publisher string, author string, "
               "publish_time string, published_at string, publish_date string, raw_html_path string, "
               "text_path string, saved_file string")
CAPTURE_SCHEMA = ("requested_url string, final_url string, canonical_url string, title string, text string, "
                  "html_sha256 string, platform string, source_tier string, provider string, "
                  "providers array<string>, query string, query_hits array<string>, published_at string, "
                  "captured_at string, discovery_source_pack string")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _resolve(folder: Column, value: Column) -> Column:
    """Absolute form of a stored path: as it is with a leading '/', else inside the folder."""
    plain = F.regexp_replace(value, "^file:/*", "/")
    return F.when(plain.startswith("/"), plain).otherwise(F.concat(folder, F.lit("/"), plain))


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """Saved articles of an archive: every meta.json with the text and page stored beside it.

    A text or page is only used when it lies inside the archive, has an allowed ending and is not too
    large; a missing publish time is taken from the page.
    """
    base = _plain(F.lit(root.rstrip("/")))
    metas = spark.read.schema(META_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "meta.json").json(root)
    metas = metas.withColumn("folder", _folder(_plain(c("_metadata.file_path"))))
    urls = [U.article_url(x)["url"] for x in ("canonical_url", "source_url", "resolved_url", "article_url", "url")]
    metas = metas.withColumns({
        "found_url": F.coalesce(*urls),
        "text_file": _resolve(c("folder"), X.first_text("text_path", "saved_file", default=F.lit("article_text.txt"))),
        "html_file": _resolve(c("folder"), X.first_text("raw_html_path", default=F.lit("article_raw.html")))})
    inside = lambda p: F.startswith(p, F.concat(base, F.lit("/"))) & ~F.contains(p, F.lit("/../"))
    texts = _stored(spark, root, "*.{txt,md}", MAX_BODY_BYTES).withColumnRenamed("file", "text_file")
    pages = _stored(spark, root, "*.{html,htm}", MAX_HTML_BYTES).select(
        c("file").alias("html_file"), H.page_published("content").alias("page_time"))
    df = metas.filter(c("found_url").isNotNull()).join(texts, "text_file", "left").join(pages, "html_file", "left")
    body = F.when(inside(c("text_file")), X.strip(F.coalesce("content", F.lit("")))).otherwise("")
    account = X.first_text("account_name", "account", "publisher", "author", default="本地已保存公众号")
    when = F.coalesce(X.blank_to_null(c("publish_time")), X.blank_to_null(c("published_at")),
                      X.blank_to_null(c("publish_date")), F.when(inside(c("html_file")), c("page_time")))
    return df.select(
        account.alias("account_name"), X.strip(F.coalesce("title", F.lit(""))).alias("title"),
        c("found_url").alias("url"), when.alias("publish_time"), X.strip(F.coalesce("author", F.lit(""))).alias("author"),
        body.alias("body"), F.when(body != "", "body_export").otherwise("metadata_only").alias("fetch_mode"),
        F.lit("not_stored").alias("credential_status"))


def _stored(spark: SparkSession, root: str, pattern: str, limit: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.filter(c("length") <= limit).select(_plain(c("path")).alias("file"),
                                                     F.decode("content", "UTF-8").alias("content"))


def read_dated_links(spark: SparkSession, path: str) -> DataFrame:
    """A saved link list: the date at the end of a title becomes the publish time."""
    rows = spark.read.schema("url string, title string, account_name string").option("multiLine", True).json(path)
    return dated_links(rows)


def dated_links(rows: DataFrame) -> DataFrame:
    """Split ``title - YYYY-MM-DD``; rows without a valid article URL are dropped."""
    title = X.strip(F.coalesce("title", F.lit("")))
    return rows.select(
        X.first_text("account_name", default="历史链接导入").alias("account_name"),
        X.strip(F.regexp_replace(title, DATE_SUFFIX, "")).alias("title"), U.article_url("url")["url"].alias("url"),
        F.regexp_extract(title, DATE_SUFFIX, 1).alias("publish_time"), F.lit("metadata_only").alias("fetch_mode"),
        F.lit("not_stored").alias("credential_status")).filter(c("url").isNotNull())


def read_feed(spark: SparkSession, path: str, per_feed: int | None = 50, charset: str = "UTF-8") -> DataFrame:
    """Saved RSS feeds as lead records; the first ``per_feed`` items of each file, in order (all with None)."""
    return feed_records(feed_items(spark, path, per_feed, charset))


def feed_items(spark: SparkSession, path: str, per_feed: int | None = 50, charset: str = "UTF-8") -> DataFrame:
    """Items of saved feeds: feed (file), pos (from 0) and item (the XML inside of it).

    Files are cut at the items' end tags by the text reader, so that the tasks share a large file and none holds more than
    an item.  What has no item (head, tail, an item that a comment hides) is passed by; an item that another one or the
    file's end breaks off stays, for :func:`feed_rejects`.  An end tag inside CDATA breaks its item off as well.
    """
    raw = spark.read.option("lineSep", "</item>").option("encoding", charset).text(path).select(
        c("_metadata.file_path").alias("feed"), c("_metadata.file_block_start").alias("_block"), "value")
    start = F.regexp_extract("value", ITEM_START, 0)
    cut = raw.filter(start != "").withColumn("_at", F.instr("value", start))
    hidden = F.substring("value", F.lit(1), c("_at") - 1).rlike("(?s)<!--(?!.*-->)")
    items = cut.filter(~hidden).select("feed", "_block", F.monotonically_increasing_id().alias("_row"), F.substring("value", c("_at") + F.length(start), F.length("value")).alias("item"))
    if per_feed is None:
        # The items of a split have consecutive numbers; they are stored, so that splits and numbers stay the same, and not moved.
        stored = checkpointed(items)
        splits = stored.groupBy("feed", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
        before = Window.partitionBy("feed").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        starts = checkpointed(splits.select("feed", "_block", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - c("_first")).alias("_start")))
        return stored.join(small(starts), ["feed", "_block"]).select("feed", (c("_row") + c("_start")).alias("pos"), "item")
    return top_per_group(items, ["feed"], [c("_block"), c("_row")], per_feed).select("feed", (c("_rank") - 1).cast("long").alias("pos"), "item")


def _parsed(items: DataFrame, references: Sequence[str] | None) -> DataFrame:
    """Items with the fields of their XML; ``_broken`` marks those that are none."""
    item = F.from_xml(F.concat(F.lit("<item>"), "item", F.lit("</item>")), ITEM_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = items.select("feed", "pos", "item", item.alias("_x"))

    def first(name: str) -> Column:
        return F.coalesce(F.try_element_at(f"_x.{name}", F.lit(1)), F.lit(""))

    def clean(value: Column) -> Column:
        return X.clean(value, names=references)

    source = F.try_element_at("_x.source", F.lit(1))
    publisher = clean(source["_VALUE"])
    title = clean(first("title"))
    tail = F.concat(F.lit(" - "), publisher)
    short = F.when((publisher != "") & F.endswith(title, tail), X.strip(
        F.substring(title, F.lit(1), F.length(title) - F.length(tail)))).otherwise(title)
    return rows.select(
        "feed", "pos", "item", short.alias("title"), clean(first("link")).alias("url"), clean(first("pubDate")).alias("published_at"),
        publisher.alias("publisher"), clean(source["_url"]).alias("publisher_url"),
        clean(F.regexp_replace(first("description"), "<[^>]+>", " ")).alias("summary"), F.lit("google_news_rss").alias("source_type"),
        F.lit(True).alias("discovery_only"), (c("_x").isNull() | c("_x._corrupt").isNotNull()).alias("_broken"))


def feed_records(items: DataFrame, references: Sequence[str] | None = None) -> DataFrame:
    """Records of feed items (feed, pos, item XML); a broken one, or one without title, link or date, is dropped.

    Of the HTML references that the XML holds as text, all are decoded, or only those named in ``references`` (see :func:`text.unescape`).
    """
    return _parsed(items, references).filter(~c("_broken") & (c("title") != "") & (c("url") != "") & (c("published_at") != "")).drop("item", "_broken")


def feed_rejects(items: DataFrame, references: Sequence[str] | None = None) -> DataFrame:
    """The items that give no record of :func:`feed_records`: feed, pos, item and reject_reason."""
    reason = F.when(c("_broken"), "broken_xml").when(c("title") == "", "no_title").when(c("url") == "", "no_link").when(c("published_at") == "", "no_date")
    return _parsed(items, references).select("feed", "pos", "item", reason.alias("reject_reason")).filter(c("reject_reason").isNotNull())


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages; a broken file gives a row with only ``_corrupt_record``."""
    return spark.read.schema(CAPTURE_SCHEMA + ", _corrupt_record string").option("multiLine", True).option(
        "mode", "PERMISSIVE").json(path)


def read_bodies(spark: SparkSession, root: str, limit: int = 200_000) -> DataFrame:
    """Stored bodies: (file, body) of .md and .txt files up to two MiB; the first ``limit`` characters."""
    files = _stored(spark, root, "*.{md,txt}", MAX_BODY_BYTES)
    return files.select(c("file"), X.clean("content", limit).alias("body"))


def body_name(url: Column) -> Column:
    """File name under which the body of a URL is stored."""
    return F.concat(F.sha2(url, 256), F.lit(".md"))


def body_text(title: Column, publisher: Column, day: Column, body: Column) -> Column:
    """Text that is stored for a read article."""
    date = F.coalesce(day.cast("string"), F.lit("待确认"))
    return F.concat(F.lit("# "), X.first_text(title, default="公众号文章"), F.lit("\n\n公众号："),
                    X.first_text(publisher, default="微信公众号"), F.lit("\n\n发布日期："), date, F.lit("\n\n"), body, F.lit("\n"))


def read_url_list(spark: SparkSession, path: str, limit: int | None = 30) -> DataFrame:
    """A URL list: blank lines and '#' lines dropped, first of each, in order."""
    lines = spark.read.option("wholetext", True).text(path).select(
        F.posexplode(F.split(F.regexp_replace("value", "^\\ufeff|\\r", ""), "\\n")).alias("line", "value"))
    return url_list(lines, limit)


def url_list(lines: DataFrame, limit: int | None = 30) -> DataFrame:
    """Accepted URLs of (line, value); a full-width comma also ends a line; at most ``limit`` of them."""
    rows = lines.select("line", F.posexplode(F.split("value", "，")).alias("part", "url")).withColumn("url", X.strip("url"))
    web = c("url").rlike("(?i)^https?://") & (U.host("url") != "") & (F.length("url") <= 2048)
    good = rows.filter((c("url") != "") & ~F.startswith("url", F.lit("#")) & web)
    first = keep_first(good, ["url"], c("line"), c("part")).orderBy("line", "part")
    return (first.limit(limit) if limit else first).select("url", "line", "part")


def read_batch(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Output of a download batch: its index and its error list."""
    index = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/index.csv")
    errors = spark.read.schema("seq string, source_url string, error string").option("multiLine", True).json(
        f"{folder}/errors.json")
    bodies = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.md").load(folder).select(_plain(c("path")).alias("file"), F.lit(True).alias("body_ok"))
    base = _plain(F.lit(folder.rstrip("/")))
    safe = ~c("path").rlike("^/|(?:^|/)\\.\\.(?:/|$)") & F.lower("path").rlike("\\.md$")
    index = index.withColumn("file", F.when(safe, F.concat(base, F.lit("/"), "path")))
    return index.join(bodies, "file", "left").withColumn("body_ok", F.coalesce("body_ok", F.lit(False))).drop("file"), errors


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Keyword rules of a radar rule file (long form: kind, name, position, keyword)."""
    raw = spark.read.schema(
        "core_variables array<struct<name:string,keywords:array<string>>>, sector_keywords map<string,array<string>>, "
        "confirmed_event_patterns map<string,array<string>>, non_event_patterns array<string>, "
        "excluded_late_stage_patterns array<string>, entity_stopwords array<string>").option("multiLine", True).json(path)
    variables = raw.select(F.posexplode("core_variables").alias("ord", "v")).select(
        F.lit("core_variable").alias("kind"), c("v.name").alias("name"), "ord", F.posexplode("v.keywords").alias("pos", "keyword"))

    def of_map(name: str, kind: str) -> DataFrame:
        rows = raw.select(F.posexplode(F.map_entries(name)).alias("ord", "e"))
        return rows.select(F.lit(kind).alias("kind"), c("e.key").alias("name"), "ord",
                           F.posexplode("e.value").alias("pos", "keyword"))

    def of_list(name: str, kind: str) -> DataFrame:
        return raw.select(F.lit(kind).alias("kind"), F.lit("").alias("name"), F.lit(0).alias("ord"),
                          F.posexplode(name).alias("pos", "keyword"))

    return (variables.unionByName(of_map("sector_keywords", "sector"))
            .unionByName(of_map("confirmed_event_patterns", "confirmed"))
            .unionByName(of_list("non_event_patterns", "non_event"))
            .unionByName(of_list("excluded_late_stage_patterns", "late_stage"))
            .unionByName(of_list("entity_stopwords", "stopword")))


def union_archive(saved: DataFrame, links: DataFrame) -> DataFrame:
    """Saved bodies and dated links of an archive as import rows."""
    return saved.unionByName(links, allowMissingColumns=True)


def first_items(items: DataFrame, per_feed: int = 50) -> DataFrame:
    """First items per feed."""
    return top_per_group(items, ["feed"], [F.asc("pos")], per_feed).drop("_rank")
