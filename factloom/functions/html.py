"""Facts of raw HTML: title, publish time, publisher and main text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.dates import any_local_date
from factloom.functions.text import as_column, clean

# Where article pages keep their title, publish time and publisher.
_TITLES = [
    "<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)",
    "<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+property=[\"']og:title[\"']",
    "<h1[^>]+id=[\"']activity-name[\"'][^>]*>(.*?)</h1>",
    "\\bmsg_title\\s*=\\s*['\"]([^'\"]+)",
    "<title[^>]*>(.*?)</title>",
]
_TIMES = [
    "<meta[^>]+property=[\"']article:published_time[\"'][^>]+content=[\"']([^\"']+)",
    "<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+property=[\"']article:published_time[\"']",
    "[\"']publish_time[\"']\\s*:\\s*[\"']([^\"']+)",
]
_EPOCHS = [
    "\\bvar\\s+ct\\s*=\\s*['\"]?(\\d{10,13})",
    "[\"'](?:oriCreateTime|create_time|createTime)[\"']\\s*:\\s*[\"']?(\\d{10,13})",
]
_PUBLISHERS = [
    "\\bnickname\\s*=\\s*['\"]([^'\"]+)",
    "<strong[^>]+class=[\"'][^\"']*profile_nickname[^\"']*[\"'][^>]*>(.*?)</strong>",
    "<span[^>]+id=[\"']js_author_name_text[\"'][^>]*>(.*?)</span>",
    "<span[^>]+id=[\"']js_author_name[\"'][^>]*>(.*?)</span>",
]
_BLOCKS = ["script", "style", "nav", "footer", "header", "aside"]
DEFAULT_PUBLISHER = "微信公众号"


def untag(value: Column, terminated: bool = False) -> Column:
    """Tags to blanks, entities decoded (only those with a semicolon, if ``terminated``), white space collapsed."""
    return clean(F.regexp_replace(value, "<[^>]+>", " "), terminated=terminated)


def _first(page: Column, patterns: list[str], flags: str, terminated: bool = False) -> Column:
    hits = [untag(F.regexp_extract(page, flags + p, 1), terminated) for p in patterns]
    return F.coalesce(*[F.when(h != "", h) for h in hits])


def page_title(value: Column | str, terminated: bool = False) -> Column:
    """Title: og:title, article heading, script variable, title tag; '' when there is none."""
    return F.coalesce(_first(as_column(value), _TITLES, "(?is)", terminated), F.lit(""))


def page_published(value: Column | str) -> Column:
    """Publish time as written in the page, only when it can be read as a date."""
    page = as_column(value)
    hits = [F.regexp_extract(page, "(?i)" + p, 1) for p in _TIMES]
    hits += [F.regexp_extract(page, p, 1) for p in _EPOCHS]
    return F.coalesce(*[F.when((h != "") & any_local_date(h).isNotNull(), h) for h in hits])


def page_publisher(value: Column | str) -> Column:
    """Publisher name of a page."""
    return F.coalesce(_first(as_column(value), _PUBLISHERS, "(?is)"), F.lit(DEFAULT_PUBLISHER))


def page_text(value: Column | str, limit: int | None = None, container: str | None = None, terminated: bool = False) -> Column:
    """Main text: no scripts or page frame; the article or main block when the page has one."""
    page = F.regexp_replace(as_column(value), "(?s)<!--.*?-->", " ")
    for tag in _BLOCKS:
        page = F.regexp_replace(page, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", " ")
    block = F.regexp_extract(page, "(?is)<(article|main)\\b[^>]*>(.*?)</\\1\\s*>", 2)
    marked = F.regexp_extract(page, container or (
        "(?is)<[a-z]+\\b[^>]*class=[\"'](?:[^\"']*\\s)?(?:article|content|post-content|entry-content)"
        "(?:\\s[^\"']*)?[\"'][^>]*>(.*)"), 1)
    body = F.regexp_extract(page, "(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)", 1)
    chosen = [body] if container is None else [body, page]
    order = ([block, marked] if container is None else [marked]) + chosen
    text = untag(F.coalesce(*[F.when(c != "", c) for c in order], F.lit("")), terminated)
    return F.substring(text, 1, limit) if limit else text


def article_text(value: Column | str, limit: int | None = None) -> Column:
    """Main text of a public-account article page."""
    return page_text(value, limit, "(?is)<[a-z]+\\b[^>]*(?:id=[\"']js_content[\"']|"
                                   "class=[\"'][^\"']*rich_media_content[^\"']*[\"'])[^>]*>(.*)")
