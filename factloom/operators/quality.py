"""Corpus checks: leaks, secrets, demo data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions import url as U
from factloom.rules import text as T

c = F.col


def leak_scan(documents: DataFrame, path: str | None = None, text: str = "text",
              patterns: list[str] | None = None, markers: list[str] | None = None, path_parts: list[str] | None = None) -> DataFrame:
    """One row per document and rule it breaks: forbidden paths, private markers, embedded secrets.

    ``markers`` and ``path_parts`` name what is private to the user; neutral ones are the default."""
    rules: list[Column] = []

    def rule(name: str, test: Column) -> None:
        rules.append(F.when(F.coalesce(test, F.lit(False)), F.lit(name)))

    if path:
        parts = F.split(F.lower(path), "/")
        forbidden = F.arrays_overlap(parts, F.array(*map(F.lit, path_parts or T.LEAK_PATH_PARTS)))
        rule("forbidden_path", forbidden)
        rule("internal_artifact", F.element_at(parts, -1).rlike(f"^(?:{X.literal_pattern(T.LEAK_NAME_PREFIXES)})"))
    lowered = F.lower(text)
    for marker in markers if markers is not None else T.LEAK_MARKERS:
        rule(f"private_marker:{marker}", F.contains(lowered, F.lit(marker.lower())))
    for i, pattern in enumerate(patterns or T.LEAK_PATTERNS):
        test = c(text).rlike(pattern)
        rule(f"secret:{i}", test if not path else test & ~F.array_contains(F.split(F.lower(path), "/"), "tests"))
    found = F.filter(F.array(*rules), lambda r: r.isNotNull())
    if path:
        # A forbidden path is reported alone.
        found = F.when(F.array_contains(found, "forbidden_path"), F.array(F.lit("forbidden_path"))).otherwise(found)
    keep = [x for x in documents.columns if x != text]
    return documents.select(*keep, F.explode(found).alias("violation"))


def secret_patterns() -> list[str]:
    """Patterns of the corpus scan plus one for every secret-like ``key = value``."""
    return [*T.LEAK_PATTERNS, f"(?i)\\b(?:{T.SECRET_KEYS})\\b\\s*[:=]\\s*[^\\s,;]+"]


def redact_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Redact secrets in a text column and flag the rows that changed (whole texts, white space kept)."""
    safe = F.regexp_replace(c(text), f"(?i)\\b({T.SECRET_KEYS})\\b\\s*[:=]\\s*[^\\s,;]+", "$1=[redacted]")
    return documents.withColumn("redacted", safe != c(text)).withColumn(text, safe)


def is_demo_url(url: Column) -> Column:
    """Whether a URL belongs to bundled or example data."""
    domain = F.lower(U.authority(url))
    path = F.lower(F.regexp_replace(U.path(url), "/+$", ""))
    return F.coalesce(F.endswith(domain, F.lit(".invalid")) | domain.isin("example.com", "www.example.com")
                      | F.endswith(path, F.lit("/123")) | path.isin("/p/123", "/article/123"), F.lit(False))


def demo_reports(evidence: DataFrame, report: str = "report_id", url: str = "source_url",
                 flag: str | None = None) -> DataFrame:
    """One row per report: whether it must be quarantined as demo data."""
    demo = is_demo_url(c(url))
    if flag:
        demo = demo | F.coalesce(c(flag), F.lit(False))
    return evidence.groupBy(report).agg(F.bool_or(demo).alias("is_demo"), F.count_if(demo).alias("demo_rows"))


def quarantine(reports: DataFrame, evidence: DataFrame, report: str = "report_id") -> tuple[DataFrame, DataFrame]:
    """Split reports into real ones and quarantined ones."""
    marked = reports.join(demo_reports(evidence, report), report, "left").withColumn(
        "is_demo", F.coalesce("is_demo", F.lit(False))).drop("demo_rows")
    return marked.filter(~c("is_demo")), marked.filter("is_demo")


def synthetic_violations(records: DataFrame, url_columns: list[str]) -> DataFrame:
    """Rows of a synthetic report whose URLs are not on the reserved host, one per column."""
    bad = F.array(*[F.when((F.coalesce(c(u), F.lit("")) != "") & ~F.endswith(U.host(u), F.lit(".invalid")), F.lit(u))
                    for u in url_columns])
    return records.withColumn("column", F.explode(F.filter(bad, lambda x: x.isNotNull())))
