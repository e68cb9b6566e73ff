"""Search results in unknown envelopes: JSON in several shapes, labelled text blocks, links, bare URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X

c = F.col
# Containers and fields of search results, in the order they are tried.
CONTAINERS = ["results", "items", "records", "data", "output", "content"]
URL_KEYS = ["url", "source_url", "link", "href", "canonical_url"]
TEXT_KEYS = ["text", "snippet", "summary", "description", "content"]
_TRAILING = "[\\t\\r\\n .,;:!?，。；：！？、)\\]}〉》」』]+$"
_ANY_URL = "(?i)https?://[^\\s<>\"']|\\]\\(https?://[^)\\s]|(?m:^)URL:\\s*https?://\\S"
_ROW = "struct<title:string,url:string,author:string,search_published_at:string,summary:string,provider:string>"


def _get(node: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, f"$.{key}", kind)


def _get_text(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def _has_url(node: Column) -> Column:
    tests = [F.coalesce(_get(node, k), F.lit("")) != "" for k in URL_KEYS]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _is(node: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(node), F.lit(kind)), F.lit(False))


def _parsed(node: Column) -> Column:
    """A value, or what it holds if it is JSON kept as text."""
    return F.when(_is(node, "STRING"), F.coalesce(F.try_parse_json(_get_text(node)), node)).otherwise(node)


def _closed(node: Column) -> Column:
    """Whether a parsed node has nodes below it."""
    return _is(node, "ARRAY") | (_is(node, "OBJECT") & ~_has_url(node))


def _below(n: Column) -> Column:
    """Nodes (p, v) below a node, in order; a step of the path is the place in a list, or the key's rank below 0."""
    at = lambda step, v: F.struct(F.concat(n["p"], F.array(step)).alias("p"), v.alias("v"))
    keys = CONTAINERS + [k for k in TEXT_KEYS if k not in CONTAINERS]
    ranks = {k: F.lit(i - len(keys)).cast("int") for i, k in enumerate(keys)}
    children = [F.when(child.isNotNull() if k in CONTAINERS else _is(child, "STRING"), at(ranks[k], child))
                for k in keys for child in [_get(n["v"], k, "variant")]]
    listed = F.transform(F.try_variant_get(n["v"], "$", "array<variant>"), lambda v, i: at(i, v))
    return (F.when(_is(n["v"], "ARRAY"), listed)
            .when(_closed(n["v"]), F.filter(F.array(*children), lambda x: x.isNotNull()))
            .otherwise(F.array(F.struct(n["p"].alias("p"), n["v"].alias("v")))))


def _chosen(leaves: Column) -> Column:
    """Leaves in order; where an object has several containers with rows, those of the first alone."""
    def parted(a: Column, b: Column) -> Column:
        return F.try_element_at(F.filter(F.zip_with(a, b, lambda x, y: F.when(x != y, y)), lambda y: y.isNotNull()), F.lit(1))

    ordered = F.array_sort(F.transform(leaves, lambda n, i: F.struct(n["p"].alias("p"), i.alias("i"))))
    start = F.struct(F.array().cast("array<int>").alias("p"), F.array().cast("array<int>").alias("kept"))
    kept = F.aggregate(ordered, start, lambda acc, n: F.when(
        (F.size(acc["kept"]) == 0) | F.coalesce(parted(acc["p"], n["p"]) >= 0, F.lit(False)),
        F.struct(n["p"].alias("p"), F.concat(acc["kept"], F.array(n["i"])).alias("kept"))).otherwise(acc))["kept"]
    return F.transform(kept, lambda i: F.get(leaves, i)["v"])


def json_rows(payloads: DataFrame, text: str = "text", levels: int = 4) -> DataFrame:
    """Rows of JSON envelopes: objects with a URL, and what :func:`text_rows` finds in their texts.

    Lists and containers are opened level by level, to any depth, and so is JSON kept as text.  A container that gives
    no row leaves its place to the next one, and the last to the texts.  A look at the data, once for every ``levels``
    levels, tells whether something is still closed.
    """
    base = payloads.columns
    root = F.struct(F.array().cast("array<int>").alias("p"), F.try_parse_json(text).alias("v"))
    nodes = payloads.select(*base, F.array(root).alias("_n")).filter(c("_n")[0]["v"].isNotNull())
    unpacked = F.transform("_n", lambda n: F.struct(n["p"].alias("p"), _parsed(n["v"]).alias("v")))
    while True:
        for _ in range(levels):
            nodes = nodes.select(*base, unpacked.alias("_n"))
            nodes = nodes.select(*base, F.flatten(F.transform("_n", _below)).alias("_n"))
        nodes = nodes.select(*base, unpacked.alias("_n"))
        if nodes.filter(F.exists("_n", lambda n: _closed(n["v"]) | (_is(n["v"], "STRING") & F.try_parse_json(_get_text(n["v"])).isNotNull()))).isEmpty():
            break
    gives = F.filter("_n", lambda n: _is(n["v"], "OBJECT") | (_is(n["v"], "STRING") & _get_text(n["v"]).rlike(_ANY_URL)))
    leaves = nodes.select(*base, gives.alias("_n")).select(*base, F.posexplode(_chosen(c("_n"))).alias("row_pos", "_e"))
    first = lambda keys: F.coalesce(*[F.when(_get(c("_e"), k) != "", _get(c("_e"), k)) for k in keys])
    row = F.struct(first(["title", "name"]).alias("title"), first(URL_KEYS).alias("url"), _get(c("_e"), "author").alias("author"),
                   _get(c("_e"), "search_published_at").alias("search_published_at"), first(TEXT_KEYS).alias("summary"), _get(c("_e"), "provider").alias("provider"))
    leaves = leaves.withColumn("_t", F.when(_is(c("_e"), "STRING"), X.strip(_get_text(c("_e")))))
    rows = F.when(c("_t").isNotNull(), _found(c("_t"))).otherwise(F.array(row.cast(_ROW)))
    return leaves.select(*base, "row_pos", F.posexplode(rows).alias("_sub", "_r")).select(*base, "row_pos", "_sub", "_r.*")


def _blank_row(title: Column, url: Column, summary: Column) -> Column:
    none = F.lit("")
    return F.struct(title.alias("title"), url.alias("url"), none.alias("author"), none.alias("search_published_at"),
                    summary.alias("summary"), none.alias("provider"))


def _found(body: Column) -> Column:
    """Rows of a text: every labelled block, then Markdown links, then bare URLs that were not seen before."""
    def label(block: Column, name: str) -> Column:
        return F.regexp_extract(block, f"(?im)^{name}:\\s*(.+)$", 1)

    def block_row(block: Column) -> Column:
        url = F.regexp_replace(F.regexp_extract(block, "(?im)^URL:\\s*(https?://\\S+)", 1), _TRAILING, "")
        return F.struct(
            X.clean(label(block, "Title"), 300).alias("title"), url.alias("url"),
            X.optional_metadata(label(block, "Author"), 200).alias("author"),
            X.optional_metadata(label(block, "Published"), 100).alias("search_published_at"),
            X.clean(F.regexp_extract(block, "(?ims)^Highlights:\\s*(.+)$", 1), 1000).alias("summary"),
            F.lit("").alias("provider"))

    blocks = F.filter(F.transform(F.split(body, "\\n\\s*---+\\s*\\n"), block_row), lambda r: r["url"] != "")
    link = "(?i)\\[([^\\]]{0,300})\\]\\((https?://[^)\\s]+)\\)"
    titles, targets = (F.regexp_extract_all(body, F.lit(link), F.lit(i)) for i in (1, 2))
    links = F.transform(F.arrays_zip(titles.alias("t"), targets.alias("u")),
                        lambda x: _blank_row(X.clean(x["t"], 300), x["u"], F.lit("")))
    bare = F.transform(F.regexp_extract_all(body, F.lit("(?i)https?://[^\\s<>\"']+"), F.lit(0)),
                       lambda u: _blank_row(F.lit(""), F.regexp_replace(u, _TRAILING, ""), F.substring(body, 1, 1000)))
    found = F.concat(*[x.cast(f"array<{_ROW}>") for x in (blocks, links, bare)])
    urls = F.transform(found, lambda r: r["url"])
    return F.filter(found, lambda r, i: (i < F.size(blocks)) | (F.array_position(urls, r["url"]) == i + 1))


def text_rows(payloads: DataFrame, text: str = "text") -> DataFrame:
    """Rows of text results: every labelled block, then Markdown links, then bare URLs that were not seen before."""
    base = [x for x in payloads.columns if x != text]
    body = X.strip(F.coalesce(c(text), F.lit("")))
    rows = payloads.filter(F.try_parse_json(text).isNull() & body.rlike("(?i)https?://")).select(
        *base, F.posexplode(_found(body)).alias("row_pos", "_r"))
    return rows.select(*base, c("_r.url").alias("url"), "row_pos", "_r.title", "_r.author",
                       "_r.search_published_at", "_r.summary", "_r.provider")
