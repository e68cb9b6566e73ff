"""Article histories: JSON documents, JSON lines and delimited files, with nested publish groups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.common import checkpointed, settled, small
from factloom.operators.pool import ALIASES, credential_key_count

c = F.col
# Containers of article lists, and of the further items of a publish group.
CONTAINERS = ["articles", "records", "rows", "history", "items", "item", "list", "appmsg", "appmsgs", "appmsg_list",
              "app_msg_list", "appmsg_info", "data", "result"]
GROUP_ITEMS = ["multi_app_msg_item_list", "multi_app_msg_item", "multi_appmsg_item_list", "multi_appmsg",
               "sub_articles"]
_INHERITED = ["account_name", "fakeid", "msgid", "appmsgid", "publish_time", "exported_at", "fetch_mode",
              "credential_status"]


def read_documents(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Whole history files as (source, text); a byte-order mark is dropped."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", encoding)
    return raw.select(F.col("path").alias("source"), F.regexp_replace(text, "^\\ufeff", "").alias("text"),
                      F.sha2("content", 256).alias("fingerprint"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines histories as (source, text), one row per record, split by Spark."""
    return spark.read.text(path).filter(F.trim("value") != "").select(
        F.input_file_name().alias("source"), c("value").alias("text"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV, TSV or ';' histories as (source, text): every row as one JSON document, nested cells decoded."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
        path, sep=sep, encoding=encoding)
    nested = set(CONTAINERS + GROUP_ITEMS + ["app_msg_ext_info", "comm_msg_info"])
    cells = []
    for name in rows.columns:
        value = F.to_json(F.array(F.coalesce(name, F.lit(""))))
        value = F.regexp_replace(value, "^\\[|\\]$", "")
        if name in nested:
            is_json = F.try_parse_json(c(f"`{name}`")).isNotNull() & F.ltrim(c(f"`{name}`")).rlike("^[\\[{]")
            value = F.when(is_json, c(f"`{name}`")).otherwise(value)
        cells.append(F.concat(F.lit(f'"{name}":'), value))
    text = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
    return rows.select(F.input_file_name().alias("source"), text.alias("text"))


# -- folders of mixed files -----------------------------------------------------------------------

_LINE = ["block", "place"]


@contextmanager
def any_charset(spark: SparkSession) -> Iterator[None]:
    """While a plan is made, let it name any charset of the JVM; bytes that it cannot read become U+FFFD."""
    names = ["spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "true")
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def history_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files below ``path`` as they are in bytes: source, block (start of the split), place (order in it), value.

    Spark splits the files; a line feed is never part of another character in UTF-8 or GB18030.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    return rows.select(c("_metadata.file_path").alias("source"), c("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("place"), "value")


def block_facts(lines: DataFrame) -> DataFrame:
    """Per split of a file, in one scan: what :func:`file_facts` needs, and the number of its quotes."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("source", "block").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.sum(F.octet_length("value").cast("bigint") + 1).alias("bytes"),
        F.min_by("value", "place").alias("head"), F.min("place").alias("place"), F.bool_or(quotes % 2 == 1).alias("quoted"),
        F.count_if(F.trim("value") != "").alias("filled"), F.sum(quotes).alias("quotes"))


def file_facts(blocks: DataFrame) -> DataFrame:
    """Per file: utf8 (all its lines are), bytes, head (its first line) and first (where that is), delimited, quoted (a quote is open at a line's end)."""
    facts = blocks.groupBy("source").agg(
        F.bool_and("utf8").alias("utf8"), F.sum("bytes").alias("bytes"), F.min_by("head", F.struct(*_LINE)).alias("head"),
        F.min(F.struct(*_LINE)).alias("first"), F.bool_or("quoted").alias("quoted"), F.sum("filled").alias("filled"))
    return facts.withColumn("delimited", F.lower("source").rlike("\\.(csv|tsv)$"))


def _decoded(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A text of bytes read as UTF-8 where the whole file is, else as GB18030; without byte-order mark and carriage return."""
    with any_charset(spark):
        text = F.when(c("utf8"), c(name)).otherwise(F.decode(c(name).cast("binary"), "GB18030"))
        return df.withColumn(name, F.regexp_replace(text, "^\ufeff|\r$", ""))


def _with_columns(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """Add sep, the one of , tab and ; that stands most often in the header (none: by the name), and its columns (null: not the last of its name)."""
    head = _decoded(spark, facts, "head")
    bare = F.regexp_replace("head", '"[^"]*"', "")
    count = lambda d: F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))
    tsv = F.lower("source").endswith(".tsv")
    best = F.array_max(F.array(*[F.struct(count(d).alias("n"), (tsv if d == "\t" else ~tsv & F.lit(d == ",")).alias("first"), F.lit(d).alias("d")) for d in (",", "\t", ";")]))
    head = head.withColumn("sep", best["d"])
    cells = F.split(bare, c("sep"))
    parsed = F.when(F.contains("head", F.lit('"')), _cells(c("head"), c("sep"))).otherwise(cells)
    head = head.withColumn("_names", parsed)
    later = lambda x, i: F.exists(F.slice("_names", i + 2, F.greatest(F.size("_names") - i - 1, F.lit(0))), lambda y: y == x)
    return head.withColumn("names", F.transform("_names", lambda x, i: F.when(~later(x, i), x))).drop("_names", "head")


def _cells(record: Column, sep: Column) -> Column:
    """Cells of one delimited record (quotes doubled inside quotes), without a schema: a cell goes on while a quote is open."""
    cell = F.concat(sep, F.lit('([^"'), sep, F.lit(']*+(?:"[^"]*+"?+[^"'), sep, F.lit(']*+)*+)'))
    plain = lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    quoted = F.transform(F.regexp_extract_all(F.concat(sep, record), cell, F.lit(1)), plain)
    return F.when(F.contains(record, F.lit('"')), quoted).otherwise(F.split(record, sep, -1))


def _records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines of delimited files joined to records where a quote is open at a line's end; ordered by (block, place) of their first line.

    ``blocks`` has the quotes of every split.  They are summed over the splits of a file, then in a split, so no file is read
    by one task; lines move once, to their split, and only what a split has of a record that began before it is joined after.
    """
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = blocks.select("source", "block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("_open"))
    rows = lines.withColumn("_q", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).join(small(opened), ["source", "block"])
    so_far = Window.partitionBy("source", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    begins = (c("_open") + F.sum("_q").over(so_far) - c("_q")) % 2 == 0
    rows = rows.withColumn("_begin", F.when(begins, c("place"))).withColumn("_own", F.last("_begin", ignorenulls=True).over(so_far))
    text = lambda x: F.array_join(F.transform(F.array_sort(x), lambda y: y["value"]), "\n")
    pieces = checkpointed(rows.groupBy("source", "block", "_own").agg(text(F.collect_list(F.struct("place", "value"))).alias("value")))
    whole = pieces.filter(c("_own").isNotNull()).select("source", "block", c("_own").alias("place"), "value")
    # What a split has of a record that began in an earlier one: one piece at most.
    loose = pieces.filter(c("_own").isNull())
    if loose.isEmpty():
        return whole
    lasts = pieces.groupBy("source", "block").agg(F.max("_own").alias("_last"))
    begun = lasts.select("source", "block", F.max(F.when(c("_last").isNotNull(), F.struct("block", c("_last").alias("place")))).over(earlier).alias("_key"))
    loose = loose.join(begun, ["source", "block"]).select("source", c("_key.block").alias("block"), c("_key.place").alias("place"), c("block").alias("_at"), "value")
    keys = ["source", *_LINE]
    cut = small(loose.select(*keys).distinct())
    parts = whole.join(cut, keys, "left_semi").withColumn("_at", c("block")).unionByName(loose)
    joined = parts.groupBy(*keys).agg(text(F.collect_list(F.struct("_at", "value"))).alias("value"))
    return whole.join(cut, keys, "left_anti").unionByName(joined)


def read_histories(spark: SparkSession, path: str, largest: int = 256_000_000) -> DataFrame:
    """Histories of a folder of mixed files: source, text (one JSON document), fetch_mode and reject_reason, in order of block and place.

    Every file is read as UTF-8 if all of it is, else as GB18030.  Files named .csv and .tsv are delimited by what their header
    says; a row is a document.  In other files, a line that is a document by itself is one; a file whose first line is not, is
    one document.  Lines and rows are split by Spark, however large the file.  A file that is one document of more than
    ``largest`` bytes gives a row with reject_reason 'size', a text that neither encoding reads one with 'encoding'.
    """
    lines = history_lines(spark, path)
    blocks = checkpointed(block_facts(lines))
    facts = checkpointed(_with_columns(spark, file_facts(blocks).withColumn("by_line", F.try_parse_json(F.regexp_replace("head", "^\ufeff", "")).isNotNull())))
    # One row per file.
    rows = _decoded(spark, lines.join(small(facts), "source"), "value")
    delimited = rows.filter("delimited")
    records = delimited.filter("not quoted").select("source", *_LINE, "value").unionByName(_records(delimited.filter("quoted").select("source", *_LINE, "value"), blocks))
    records = records.join(small(facts.select("source", "names", "sep", "first")), "source").filter((F.struct(*_LINE) != c("first")) & (c("value") != ""))
    pairs = F.filter(F.arrays_zip("names", _cells(c("value"), c("sep")).alias("cells")), lambda x: x["names"].isNotNull() & x["cells"].isNotNull())
    as_json = F.to_json(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["names"], x["cells"]))))
    tables = records.select("source", *_LINE, as_json.alias("text"), F.lit("csv_import").alias("fetch_mode"))
    plain = rows.filter("not delimited")
    # A document by itself in every line; a blank one is none.
    singles = plain.filter(c("by_line") & (F.trim("value") != "")).select("source", *_LINE, c("value").alias("text"), F.lit("json_import").alias("fetch_mode"))
    whole = plain.filter(~c("by_line") & (c("bytes") <= largest)).groupBy("source").agg(F.array_sort(F.collect_list(F.struct(*_LINE, "value"))).alias("_l"))
    whole = whole.select("source", c("_l")[0]["block"].alias("block"), c("_l")[0]["place"].alias("place"), F.array_join(F.transform("_l", lambda x: x["value"]), "\n").alias("text"), F.lit("json_import").alias("fetch_mode"))
    bad = F.when(F.contains("text", F.lit("\ufffd")) & ~c("utf8"), "encoding")
    good = tables.unionByName(singles).unionByName(whole).join(small(facts.select("source", "utf8")), "source").withColumn("reject_reason", bad).drop("utf8")
    large = facts.filter(~c("delimited") & ~c("by_line") & (c("bytes") > largest)).select(
        "source", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("string").alias("text"), F.lit("json_import").alias("fetch_mode"), F.lit("size").alias("reject_reason"))
    return good.unionByName(large)


# -- nested documents -----------------------------------------------------------------------------

def _get(node: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, f"$.{key}", kind)


def _first(node: Column, names: list[str], raw: Column | None = None) -> Column:
    """First non-blank of the named fields of a node, then of its ``raw`` object."""
    values = [_get(node, n) for n in names]
    if raw is not None:
        values += [_get(raw, n) for n in names]
    return F.try_element_at(F.filter(F.array(*values), lambda v: v != ""), F.lit(1))


def _is_object(node: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(node), F.lit("OBJECT")), F.lit(False))


def _cell(value: Column) -> Column:
    """A value, or what it holds if it is JSON kept as text."""
    text = F.try_variant_get(value, "$", "string")
    is_json = F.coalesce((F.schema_of_variant(value) == "STRING") & text.rlike("^\\s*[\\[{]"), F.lit(False))
    return F.when(is_json, F.coalesce(F.try_parse_json(text), value)).otherwise(value)


def _lists(node: Column, keys: list[str]) -> Column:
    """The list in each of the named fields of a node that holds one; a single object counts as a list of one."""
    values = F.filter(F.array(*[_get(node, k, "variant") for k in keys]), lambda v: v.isNotNull())
    lists = F.transform(F.transform(values, _cell), lambda v: F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"), F.when(_is_object(v), F.array(v))))
    return F.filter(lists, lambda x: x.isNotNull())


def _below(node: Column) -> Column:
    """Elements of every container of a node, in the order of the keys; without a container, its item lists."""
    lists = _lists(node, CONTAINERS)
    return F.flatten(F.when(F.size(lists) > 0, lists).otherwise(_lists(node, GROUP_ITEMS)))


def _items(node: Column) -> Column:
    """Further items (i, v) of an article; each list counts from 2."""
    return F.flatten(F.transform(_lists(node, GROUP_ITEMS), lambda items: F.transform(
        items, lambda v, i: F.struct((i + 2).alias("i"), v.alias("v")))))


def _inherit(df: DataFrame) -> DataFrame:
    """Context fields of the current node, else those that were passed down."""
    return df.withColumns({k: F.coalesce(_first(c("v"), ALIASES[k], c("_raw")), c(k)) for k in _INHERITED})


# What a text holds if one of its keys may be a container, a group or a raw record (a key may be written with escapes).
_OPENERS = [*CONTAINERS, *GROUP_ITEMS, "app_msg_ext_info", "raw"]
_MAY_NEST = f"\"(?=[{''.join(sorted({k[0] for k in _OPENERS}))}])(?:{'|'.join(_OPENERS)})\"|\\\\u"


def _flat_articles(documents: DataFrame, base: list[str], depth: int) -> DataFrame:
    """Articles of documents that are one object without containers, groups and a raw record: their fields are read from one map."""
    fields = F.try_variant_get(F.try_parse_json("text"), "$", "map<string,string>")
    rows = settled(documents.select(*base, fields.alias("_m")), "_m")

    def first(names: list[str]) -> Column:
        return F.coalesce(*[F.when(F.try_element_at("_m", F.lit(n)) != "", F.try_element_at("_m", F.lit(n))) for n in names])

    rows = rows.select(*base, *[first(names).alias(k) for k, names in ALIASES.items() if k != "group_key"], first(["title"]).alias("_title"))
    text = lambda name: F.coalesce(name, F.lit("None"))
    seed = F.concat_ws("|", text("url"), text("publish_time"), text("_title"))
    key = (F.when(c("msgid").isNotNull(), F.concat(F.lit("msgid:"), "msgid")).when(c("appmsgid").isNotNull(), F.concat(F.lit("appmsgid:"), "appmsgid"))
           .otherwise(F.concat(F.lit("fallback:"), F.substring(F.sha2(seed, 256), 1, 24))))
    rest = [k for k in ALIASES if k not in [*_INHERITED, "group_key"]]
    return rows.filter(c("url").isNotNull()).select(*base, *_INHERITED, key.alias("group_key"), F.array_repeat(F.lit(0), depth).alias("_path"), *rest)


def flatten_history(documents: DataFrame, levels: int = 4) -> DataFrame:
    """One row per article of nested histories, in document order (``_path``).

    Containers are opened level by level, to any depth, and so are items of items; JSON kept as text in a cell is
    opened, too.  Account, message id, publish time and group key pass down to the articles.  The head of a publish
    group has item 1, its further items count from 2.  A document that is no JSON, or that holds no article, gives
    no row (see :func:`unread_documents`).  A look at the data, once for every ``levels`` levels of containers and
    of items, tells whether something is still closed.  Documents that are plainly one article are read apart.
    """
    base = [x for x in documents.columns if x != "text"]
    kept = [*base, *_INHERITED]
    flat = F.coalesce(F.startswith(F.ltrim("text"), F.lit("{")) & ~c("text").rlike(_MAY_NEST), F.lit(False))
    plain = _flat_articles(documents.filter(flat), base, levels + max(2, levels // 2))
    nested = checkpointed(documents.filter(~flat))
    if nested.isEmpty():
        return plain
    level = nested.withColumn("v", F.try_parse_json("text")).filter(c("v").isNotNull()).drop("text")
    level = level.withColumns({k: F.lit(None).cast("string") for k in _INHERITED} | {"_path": F.array().cast("array<int>")})
    group = _is_object(_cell(_get(c("v"), "app_msg_ext_info", "variant")))
    leaf = F.coalesce(group | _first(c("v"), ALIASES["url"], c("_raw")).isNotNull(), F.lit(False))
    with_raw = lambda df: _inherit(df.withColumn("_raw", _get(c("v"), "raw", "variant")))
    while True:
        for _ in range(levels):
            below = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.when(~leaf, _below(c("v"))), F.array("v"))
            level = with_raw(level).select(*kept, "_path", F.posexplode(below).alias("_p", "v"))
            level = level.withColumn("_path", F.concat("_path", F.array("_p"))).drop("_p")
        level = checkpointed(with_raw(level))
        if level.filter(~leaf).isEmpty():
            return _articles(level, base, levels).unionByName(plain)


def _articles(leaves: DataFrame, base: list[str], levels: int) -> DataFrame:
    kept = [*base, *_INHERITED, "group_key", "_path"]
    leaves = leaves.withColumns({"_ext": _cell(_get(c("v"), "app_msg_ext_info", "variant")),
                                 "_comm": _cell(_get(c("v"), "comm_msg_info", "variant"))})
    leaves = leaves.withColumn("_group", _is_object(c("_ext")))
    leaves = leaves.withColumns({
        "_gid": F.when(c("_group"), _first(c("_comm"), ["id", "msgid", "msg_id"])),
        "_time": F.when(c("_group"), _first(c("_comm"), ["datetime", "create_time", "publish_time"])),
        "v": F.when(c("_group"), c("_ext")).otherwise(c("v")), "_item": F.when(c("_group"), 1)})
    leaves = leaves.withColumns({"msgid": F.coalesce("_gid", "msgid"), "publish_time": F.coalesce("_time", "publish_time"),
                                 "_raw": _get(c("v"), "raw", "variant")})
    leaves = _inherit(leaves)
    text = lambda col: F.coalesce(col, F.lit("None"))
    seed = F.concat_ws("|", text(_first(c("v"), ALIASES["url"], c("_raw"))), text(c("publish_time")),
                       text(_first(c("v"), ["title"], c("_raw"))))
    key = (F.when(c("_gid").isNotNull(), F.concat(F.lit("msgid:"), "_gid"))
           .when(c("msgid").isNotNull(), F.concat(F.lit("msgid:"), "msgid"))
           .when(c("appmsgid").isNotNull(), F.concat(F.lit("appmsgid:"), "appmsgid"))
           .otherwise(F.concat(F.lit("fallback:"), F.substring(F.sha2(seed, 256), 1, 24))))
    rows = leaves.withColumn("group_key", key).select(*kept, "_item", "v", F.lit(True).alias("_open"))
    while True:
        for _ in range(max(2, levels // 2)):
            own = F.array(F.struct(c("_item").alias("i"), c("v").alias("v")))
            nodes = F.concat(own, F.filter(_items(c("v")), lambda x: c("_open")))
            rows = rows.select(*kept, F.posexplode(nodes).alias("_p", "_n"))
            rows = rows.withColumns({"_item": c("_n.i"), "v": c("_n.v"), "_open": c("_p") > 0,
                                     "_path": F.concat("_path", F.array("_p")), "_raw": _get(c("_n.v"), "raw", "variant")})
            rows = _inherit(rows)
        rows = checkpointed(rows)
        if rows.filter(c("_open") & (F.size(_items(c("v"))) > 0)).isEmpty():
            break
    fields = {k: _first(c("v"), names, c("_raw")) for k, names in ALIASES.items() if k not in _INHERITED + ["group_key"]}
    fields["itemidx"] = F.coalesce(fields["itemidx"], c("_item").cast("string"))
    return rows.select(*kept, *[v.alias(k) for k, v in fields.items()]).filter(c("url").isNotNull())


def unread_documents(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """Documents that gave no article."""
    return documents.join(articles.select("source").distinct(), "source", "left_anti")


def credential_keys(documents: DataFrame) -> DataFrame:
    """Credential-like keys per document (they are counted, never stored)."""
    return documents.select("source", credential_key_count("text").alias("credential_fields_ignored"))
