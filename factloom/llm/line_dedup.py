"""Line deduplication by range-partitioned hashes, native: line keys travel as hashes, keep bitmaps come back, texts stay.

A line's key is the line without ASCII white space at both ends, with A-Z lower-cased.  Keys of ``min_chars`` code points or
more that ``min_documents`` documents hold lose their lines everywhere but in the largest doc_id that holds them.

1. ``line_hashes`` scans the texts once and leaves (128-bit hash, doc_id, text hash, position) of every long line.
2. ``first_occurrences`` range-partitions these rows by hash, sorts them by document (largest first) and position, and
   streams the first row of every document.  A slot (a hash of doc_id) is part of the range key, so that a line that a
   third of all documents share is cut into about the square root of all rows; slots are counted before keys are.
3. ``keep_bitmaps`` returns per document the words of 64 lines in which a line goes (word number, bits of the lines that
   stay), ordered; a word that is not there keeps all its lines.  ``kept_text`` applies them.

Defined cases: a null or empty text is one empty line; rows without doc_id are no document (they do not count and are never
the largest) but lose their lines like others; rows of one doc_id are one document, each row keeps or loses its own lines;
equal rows share one bitmap; an empty table gives no rows.  Inputs may have any other columns: only the named ones are read,
and ``deduplicated`` carries the whole row in one struct, so no name can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCUMENTS = 20, 3
HASH = ["h1", "h2"]
ROW = ["doc", "t1", "t2"]


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The key of a line; ASCII lines (as many bytes as code points) take the quick way to the same result."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart: the doc_id and 128 bits of the text (equal rows have equal bitmaps)."""
    return [doc_id.alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One narrow row per long line: h1, h2 (128 bits of its key), doc, t1, t2 (the row) and pos (the line's number)."""
    rows = docs.select(*row_key(F.col(doc_id), F.col(text)), F.posexplode(lines(F.col(text))).alias("pos", "line"))
    # Bytes are no fewer than code points, so most short lines leave before their key is made.
    keyed = rows.filter(F.octet_length("line") >= min_chars).select(*ROW, "pos", line_key(F.col("line")).alias("key"))
    long = keyed.filter(F.length("key") >= min_chars)
    return long.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *ROW, "pos")


def slotted(hashes: DataFrame) -> DataFrame:
    """Add the slot that cuts a hot key: about the square root of all rows, so slots per key and rows per slot are few."""
    slots = max(1, math.isqrt(hashes.count()))
    return hashes.withColumn("slot", F.pmod(F.xxhash64("doc"), F.lit(slots)).cast("int"))


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """The first row of every key and document, in order of range-partitioned keys, then documents (largest first)."""
    order = [*HASH, "slot", F.desc_nulls_last("doc"), "pos"]
    ranged = hashes.select(*HASH, "slot", "doc", "pos").repartitionByRange(*HASH, "slot").sortWithinPartitions(*order)
    # The window reads what the sort left: its groups lie in one range, so nothing is moved or sorted again.
    before = F.lag("doc").over(Window.partitionBy(*HASH, "slot").orderBy(F.desc_nulls_last("doc"), "pos"))
    marked = ranged.withColumn("_last", before)
    return marked.filter(F.col("doc").isNotNull() & ~F.col("doc").eqNullSafe(F.col("_last"))).select(*HASH, "slot", "doc")


def shared_keys(firsts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Keys that enough documents hold, with the largest (top); counted by slot before they are counted by key."""
    slots = firsts.groupBy(*HASH, "slot").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("top"))
    return slots.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("top").alias("top")).filter(F.col("n") >= min_documents)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Per row of the input that loses a line: doc, t1, t2 and keep, an array of (word, bits) in order of words.

    Bit i of word w tells whether line 64 * w + i stays; words that keep all their lines are left out.
    """
    hashes = slotted(stored(line_hashes(docs, doc_id, text, min_chars)))
    shared = stored(shared_keys(first_occurrences(hashes), min_documents))
    # Verdicts by slot meet the rows of a hot key slot by slot.
    slots = hashes.groupBy(*HASH, "slot").agg(F.lit(1).alias("_held")).join(shared, HASH).select(*HASH, "slot", "top")
    gone = hashes.join(slots, [*HASH, "slot"]).filter(~F.col("doc").eqNullSafe(F.col("top")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy(*ROW, F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def unpacked(keep: Column) -> Column:
    """A bitmap with all its words up to the last one that is there."""
    return F.flatten(F.transform(keep, lambda x, i: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), x["word"] - F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1)) - 1), F.array(x["bits"]))))


def kept_text(text: Column, bits: Column) -> Column:
    """The lines that stay, joined; ``bits`` is an unpacked bitmap or null (all stay)."""
    stays = F.filter(lines(text), lambda x, i: F.coalesce(F.getbit(F.get(bits, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))), F.lit(1)) == 1)
    return F.when(bits.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stays, "\n"))


def n_dropped(keep: Column) -> Column:
    gone = F.transform(keep, lambda x: (64 - F.bit_count(x["bits"])).cast("long"))
    return F.coalesce(F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every input row as a struct ``row``, beside its bitmap ``keep`` and its unpacked form ``bits`` (null where all lines stay)."""
    rows = docs.select(*row_key(F.col(doc_id), F.col(text)), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "doc" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in ROW]
    joined = rows.alias("a").join(bitmaps.alias("b"), same, "left").select("a.row", "b.keep")
    # One element per row: the unpacked bitmap is made once and not once per line.
    return joined.select("row", "keep", F.explode(F.array(unpacked(F.col("keep")))).alias("bits"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with all their columns, and the text without the lines that go."""
    rows = with_bitmaps(docs, keep_bitmaps(docs, doc_id, text, min_chars, min_documents), doc_id, text)
    return rows.select(*[kept_text(F.col("row")[c], F.col("bits")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    narrow = docs.select(doc_id, text)
    rows = with_bitmaps(narrow, keep_bitmaps(narrow, doc_id, text), doc_id, text)
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    breaks = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))
    return rows.select(F.col("row")[doc_id].alias("doc_id"), (breaks + 1).cast("long").alias("n_lines"), n_dropped(F.col("keep")).alias("n_dropped"),
                       F.sha2(kept_text(F.col("row")[text], F.col("bits")), 256).alias("kept_sha256"))
