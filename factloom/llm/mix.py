"""Mixing sources to target weights by blocks and pseudorandom index permutations.

The words of a source form one stream (documents in a fixed hashed order), cut into blocks of ``block_words``.  Output
shards draw the number of their slots per source from a multinomial; slot j of a source is block ``permutation(j)`` of
the source's current pass, and blocks are joined by (source, index).  No text moves before a block is known to be taken.

A shard gives each source the whole slots of its share and draws the slots that are left from the multinomial of the
fractions, so that small sources come near their targets as well.  With ``exact=False`` what is drawn is what the mix takes;
only slots beyond the last allowed pass are left out.  With ``exact`` slots drawn beyond a target go to sources that drew too
few and the last slot is cut, so that a source gives exactly its rounded target.  A shorter last block of a source comes at the end of each pass.  Passes are whole except
for the last, so no document is taken more than ``ceil(most)`` times.

Defined cases: a null text has no words; a null source is a source, ordered last; empty tables give no rows; repeated rows
are separate stretches of the stream; other columns are carried along whatever their names (``taken_words`` replaces those
that are named like its results).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD, apart, buckets_for, running_start, together, word_count

MASK = (1 << 64) - 1
#: Weights are given per source, so the table of sources is of the driver's size; beyond this many the mix refuses.
MAX_SOURCES = 1_000_000


@dataclass(frozen=True)
class Mix:
    """``placed``: input rows with _source, _start, _size; ``slots``: shard, slot, source, pass_no, block, words (of the
    block); ``targets``: source, index, size, weight, target, words (one row per source); ``names``: the names of the input's columns in ``placed``."""
    placed: DataFrame
    slots: DataFrame
    targets: pd.DataFrame
    block_words: int
    names: dict[str, str]


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                   most: float = 2.0) -> pd.DataFrame:
    """Targets of all sources in code point order, null last.

    Sources take their weights in turn and share ``share`` of all words; a target stops at ``most`` times its source, and
    what is above is shared again by weight among the others until none is above.
    """
    table = pd.DataFrame(sorted(sizes, key=lambda x: (x[0] is None, x[0] or "")), columns=["source", "size"])
    table["source"] = table["source"].astype(object).where(table["source"].notna(), None)
    size = table["size"].to_numpy(float)
    weight = np.array([weights[i % len(weights)] for i in range(len(table))], float)
    target, free, left = np.zeros(len(table)), np.ones(len(table), bool), share * size.sum()
    while free.any():
        target[free] = left * weight[free] / weight[free].sum()
        above = free & (target > most * size)
        if not above.any():
            break
        target[above] = most * size[above]
        left -= target[above].sum()
        free &= ~above
    table["weight"], table["target"] = weight, target
    table["words"] = np.minimum(np.floor(target + 0.5), np.floor(most * size)).astype(np.int64)
    return table


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutation of range(n) at place i, elementwise: a Feistel network over the next even number of bits,
    walked until the value is below n."""
    n = np.maximum(n, 1).astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    x, todo = i.astype(np.uint64), np.ones(len(i), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> half[todo], x[todo] & low[todo]
            for turn in range(4):
                f = mixed64(right + key[todo] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(turn + 1)) & low[todo]
                left, right = right, left ^ f
            x[todo] = (left << half[todo]) | right
            todo[todo] = x[todo] >= n[todo]
    return x.astype(np.int64)


def mixed64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                block_words: int = 256, shard_blocks: int = 1024, seed: int = 20240101, exact: bool = True) -> Mix:
    """Plan the mix of a table with doc_id, text and source; see the module's text for the method."""
    spark = docs.sparkSession
    docs, columns = apart(docs, ["doc_id", "text", "source", "n_chars"])
    sized = docs.withColumn("_size", word_count("text"))
    found = sized.groupBy("source").agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = source_targets([(r["source"], int(r["n"])) for r in found], weights, share, most)
    targets["index"] = range(len(targets))
    names = spark.createDataFrame([(s, i) for i, s in enumerate(targets["source"])], "_name string, _source int")
    placed = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    order = [F.col("doc_id"), F.col("_size"), F.xxhash64("text")]
    placed = running_start(placed, "_source", order, F.col("_size"), "_start", buckets_for(sum(r["rows"] for r in found)))

    sizes, words = targets["size"].to_numpy(np.int64), targets["words"].to_numpy(np.int64)
    full, tail = sizes // block_words, sizes % block_words
    blocks = full + (tail > 0)
    # Slots that the target asks for (fractions count) and slots that the passes hold.
    whole, rest_words = np.divmod(words, np.maximum(sizes, 1))
    wanted = whole * blocks + np.minimum(-(-rest_words // block_words), blocks)
    asked = wanted if exact else words / np.maximum(sizes, 1) * blocks
    held = int(np.ceil(most)) * blocks
    total = int(np.ceil(asked.sum()))
    shards = -(-total // shard_blocks)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                share = asked / asked.sum() * min(shard_blocks, total - int(shard) * shard_blocks)
                count = np.floor(share).astype(np.int64)
                rest = share - count
                if rest.sum() > 0:
                    count += np.random.default_rng([seed, int(shard)]).multinomial(round(rest.sum()), rest / rest.sum())
                hit = np.flatnonzero(count)
                yield pd.DataFrame({"shard": np.int64(shard), "_source": hit.astype(np.int32), "drawn": count[hit]})

    drawn = spark.range(0, shards, 1, max(1, -(-shards // 256))).mapInPandas(draw, "shard long, _source int, drawn long")
    over, over_from, under_to = np.zeros(0), np.zeros(0), np.zeros(0)
    if exact:
        got = np.zeros(len(targets), np.int64)
        for r in drawn.groupBy("_source").agg(F.sum("drawn").alias("n")).collect():
            got[r["_source"]] = r["n"]
        over, under_to = np.maximum(got - wanted, 0), np.cumsum(np.maximum(wanted - got, 0))
        over_from = np.cumsum(over) - over
    numbered = running_start(drawn, "_source", [F.col("shard")], F.col("drawn"), "first", buckets_for(shards))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["drawn"].to_numpy(np.int64)
            source = np.repeat(batch["_source"].to_numpy(np.int64), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            j = np.repeat(batch["first"].to_numpy(np.int64), n) + place
            spare = j >= wanted[source] if exact else np.zeros(len(j), bool)
            if spare.any():  # beyond its target: handed to the sources that drew too few
                rank = over_from[source[spare]] + j[spare] - wanted[source[spare]]
                to = np.searchsorted(under_to, rank, side="right")
                source[spare], j[spare] = to, wanted[to] - under_to[to] + rank
            pass_no, i = np.divmod(j, blocks[source])
            with np.errstate(over="ignore"):
                key = mixed64(np.uint64(seed & MASK) + mixed64(source.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + pass_no.astype(np.uint64)))
            block = np.where(i < full[source], permuted(np.minimum(i, np.maximum(full[source] - 1, 0)), full[source], key), full[source])
            length = np.where(block < full[source], block_words, tail[source])
            if exact:
                length = np.minimum(length, np.where(pass_no < whole[source], length, rest_words[source] - i * block_words))
            rows = pd.DataFrame({"shard": np.repeat(batch["shard"].to_numpy(np.int64), n), "slot": mixed64(key ^ j.astype(np.uint64)).astype(np.int64),
                                 "_source": source.astype(np.int32), "pass_no": pass_no, "block": block, "words": length})
            yield rows[j < held[source]]

    slots = numbered.select("shard", "_source", "drawn", "first").mapInPandas(fill, "shard long, slot long, _source int, pass_no long, block long, words long")
    return Mix(placed, slots, targets, block_words, columns)


def taken_stretches(mix: Mix) -> DataFrame:
    """What each slot takes of each document: _source, _start (of the document), shard, slot, pass_no, begin, end
    (words of the document, end exclusive).  Both sides grow with the documents, so neither is broadcast."""
    size = F.lit(mix.block_words)
    block = F.col("block") * size
    pieces = (mix.placed.filter("_size > 0").select("_source", "_start", "_size")
              .withColumn("block", F.explode(F.sequence((F.col("_start") / size).cast("long"), ((F.col("_start") + F.col("_size") - 1) / size).cast("long")))))
    begin: Column = F.greatest(F.col("_start"), block)
    end = F.least(F.col("_start") + F.col("_size"), block + F.col("words"))
    return (pieces.join(mix.slots.hint("merge"), ["_source", "block"]).select("_source", "_start", "shard", "slot", "pass_no", (begin - F.col("_start")).alias("begin"), (end - F.col("_start")).alias("end"))
            .filter("end > begin"))


def taken_words(mix: Mix) -> DataFrame:
    """Input rows with size, source_size, target and taken (words that the mix takes of the row, repeats counted)."""
    spark = mix.placed.sparkSession
    taken = taken_stretches(mix).groupBy("_source", "_start").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    rows = list(zip(range(len(mix.targets)), mix.targets["size"].tolist(), mix.targets["target"].tolist(), strict=True))
    sources = F.broadcast(spark.createDataFrame(rows, "_source int, source_size long, target double"))
    # Rows without words have no stretch; they must not meet that of the row which starts at the same word.
    keyed = mix.placed.withColumn("_key", F.when(F.col("_size") > 0, F.col("_start")))
    taken = taken.select(F.col("_source").alias("_s"), F.col("_start").alias("_k"), "taken")
    out = keyed.join(taken.hint("merge"), (F.col("_source") == F.col("_s")) & (F.col("_key") == F.col("_k")), "left").join(sources, "_source")
    results = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.coalesce("taken", F.lit(0).cast("long"))}
    return out.select(*together(mix.names, tuple(results)), *[v.alias(k) for k, v in results.items()])


def mixed_documents(mix: Mix) -> DataFrame:
    """The mix as documents: one row per pass and unbroken stretch of a document, with all columns of the input.

    A document that a pass takes whole keeps its text; else the text runs from its first to its last taken word.  n_chars
    follows the text.  Rows without words take no part.
    """
    stretches = (taken_stretches(mix).groupBy("_source", "_start", "pass_no")
                 .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_parts")))
    rows = mix.placed.filter("_size > 0").join(stretches, ["_source", "_start"])

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series, size: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([_stretch_texts(t, n, p) for t, n, p in zip(text, size, parts, strict=True)])

    out = rows.withColumn("text", F.explode(cut("text", "_size", "_parts")))
    if "n_chars" in mix.names:
        out = out.withColumn("n_chars", F.length("text").cast(mix.placed.schema["n_chars"].dataType))
    return out.select(*together(mix.names))


def _stretch_texts(text: str, size: int, parts: list) -> list[str]:
    runs: list[list[int]] = []
    for p in parts:
        if runs and runs[-1][1] == p["begin"]:
            runs[-1][1] = p["end"]
        else:
            runs.append([p["begin"], p["end"]])
    if runs == [[0, size]]:
        return [text]
    spans = [m.span() for m in re.finditer(WORD, text)]
    return [text[spans[a][0]:spans[b - 1][1]] for a, b in runs]
