"""Exact n-gram Jaccard join by partitioning the universe of tokens (pigeonhole), with one-deletion neighbourhoods.

Two sets with r <= s tokens and Jaccard similarity >= t differ in at most H = (1 - t) / (1 + t) * (r + s) tokens.  Sizes
are cut into bands; each band hashes tokens into ``segments(band)`` = H + 1 segments, H being that of its largest pairs,
so that two similar sets agree on some segment.  More generally, when a set gives each segment i a level v_i of 0 (skip),
1 (must be equal) or 2 (equal but for one token) and the levels sum to H + 1, some segment meets its level: else the sets
would differ in more than H tokens.  Every set indexes its segment subsets, and the one-deletion neighbourhoods of
the band's first segments; every set probes by the levels of least cost, the cost of a subset being the exact number of
sets that index it.  So empty or common subsets (of shared passages) are skipped wherever the others can pay for it.

Equal sets are one class before anything else, so exact copies cost one row each.  Candidates are taken per subset as a
star around its most connected set; sets that the star does not link are then compared with all others of the subset, so
that no link between different sets that the components need is lost, and a group of near copies does not become all
its pairs.  Every candidate is verified on the full sets.  Components are the smallest ids over verified links, by
alternating minimum propagation and shortcuts.

Defined cases: null and empty texts have the empty set and link with nothing; fewer words than ``words`` make one shingle;
rows with a null doc_id are classes by text like all others, and their id counts as larger than any; repeated rows
are copies; an empty table gives no rows; columns other than doc_id and text are not read.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import apart, release, shared_folder, stored, together

#: Words whose hashes a task remembers.
MEMORY = 250_000
#: Subset entries that a task gathers before it deals them out; entries of one subset beyond which they pass uncounted.
FLUSH, HOT = 600_000, 64
#: Bytes of text for each bucket of subset entries (an entry takes 20 bytes, a text about as many bytes as its entries).
BUCKET_BYTES = 16_000_000
#: Members of a subset up to which pairs are joined as rows, and rows and bytes of a block beyond it; both ways are exact.
FEW, BLOCK, BLOCK_BYTES = 16, 1024, 8_000_000
#: Bits of the fixed-size filter that picks the texts of candidates.
FILTER_BITS = 1 << 27
BAND = 1.4
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; linked where 100 * intersection >= ``percent`` * union."""
    words: int = 5
    percent: int = 80

    def differ(self, total: int) -> int:
        """The most tokens in which two similar sets of ``total`` tokens together differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def similar(self, r: int, s: int, common: int) -> bool:
        return 100 * common >= self.percent * (r + s - common)

    def smallest(self, size: int) -> int:
        return -(-self.percent * size // 100)

    def band(self, size: int) -> int:
        """Bands of sizes, each BAND times as wide as the one before; size >= 1."""
        k = int(np.log(size) / np.log(BAND))
        while self.band_start(k + 1) <= size:
            k += 1
        while self.band_start(k) > size:
            k -= 1
        return k

    @staticmethod
    def band_start(k: int) -> int:
        return int(np.ceil(BAND ** k))

    def segments(self, k: int) -> int:
        """H + 1 for the largest pair whose smaller set lies in band k."""
        largest = self.band_start(k + 1) - 1
        return self.differ(largest + 100 * largest // self.percent) + 1

    @staticmethod
    def with_deletions(m: int) -> int:
        """How many first segments have deletion neighbourhoods: all of few, else a thirty-second and two."""
        return m if m <= 8 else 2 + m // 32


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, words: int) -> None:
        self.words, self.memory = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        for t in set(tokens).difference(memory):
            memory[t] = xxhash.xxh3_64_intdigest(t)
        h = np.fromiter(map(memory.__getitem__, tokens), np.uint64, len(tokens))
        if not len(h):
            return h
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = (out ^ h[i:len(h) - k + 1 + i]) * ODD[i % 4] + np.uint64(i)
                out ^= out >> np.uint64(29)
        return np.unique(out)


def subset_entries(tokens: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of all entries of a set: the subsets of each band in reach and their one-deletion neighbours.

    The key of a subset is the sum of its mixed tokens and its place, so that a deletion is a difference.  place holds band
    << 26 | segment << 3 | neighbour << 2 | indexed << 1; sets index in their own band and probe in those below, too.
    """
    size = len(tokens)
    own, keys, places = measure.band(size), [], []
    with np.errstate(over="ignore"):
        mixed = (tokens ^ (tokens >> np.uint64(31))) * ODD[1]
        mixed ^= mixed >> np.uint64(30)
        for k in range(measure.band(max(1, measure.smallest(size))), own + 1):
            m = measure.segments(k)
            segment = ((tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # ascending, as the tokens are
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
            ends = np.searchsorted(segment, np.arange(m + 1))
            whole = sums[ends[1:]] - sums[ends[:-1]] + (np.arange(m, dtype=np.uint64) + np.uint64(k + 1) * ODD[2]) * ODD[0]
            near = ends[min(m, measure.with_deletions(m))]
            part = segment[:near]
            keys += [whole, whole[part] - mixed[:near]]
            base = (k << 26) | (2 if k == own else 0)
            places += [(np.arange(m) << 3) + base, (part << 3) + base + 4]
    return np.concatenate(keys), np.concatenate(places).astype(np.uint32)


def _deal(keys: np.ndarray, sets: np.ndarray, places: np.ndarray, buckets: int, turn: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, passes, entries) of gathered entries: dealt by key; what is common already passes to buckets in turn."""
    order = np.argsort(keys, kind="stable")
    keys, sets, places = keys[order], sets[order], places[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    hot = np.repeat(sizes >= HOT, sizes)
    first = np.zeros(len(keys), bool)
    first[starts] = True
    places = places | (hot & first).astype(np.uint32)  # bit 0: known to be common
    bucket = (mixed_keys(keys) % np.uint64(buckets)).astype(np.int64)
    passing = hot & ~first
    for passes, pick in ((0, ~passing), (1, passing)):
        k, s, p = keys[pick], sets[pick], places[pick]
        if not len(k):
            continue
        to = bucket[pick] if not passes else (np.arange(len(k)) // 4096 + turn) % buckets
        order = np.argsort(to, kind="stable")
        k, s, p, to = k[order], s[order], p[order], to[order]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        for lo, hi in zip(cuts, [*cuts[1:], len(to)], strict=True):
            yield int(to[lo]), passes, k[lo:hi].tobytes() + s[lo:hi].tobytes() + p[lo:hi].tobytes()


def mixed_keys(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys ^ (keys >> np.uint64(33))) * ODD[3] >> np.uint64(16)


DEALT = "bucket long, passes int, entries binary, doc_id long, n long, a long, code long"
FOUND = "doc_id long, n long, a long, code long, key long, place long"


def entries_and_sets(docs: DataFrame, measure: Measure) -> DataFrame:
    """One pass over the texts: a row (doc_id, n, a, code) per document (a: hash of its set, null if empty; code: hash of
    the row) and a row (a, key, place) per entry whose key another set has, too.

    Entries travel as packed arrays, dealt by key; a bucket counts them and keeps the shared ones."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("code", F.xxhash64("doc_id", "text"))
    amount = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    buckets = max(8, -(-amount // BUCKET_BYTES))
    types = {"bucket": pa.int64(), "passes": pa.int32(), "entries": pa.binary(), "doc_id": pa.int64(), "n": pa.int64(), "a": pa.int64(), "code": pa.int64()}

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in types.items()], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(measure.words)
        keys, sets, places, seen, held, turn = [], [], [], set(), 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sizes, ids = [], []
                for text in part.column(1):
                    tokens = shingles(text.as_py())
                    sizes.append(len(tokens))
                    a = xxhash.xxh3_64_intdigest(tokens.tobytes()) if len(tokens) else None
                    ids.append(a if a is None else a - ((a >> 63) << 64))
                    if a is not None and a not in seen:
                        seen.add(a)
                        k, p = subset_entries(tokens, measure)
                        keys.append(k)
                        places.append(p)
                        sets.append(np.full(len(k), a, np.uint64))
                        held += len(k)
                turn += 1
                yield rows(bucket=[(turn + i) % buckets for i in range(part.num_rows)], doc_id=part.column(0), n=sizes, a=ids, code=part.column(2))
                if held > FLUSH:
                    yield from flush(keys, sets, places, turn)
                    keys, sets, places, seen, held = [], [], [], set(), 0
        if held:
            yield from flush(keys, sets, places, turn)

    def flush(keys, sets, places, turn) -> Iterator[pa.RecordBatch]:
        dealt = list(_deal(np.concatenate(keys), np.concatenate(sets), np.concatenate(places), buckets, turn))
        for lo in range(0, len(dealt), 256):
            bucket, passes, entries = zip(*dealt[lo:lo + 256], strict=True)
            yield rows(bucket=bucket, passes=passes, entries=entries)

    def count(table: pa.Table) -> pa.Table:
        blobs, passed, entries = [], [], table.column("entries")
        for passes, blob in zip(table.column("passes").to_pylist(), entries, strict=True):
            if passes is not None:
                (passed if passes else blobs).append(memoryview(blob.as_buffer()))
        k, s, p = _unpacked(blobs)
        order = np.lexsort((s, k))
        k, s, p = k[order], s[order], p[order]
        same_key = k[1:] == k[:-1]
        fresh = np.concatenate([[True], ~same_key | (s[1:] != s[:-1]) | (p[1:] >> 1 != p[:-1] >> 1)]) if len(k) else np.zeros(0, bool)
        group = np.cumsum(np.concatenate([[True], ~same_key])) - 1 if len(k) else np.zeros(0, np.int64)
        shared = np.zeros(len(k), bool)
        if len(k):
            other = np.concatenate([[False], same_key & (s[1:] != s[:-1])]) | (p & 1).astype(bool)
            shared = (np.bincount(group, weights=other) > 0)[group] & fresh
        k2, s2, p2 = _unpacked(passed)
        k, s, p = (np.concatenate(x) for x in ((k[shared], k2), (s[shared], s2), (p[shared], p2)))
        is_doc = table.filter(pa.compute.is_null(table.column("passes")))
        docs_part = pa.table({c: is_doc.column(c) for c in ("doc_id", "n", "a", "code")} | {c: pa.nulls(is_doc.num_rows, pa.int64()) for c in ("key", "place")})
        none = pa.nulls(len(k), pa.int64())
        found = pa.table({"doc_id": none, "n": none, "a": s.view(np.int64), "code": none, "key": k.view(np.int64), "place": (p & ~np.uint32(1)).astype(np.int64)})
        return pa.concat_tables([docs_part, found])

    return texts.mapInArrow(run, DEALT).groupBy("bucket").applyInArrow(count, FOUND)


def _unpacked(blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [[], [], []]
    for b in blobs:
        n = len(b) // 20
        parts[0].append(np.frombuffer(b, np.uint64, n))
        parts[1].append(np.frombuffer(b, np.uint64, n, 8 * n))
        parts[2].append(np.frombuffer(b, np.uint32, n, 16 * n))
    return tuple(np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, (np.uint64, np.uint64, np.uint32), strict=True))


def levels(segment: np.ndarray, near: np.ndarray, subsets: np.ndarray, neighbours: np.ndarray, m: int, need: int) -> np.ndarray:
    """Levels of all m segments that sum to ``need`` at least, at small cost.

    The entries of a set are given by segment, whether a neighbour, and how many other sets index the key as a subset
    and as a neighbour.  Level 1 costs the sets with an equal subset; level 2 (in the first segments) those with a
    neighbour, too.  What costs nothing is taken first, then steps by their cost."""
    d = Measure.with_deletions(m)
    first = np.zeros(m, np.int64)
    second = np.zeros(m, np.int64)
    np.add.at(first, segment[~near], subsets[~near])
    np.add.at(second, segment[~near], neighbours[~near])
    np.add.at(second, segment[near], subsets[near])
    cost = np.concatenate([first, np.maximum(second[:d], first[:d])])  # a second step never comes before its first
    order = np.argsort(cost, kind="stable")[:need]
    return np.bincount(np.where(order < m, order, order - m), minlength=m)


def _members(found: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """Entries with the level at which their set probes: (key, a, n, near, indexed, level, weight, k); weight is the number
    of entries that the set shares, the more the nearer it is to the middle of its copies."""
    entries = found.filter("key IS NOT NULL").select("key", "a", (F.shiftright("place", 26)).alias("k"), (F.shiftright("place", 3).bitwiseAND(F.lit((1 << 23) - 1))).alias("i"),
                                                     (F.col("place").bitwiseAND(F.lit(4)) > 0).alias("near"), (F.col("place").bitwiseAND(F.lit(2)) > 0).alias("indexed"))
    counts = entries.filter("indexed").groupBy("key").agg(F.sum((~F.col("near")).cast("long")).alias("subsets"), F.sum(F.col("near").cast("long")).alias("neighbours"))
    costs = (entries.join(counts, "key")
             .withColumn("subsets", F.col("subsets") - (F.col("indexed") & ~F.col("near")).cast("long")))
    fields = ["key", "i", "near", "indexed", "subsets", "neighbours"]
    lists = costs.groupBy("a", "k").agg(F.collect_list(F.struct(*fields)).alias("e")).join(classes.select("a", "n"), "a").select("a", "n", "k", *[F.col(f"e.{c}").alias(c) for c in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "a", "n", "near", "indexed", "level", "weight", "k"]

        def gathered(out: list[list[np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.bool_() if j in (3, 4) else pa.int64()) for j, x in enumerate(out)], names=names)

        for batch in batches:
            out, held = [[] for _ in names], 0
            c = {name: batch.column(j) for j, name in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                a, n, k = (c[x][row].as_py() for x in ("a", "n", "k"))
                key, i, subsets, neighbours = (c[x][row].values.to_numpy(zero_copy_only=False) for x in ("key", "i", "subsets", "neighbours"))
                near, indexed = (c[x][row].values.to_numpy(zero_copy_only=False).astype(bool) for x in ("near", "indexed"))
                need = measure.differ(n + min(n, measure.band_start(k + 1) - 1)) + 1
                level = levels(i, near, subsets, neighbours, measure.segments(k), need)[i]
                level = np.where(near, np.where(level == 2, 2, 0), level)
                keep = indexed | (level > 0) | ~near  # all subsets stay: their number in common bounds a pair's difference
                size = int(keep.sum())
                weight = int(np.minimum(subsets, 1 << 32).sum())
                for to, x in zip(out, (key[keep], np.full(size, a), np.full(size, n), near[keep], indexed[keep], level[keep], np.full(size, weight), np.full(size, k)), strict=True):
                    to.append(x)
                held += size
                if held > 100_000:
                    yield gathered(out)
                    out, held = [[] for _ in names], 0
            if held:
                yield gathered(out)

    return lists.mapInArrow(run, "key long, a long, n long, near boolean, indexed boolean, level long, weight long, k long")


def _candidate_sets(docs: DataFrame, wanted: DataFrame, measure: Measure) -> DataFrame:
    """(a, tokens) of the wanted sets (a, code), made anew from their texts: only sets of candidates travel.

    A bit table of fixed size picks the rows to shingle; what it lets through besides is dropped by the join."""
    word = F.pmod(F.shiftright("code", 6), F.lit(FILTER_BITS // 64))
    bits = wanted.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(code, 64) AS INT))")).alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in bits.toLocalIterator():
        table[r["w"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bits = Shingler(measure.words), shared.value
        for batch in batches:
            code = batch.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((bits[(code >> 6) % (FILTER_BITS // 64)] >> (code & 63)) & 1)
            for lo in range(0, len(hit), 512):
                ids, sets = [], []
                for j in hit[lo:lo + 512]:
                    tokens = shingles(batch.column(0)[int(j)].as_py())
                    if len(tokens):
                        ids.append(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))
                        sets.append(tokens.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["a", "tokens"])

    sets = texts.mapInArrow(run, "a long, tokens binary")
    return sets.join(wanted.select("a"), "a", "left_semi").dropDuplicates(["a"])


def _verified(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """Pairs (p, q) with ``linked``: the sizes of the intersection and union of their full sets decide."""
    left = sets.select(F.col("a").alias("p"), F.col("tokens").alias("x"))
    right = sets.select(F.col("a").alias("q"), F.col("tokens").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                linked.append(measure.similar(len(x), len(y), int((both[1:] == both[:-1]).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["p", "q", "linked"])

    return pairs.join(right, "q").join(left, "p").select("p", "q", "x", "y").mapInArrow(run, "p long, q long, linked boolean")


def links(docs: DataFrame, measure: Measure = Measure()) -> tuple[DataFrame, DataFrame]:
    """(sets, edges): a stored row (doc_id, n, a, code) per document, and verified links (p, q) between sets that join
    all similar sets into their components."""
    spark = docs.sparkSession
    shared_folder(spark)
    found = stored(entries_and_sets(docs, measure))
    release(spark)  # the dealt entries, by far the largest shuffle
    sets = found.filter("key IS NULL").select("doc_id", "n", "a", "code")
    classes = sets.filter("a IS NOT NULL").groupBy("a").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "code"))["code"].alias("code"))
    members = stored(_members(found, classes, measure))
    release(spark)
    hubs = (members.groupBy("key").agg(F.max(F.struct("weight", "a", "n")).alias("hub"), F.max("level").alias("level"), F.min("a").alias("low"), F.max("a").alias("high"))
            .filter("level > 0 AND low <> high").select("key", F.col("hub.a").alias("hub"), F.col("hub.n").alias("hub_n")))
    starred = members.join(hubs, "key")
    fits = lambda x, y: F.expr(f"100L * least({x}, {y}) >= {measure.percent}L * greatest({x}, {y})")
    pair = lambda x, y: [F.least(x, y).alias("p"), F.greatest(x, y).alias("q")]
    stars = starred.filter((F.col("a") != F.col("hub")) & fits("n", "hub_n")).select(*pair("a", "hub")).distinct()
    stars = stored(stars)
    release(spark)
    # All sets that can still be compared: those of subsets with a probe.
    wanted = starred.select("a").distinct().join(classes, "a").select("a", "code")
    tokens = stored(_candidate_sets(docs, wanted, measure))
    release(spark)
    first = stored(_verified(stars, tokens, measure))
    release(spark)
    # Sets that the stars have joined need no further comparison with each other.
    roots = stored(components(first.filter("linked").select("p", "q")))
    root_of = lambda name: roots.select(F.col("a").alias(name), F.col("root").alias(f"{name}_root"))
    state = (starred.join(root_of("a").withColumnRenamed("a_root", "root"), "a", "left").join(root_of("hub"), "hub", "left")
             .withColumn("root", F.coalesce("root", "a")).withColumn("out", F.col("root") != F.coalesce("hub_root", "hub"))
             .select("key", "k", "a", "n", "near", "indexed", "level", "root", "out", "hub"))
    open_keys = state.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.max("out").alias("any_out")).filter("any_out").select("key", "many")
    state = stored(state.join(open_keys, "key"))
    release(spark)
    few, much = state.filter(F.col("many") <= FEW), state.filter(F.col("many") > FEW)
    outside = few.filter("out").select("key", *[F.col(c).alias(f"o_{c}") for c in ("a", "n", "near", "indexed", "level", "root")])
    probes = ("({p}level > 0 AND {q}indexed AND {q}n <= {p}n AND ((NOT {p}near AND NOT {q}near) OR ({p}level = 2 AND {p}near <> {q}near)))")
    meets = F.expr(probes.format(p="o_", q="") + " OR " + probes.format(p="", q="o_"))
    rest = outside.join(few, "key").filter((F.col("root") != F.col("o_root")) & (F.col("a") != F.col("hub")) & fits("n", "o_n") & meets).select(*pair("a", "o_a"))
    rest = stored(rest.distinct().join(first.select("p", "q"), ["p", "q"], "left_anti"))
    release(spark)
    second = _verified(rest, tokens, measure).filter("linked").select("p", "q")
    third = _block_links(much, tokens, measure)
    return sets, stored(first.filter("linked").select("p", "q").unionByName(second).unionByName(third).distinct())


def _block_links(state: DataFrame, tokens: DataFrame, measure: Measure) -> DataFrame:
    """Verified links (p, q) inside common subsets of many sets, as few as join what all links there join.

    Members that the star left out (``out``) are compared with all others.  Both kinds are cut into blocks by hash, bounded
    in rows and in bytes; a task holds two blocks with their full sets, counts the tokens in common of all their pairs as
    products of 0-1 matrices, and returns a spanning forest of the links it finds, so never more rows than it read."""
    members = state.groupBy("key", "a", "root").agg(F.max("out").alias("out")).join(tokens, "a")
    cut = lambda out: F.greatest(F.ceil(F.sum(out.cast("long")) / BLOCK), F.ceil(F.sum(F.when(out, F.octet_length("tokens")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    cuts = members.groupBy("key").agg(cut(F.col("out")).alias("outs"), cut(~F.col("out")).alias("others"))
    place = lambda many: F.pmod(F.xxhash64("a", F.lit(1)), F.greatest(many, F.lit(1))).cast("int")
    rows = (members.join(cuts, "key").withColumn("block", F.when(F.col("out"), place(F.col("outs"))).otherwise(F.col("outs") + place(F.col("others"))))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("outs") + F.when(F.col("out"), F.col("others")).otherwise(0) - 1)))
            .select("key", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "a", "root", "tokens"))

    def compare(table: pa.Table) -> pa.Table:
        a, root, block = (table.column(c).to_numpy() for c in ("a", "root", "block"))
        left = np.flatnonzero(block == table.column("x")[0].as_py())
        right = np.flatnonzero(block == table.column("y")[0].as_py())
        if not len(left) or not len(right):
            return pa.table({"p": pa.array([], pa.int64()), "q": pa.array([], pa.int64())})
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("tokens")]
        n = np.array([len(v) for v in sets])
        row, codes = np.repeat(np.arange(len(a)), n), np.concatenate(sets)
        order = np.argsort(codes, kind="stable")
        row, codes = row[order], codes[order]
        fresh = np.concatenate([[True], codes[1:] != codes[:-1]])
        codes = np.cumsum(fresh) - 1
        shared = (np.bincount(codes) > 1)[codes]  # tokens of one set only are in no intersection
        row, codes = row[shared], codes[shared]
        codes = np.unique(codes, return_inverse=True)[1]
        common = np.zeros((len(left), len(right)), np.float32)
        width = 1024
        ends = np.searchsorted(codes, np.arange(0, (codes[-1] if len(codes) else 0) + 1 + width, width))
        for j in range(len(ends) - 1):
            has = np.zeros((len(a), width), np.float32)
            has[row[ends[j]:ends[j + 1]], codes[ends[j]:ends[j + 1]] - j * width] = 1
            common += has[left] @ has[right].T
        both = common.astype(np.int64)
        union = n[left][:, None] + n[right][None, :] - both
        hit = np.argwhere((100 * both >= measure.percent * union) & (root[left][:, None] != root[right][None, :]))
        ids, known = np.unique(root, return_inverse=True)
        over = np.arange(len(ids))  # union-find over what is joined already

        def top(u: int) -> int:
            while over[u] != u:
                over[u] = over[over[u]]
                u = over[u]
            return u

        p, q = [], []
        for i, j in zip(left[hit[:, 0]].tolist(), right[hit[:, 1]].tolist(), strict=True):
            u, v = top(known[i]), top(known[j])
            if u != v:
                over[max(u, v)] = min(u, v)
                p.append(min(a[i], a[j]))
                q.append(max(a[i], a[j]))
        return pa.table({"p": pa.array(p, pa.int64()), "q": pa.array(q, pa.int64())})

    return rows.groupBy("key", "x", "y").applyInArrow(compare, "p long, q long")


def components(edges: DataFrame) -> DataFrame:
    """(a, root) of all nodes with an edge: the smallest node that they reach.

    Edges are turned in rounds: each node hands the smallest node it knows to its larger neighbours, then to its smaller
    ones, until nothing changes; the number of rounds grows as the logarithm of a component's width."""
    now, before = stored(edges.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).filter("u <> v").distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct())
    # Each node now points at its root.
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("a"), "root")


def classified(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document."""
    sets, edges = links(docs, measure)
    roots = components(edges)
    own = sets.filter("a IS NOT NULL").groupBy("a").agg(F.min("doc_id").alias("own")).join(roots, "a", "left").withColumn("root", F.coalesce("root", "a"))
    names = own.join(own.groupBy("root").agg(F.min("own").alias("component_id")), "root").select("a", "component_id")
    # Documents without words have no set: they meet no row here and stay alone.
    out = sets.join(names, "a", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_group(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """The documents with one of each component left: that with the component's id, or of repeated rows the first by text.
    Documents without words stay."""
    docs, names = apart(docs, ["doc_id", "text"])
    sets, edges = links(docs, measure)
    roots = components(edges)
    rooted = sets.filter("a IS NOT NULL").join(roots, "a", "left").withColumn("root", F.coalesce("root", "a"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "code")).alias("best"))
    picks = best.select(F.col("best.code").alias("_code")).distinct().withColumn("_pick", F.lit(True))
    coded = docs.withColumn("_code", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    blank = F.length(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")) == 0
    kept = coded.filter(~blank).join(picks, "_code", "left_semi").dropDuplicates(["_code"])
    return kept.unionByName(coded.filter(blank)).select(*together(names))
