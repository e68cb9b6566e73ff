"""Product codes of vectors: integer k-means codebooks per part of the vector, entries found by Orchard's search.

Components become floor(256 * x); a vector is cut into equal consecutive parts, and every part is coded by the number of
the nearest entry of its position's codebook (squared Euclidean distance, ties to the lower number).

Orchard's search: every entry keeps all entries of its codebook sorted by their distance to it.  A search starts at any
entry, walks its list, and whenever it meets an entry nearer to the part, goes on with that entry's list.  Entries it has
measured are marked and not measured again.  Once an entry of the list lies beyond twice the part's distance to the
current entry, no later one can be nearer, and the search ends.  Distances are squared integers, so this is exact: an entry
at the same distance lies within the bound and wins by its lower number.  ``nearest`` runs the searches of a batch in step.

The codebooks (entries x components) are the only table that the tasks get and the only one that comes back, as one sum per
entry and task: their size does not depend on the rows.  The sums are integers, so codes do not depend on the partitions.

Defined cases: vectors that are null or hold a null or non-finite component are left out, and so are vectors of another
length than the kept one with the smallest id (fitted codebooks: than theirs) and lengths that the parts do not divide;
components saturate at a bound that keeps part distances within 64 bits (over two million for parts of four), total errors at the largest long; null ids
come last; equal ids are separate rows, ordered by their components; fewer rows than entries give smaller codebooks; an
empty table gives no rows; other columns are kept as they are, and a column named code or error is an error of the caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that one step of the lock-step search holds (times parts and entries: the marks).
STEP_ROWS = 4096
#: Labels whose sums may be broadcast (two longs each); more are joined by a salted key.
FEW_LABELS = 200_000
MOST = (1 << 63) - 1


def bound_of(width: int) -> int:
    """Components saturate here, so that the squared distance of a part of this width fits 62 bits."""
    return 1 << max(1, (62 - max(1, width - 1).bit_length()) // 2 - 1)


def integers(df: DataFrame, vector: str, length: int | None, parts: int, name: str) -> DataFrame:
    """Rows with a usable vector, its integer components added as ``name``."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(v) > 0) & (F.size(v) % parts == 0)
    if length is not None:
        usable = usable & (F.size(v) == length)
    most = bound_of((length or parts) // parts)
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-most))), F.lit(float(most)))).cast("long"))
    return df.filter(F.coalesce(usable, F.lit(False))).withColumn(name, whole)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, number]`` holds the components of an entry; ``near`` and ``far`` are the sorted lists of Orchard's search."""
    entries: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Codebooks:
        gaps = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(-1)
        near = np.argsort(gaps, axis=2, kind="stable")
        return Codebooks(entries, near, np.take_along_axis(gaps, near, axis=2))

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray, measured: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of the nearest entries, both (rows, parts); ``measured`` counts the distances taken."""
        parts, size, width = self.entries.shape
        rows = len(vectors)
        points = vectors.reshape(rows * parts, width)
        part = np.tile(np.arange(parts), rows)
        at = np.zeros(rows * parts, np.int64)
        best = ((points - self.entries[part, at]) ** 2).sum(1)
        marked = np.zeros((rows * parts, size), bool)
        marked[:, 0] = True
        place = np.zeros(rows * parts, np.int64)
        open_ = np.arange(rows * parts)
        count = len(open_)
        while len(open_):
            p, c, i = part[open_], at[open_], place[open_]
            # Distances are squared: twice the distance is four times its square (halved twice here, which cannot overflow).
            inside = (self.far[p, c, i] + 3) // 4 <= best[open_]
            open_, p, c, i = open_[inside], p[inside], c[inside], i[inside]
            other = self.near[p, c, i]
            fresh = ~marked[open_, other]
            look, e = open_[fresh], other[fresh]
            d = ((points[look] - self.entries[part[look], e]) ** 2).sum(1)
            count += len(look)
            marked[look, e] = True
            better = (d < best[look]) | ((d == best[look]) & (e < at[look]))
            place[open_] = i + 1
            moved = look[better]
            at[moved], best[moved], place[moved] = e[better], d[better], 0
            open_ = open_[place[open_] < size]
        if measured is not None:
            measured.append(count)
        return at.reshape(rows, parts), best.reshape(rows, parts)


def steps(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """The integer vectors of a batch, STEP_ROWS at a time, with the number of their first row."""
    for at in range(0, batch.num_rows, STEP_ROWS):
        piece = batch.column(name).slice(at, STEP_ROWS)
        yield at, piece.flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1)


def seeds(df: DataFrame, vec_id: str, vector: str, parts: int, entries: int) -> Codebooks | None:
    """Codebooks of the parts of the first vectors by id (None without any)."""
    columns = df.select(F.col(vec_id).alias("i"), F.col(vector).alias("v"))
    first = integers(columns, "v", None, parts, "c").orderBy(F.asc_nulls_last("i"), "c").limit(1).collect()
    if not first:
        return None
    length = len(first[0]["c"])
    rows = integers(columns, "v", length, parts, "c").orderBy(F.asc_nulls_last("i"), "c").limit(entries).collect()
    table = np.array([r["c"] for r in rows], np.int64).reshape(len(rows), parts, length // parts)
    return Codebooks.of(table.transpose(1, 0, 2).copy())


def moved(df: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """One round: assign all parts, then move each entry to the floor of its parts' mean (unused entries stay)."""
    parts, size, width = books.entries.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * size, np.int64), np.zeros((parts * size, width), np.int64)
        for vectors in (v for batch in batches for _, v in steps(batch, "c")):
            where = (books.nearest(vectors)[0] + np.arange(parts) * size).ravel()
            np.add.at(counts, where, 1)
            np.add.at(sums, where, vectors.reshape(-1, width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["entry", "n", "total"])

    rows = integers(df, vector, books.length, parts, "c").select("c").mapInArrow(add_up, "entry long, n long, total array<long>")
    # At most parts x entries rows, whatever the table.
    totals = rows.groupBy("entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"),
                                       *[F.sum(F.get("total", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)])
    entries = books.entries.reshape(parts * size, width).copy()
    for r in totals.collect():
        entries[r["entry"]] = [int(r[f"s{k}"]) // int(r["n"]) for k in range(width)]
    return Codebooks.of(entries.reshape(parts, size, width))


def fit(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all rows (None if no row can be coded)."""
    books = seeds(df, vec_id, vector, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(df, vector, books)
    return books


def encoded(df: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """Usable rows without the vector, with code (array of entry numbers) and error (squared distance) added."""
    others = [c for c in df.columns if c != vector]
    parts = books.entries.shape[0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in steps(batch, "_c"):
                numbers, distances = books.nearest(vectors)
                total = distances.sum(1, dtype=object) if distances.max(initial=0) > MOST // parts else distances.sum(1)
                code = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * parts), pa.array(numbers.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(at, len(vectors)), code, pa.array([min(int(x), MOST) for x in total], pa.int64())], ["_row", "code", "error"])

    clash = {"code", "error"} & set(others)
    if clash:
        raise ValueError(f"input columns {sorted(clash)} would be overwritten")
    whole = F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")
    rows = integers(df.select(whole, F.col(vector).alias("_v")), "_v", books.length, parts, "_c").select("_row", "_c")
    schema = T.StructType([rows.schema["_row"], T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    out = rows.mapInArrow(assign, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in others], "code", "error")


def decoded(codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """Vectors (in the units of the input) that codes of shape (rows, parts) stand for."""
    parts = books.entries.shape[0]
    return books.entries[np.arange(parts), codes].reshape(len(codes), -1) / SCALE


def hexadecimal(code: Column) -> Column:
    """Two hex digits per part."""
    return F.array_join(F.transform(code, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")


def label_errors(rows: DataFrame, label: str = "label", error: str = "error", few: int = FEW_LABELS) -> DataFrame:
    """Add label_error, the sum over rows of the same label (nulls are one label)."""
    capped = F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = stored(rows.groupBy(F.col(label).alias("_l")).agg(capped.alias("label_error")))
    n = sums.count()
    if n <= few:
        return rows.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    # Rows of one label are dealt over as many salts as there may be rows of it in a task.
    salts = 64
    dealt = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_r", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return salted.join(dealt, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_r") == F.col("_s"))).drop("_l", "_r", "_s")


def digests(df: DataFrame) -> DataFrame:
    """Per coded row of ``df`` (vec_id, embedding, label): code as text, error, label_error and the codebooks' SHA-256."""
    rows = df.select("vec_id", "embedding", "label")
    books = fit(rows)
    if books is None:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                                    F.lit("").alias("codebooks_sha256"))
    out = label_errors(stored(encoded(rows, books).withColumn("code", hexadecimal(F.col("code")))))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
