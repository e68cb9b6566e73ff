"""Best-fit packing of tokenised documents into fixed-length sequences.

The packing is bulk-synchronous.  Documents and gaps are kept sorted by length; lengths are bounded by the capacity, so
equal ones are run-length coded: the state of a superstep is one count per length and one run per kind of open sequence,
whatever the number of documents.  A superstep takes the longest unplaced length and sweeps the gaps from its successor
(the smallest gap that holds it) upwards; where more documents want a gap than it has room, those of lowest rank get it
and the others go on to the next gap; gaps are updated and the next superstep begins.  This is sequential best fit
decreasing, exactly.  What grows with the data stays distributed: documents are counted by length, ranked within their
length by hash buckets, and find their sequence and offset by (length, rank) in the runs, whose number depends on the
capacity only.

Defined cases: a null or empty text is one document of the end token alone; repeated rows are packed one by one; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import buckets_for, map_rows, running_start, stored

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(vocabulary: str | None = None) -> Callable[[str], list[int]]:
    """Token ids of a text by the byte-level vocabulary file (default: the public byte_bpe_50k.json).

    Where the same vocabulary lies beside it as ranks, the faster library that reads those gives the same ids; a text
    with the special token's string goes to the first library, which alone knows it.  Kept per process.
    """
    import os

    import public_tokenizers
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        plain = Tokenizer.from_file(path)
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            _encoders[path] = lambda text: (plain.encode(text, add_special_tokens=False).ids if "<|endoftext|>" in text else fast.encode_ordinary(text))
        else:
            _encoders[path] = lambda text: plain.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def pieces_of(ids: list[int], capacity: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(piece, start, ids) of one document: whole, or cut so that only its first piece is shorter than the capacity."""
    data = np.array(ids, dtype="<u4")
    first = len(data) % capacity or min(len(data), capacity)
    for piece, end in enumerate(range(first, len(data) + 1, capacity)):
        start = max(0, end - capacity) if piece else 0
        yield piece, start, data[start:end]


def tokenised(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and the ids where asked for."""
    def make():
        encode = encoder(vocabulary)

        def row(doc_id, text):
            ids = encode(text or "")
            ids.append(end_id)
            return [(doc_id, piece, start, len(x), zlib.crc32(x.tobytes())) + ((x.tolist(),) if with_ids else ())
                    for piece, start, x in pieces_of(ids, capacity)]
        return row

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, PIECES + (", ids array<long>" if with_ids else ""))


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the documents of each length go: (length, first, count, per, sequence, offset).

    Rank r of a run (from ``first``, ``count`` of them) lies in sequence ``sequence + (r - first) // per`` at offset
    ``offset + (r - first) % per * length``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    order: list[int] = []  # the gaps that have runs, sorted
    runs, opened = [], 0

    def put(gap: int, first: int, many: int) -> None:
        if many and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            per = gap // length
            whole = min(many, left // per)
            if whole:
                runs.append((length, rank, whole * per, per, first, capacity - gap))
                put(gap - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if whole < many:
                if left:  # fewer than fill one more sequence
                    runs.append((length, rank, left, left, first + whole, capacity - gap))
                    put(gap - left * length, first + whole, 1)
                    whole, left = whole + 1, 0
                put(gap, first + whole, many - whole)
    return pd.DataFrame(runs, columns=["length", "first", "count", "per", "sequence", "offset"]).astype("int64")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, piece, start, length, ids_crc32)."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan_runs(counts, capacity)
    total = sum(counts.values())
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("start")]
    ranked = running_start(pieces, "length", order, F.lit(1).cast("long"), "rank", buckets_for(total))
    width = max(1, int(total).bit_length())
    runs = runs.sort_values(["length", "first"])
    keys = (runs["length"].to_numpy() << width) + runs["first"].to_numpy()
    table = runs[["first", "per", "sequence", "offset", "length"]].to_numpy()

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        first, per, sequence, offset, each = table[np.searchsorted(keys, (length.to_numpy(np.int64) << width) + rank.to_numpy(np.int64), side="right") - 1].T
        turn = rank.to_numpy(np.int64) - first
        return pd.DataFrame({"sequence_id": sequence + turn // per, "offset": offset + turn % per * each})

    return ranked.withColumn("_at", find("length", "rank")).select(*[c for c in pieces.columns], "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.  Texts are tokenised once; the narrow rows of the
    pieces are stored in the shared folder."""
    return place(stored(tokenised(docs, capacity, vocabulary, end_id)), capacity)


def sequences(placed_ids: DataFrame) -> DataFrame:
    """Packed sequences (sequence_id, ids) from placed pieces that carry their ids: at most one capacity of ids a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed_ids.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
