"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook (k-means on a bounded sample); a vector lies in the
cell (i, j) of its two codes.  A query visits cells in the order of the summed squared distances of their centroids,
found with a heap over pairs, until the cells hold the share of all rows that reached the wanted recall when the index
was fitted; the rows of visited cells are ranked by their exact distance.

Cells are gathered into regions of about ``region_rows`` rows, and cells beyond that are cut into blocks, so that a task
ranks one block of queries against one bounded block of rows: a frequent vector does not make a large task.  Each block
returns its best k per query, which are merged per query.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite numbers take
no part, nor do rows without an id; of rows that share an id the smallest vector counts; ties go to the smaller id; fewer
candidates than k are all returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Index:
    """Two codebooks, the share of all rows to visit, and how cells are gathered: cell -> (rows, region, blocks)."""
    left: np.ndarray
    right: np.ndarray
    share: float
    rows: np.ndarray
    region: np.ndarray
    blocks: np.ndarray


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(good).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def codebook(x: np.ndarray, size: int, turns: int = 10) -> np.ndarray:
    """k-means from evenly spread rows; an emptied centroid moves to the row that lies farthest from its own."""
    centers = x[np.linspace(0, len(x) - 1, size).astype(int)].copy()
    for _ in range(turns):
        d = squared(x, centers)
        code = d.argmin(1)
        count = np.bincount(code, minlength=size)
        sums = np.zeros_like(centers)
        np.add.at(sums, code, x)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[d.min(1).argmax()])
    return centers


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def codes(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    half = left.shape[1]
    return squared(x[:, :half], left).argmin(1) * len(right) + squared(x[:, half:], right).argmin(1)


def visited(d_left: np.ndarray, d_right: np.ndarray, rows: np.ndarray, wanted: float) -> list[int]:
    """Cells in ascending order of summed distances until they hold ``wanted`` rows: the multi-sequence walk."""
    a, b = np.argsort(d_left, kind="stable"), np.argsort(d_right, kind="stable")
    heap, seen, out, got = [(d_left[a[0]] + d_right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if rows[cell]:
            out.append(cell)
            got += rows[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d_left[a[x]] + d_right[b[y]], x, y))
    return out


def share_to_visit(x: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, recall: float, tries: int) -> float:
    """The share of rows that a walk must hold to find ``recall`` of the true neighbours, measured inside the sample."""
    cell, half = codes(x, left, right), left.shape[1]
    rows = np.bincount(cell, minlength=len(left) * len(right))
    seen = []
    for q in np.linspace(0, len(x) - 1, min(tries, len(x))).astype(int):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argpartition(d, min(k, len(x) - 2))[:k] if len(x) > 2 else np.argsort(d)[:len(x) - 1]
        walk = visited(squared(x[q:q + 1, :half], left)[0], squared(x[q:q + 1, half:], right)[0], rows, len(x))
        before = dict(zip(walk, np.concatenate([[0], np.cumsum(rows[walk])[:-1]]), strict=True))
        seen += [(before[c] + 1) / len(x) for c in cell[near]]
    return float(np.quantile(seen, recall)) if seen else 1.0


def fit(rows: DataFrame, k: int = 10, recall: float = 0.96, sample_rows: int = 20_000, tries: int = 256, cell_rows: int = 64,
        most_codes: int = 64, region_rows: int = 8192) -> Index | None:
    """Fit on the ``sample_rows`` rows of smallest hash; every row is counted into the cells.  None for no rows."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    if not sample:
        return None
    x = np.array([r["v"] for r in sample])
    total = rows.count()
    half = max(1, x.shape[1] // 2)
    size = int(np.clip(round((total / cell_rows) ** 0.5), 1, min(most_codes, len(x))))
    left, right = codebook(x[:, :half], size), codebook(x[:, half:], size)
    share = share_to_visit(x, left, right, k, recall, tries)
    held = np.zeros(size * size, np.int64)
    for r in coded(rows, left, right).groupBy("cell").count().collect():  # at most most_codes ** 2
        held[r["cell"]] = r["count"]
    region, blocks, now, number = np.zeros(size * size, np.int64), np.ones(size * size, np.int64), 0, 0
    for cell in np.flatnonzero(held):
        if now and now + held[cell] > region_rows:
            number, now = number + 1, 0
        region[cell], now = number, now + held[cell]
    for number in np.unique(region[held > 0]):
        cells = np.flatnonzero((region == number) & (held > 0))
        blocks[cells] = -(-held[cells].sum() // (2 * region_rows))
    return Index(left, right, share, held, region, blocks)


def coded(rows: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(codes(np.stack(v.to_numpy()), left, right)) if len(v) else pd.Series([], dtype="int32")

    return rows.withColumn("cell", cell("v"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", query_block: int = 2048, **fitting) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k nearest rows found for each row where ``is_query`` (over vec_id)."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vec_id, vector)
    index = fit(rows, k, **fitting)
    if index is None:
        return spark.createDataFrame([], out)
    half, regions = index.left.shape[1], index.region
    wanted = max(index.share * index.rows.sum(), k + 1)  # k rows and the query's own
    queries = rows.filter(is_query)
    turns = max(1, -(-queries.count() // query_block))

    def walk(batches):
        for batch in batches:
            x = np.stack(batch["v"].to_numpy()) if len(batch) else np.zeros((0, 1))
            found = []
            for q, v, dl, dr in zip(batch["vec_id"], batch["v"], squared(x[:, :half], index.left), squared(x[:, half:], index.right), strict=True):
                cells = np.array(visited(dl, dr, index.rows, wanted), np.int64)
                for region in np.unique(regions[cells]):
                    inside = cells[regions[cells] == region]
                    found += [(int(region), block, q, v, inside) for block in range(int(index.blocks[inside].max()))]
            yield pd.DataFrame(found, columns=["region", "block", "query_id", "q", "cells"])

    asked = (queries.mapInPandas(walk, "region int, block int, query_id long, q array<double>, cells array<long>")
             .withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")))
    at = pd.DataFrame({"cell": np.arange(len(regions)), "region": regions, "blocks": index.blocks})[index.rows > 0]
    at = F.broadcast(spark.createDataFrame(at.astype("int32").to_numpy().tolist(), "cell int, region int, blocks int"))
    placed = (coded(rows, index.left, index.right).join(at, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
              .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).select("region", "block", "turn", "vec_id", "v", "cell"))

    def rank(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids, cell = np.stack(r["v"].to_numpy()), r["vec_id"].to_numpy(), r["cell"].to_numpy()
        parts = []
        for query_id, v, cells in zip(q["query_id"], q["q"], q["cells"], strict=True):
            near = np.flatnonzero(np.isin(cell, cells) & (ids != query_id))
            diff = x[near] - v
            score = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            if len(near) > k:  # all that tie with the k-th stay for the order by id
                few = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                near, score = near[few], score[few]
            best = np.lexsort((ids[near], score))[:k]
            parts.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(parts)

    keys = ["region", "block", "turn"]
    best = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    # k rows per query and block meet here: fold them to one sorted list per query.
    top = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
