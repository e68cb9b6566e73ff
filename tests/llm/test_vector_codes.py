"""Vector codes against plain integer k-means, and Orchard's search against all distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Rows of (vec_id, vector, label) to (code, error, label_error) by row, and the codebooks' digest, in Python integers."""
    kept = sorted((i, [math.floor(256 * float(np.float32(x))) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    cut = lambda v: [tuple(v[j * len(v) // parts:(j + 1) * len(v) // parts]) for j in range(parts)]
    pieces = [cut(v) for _, v, _ in kept]
    books = [[p[j] for p in pieces[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda p: [min((far(x, e), k) for k, e in enumerate(books[j])) for j, x in enumerate(p)]
    for _ in range(rounds):
        codes = [assign(p) for p in pieces]
        for j in range(parts):
            for k in range(len(books[j])):
                mine = [p[j] for p, c in zip(pieces, codes) if c[j][1] == k]
                if mine:
                    books[j] = books[j][:k] + [tuple(sum(x) // len(mine) for x in zip(*mine))] + books[j][k + 1:]
    codes = [assign(p) for p in pieces]
    error = [sum(d for d, _ in c) for c in codes]
    of = lambda label: sum(e for e, (_, _, k) in zip(error, kept) if k == label)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in c), e, of(label), digest) for (i, _, label), c, e in zip(kept, codes, error))


def got(frame):
    return sorted(tuple(r) for r in vector_codes.digests(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("few", [200_000, 0])
def test_codes_equal_plain_kmeans(spark, monkeypatch, few):
    monkeypatch.setattr(vector_codes.label_errors, "__defaults__", ("label", "error", few))
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (5, 32))
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(0, 0.3, 32)], None if i % 7 == 0 else i % 3) for i in range(150)]
    rows += [(200, None, 1), (201, [1.0] * 31 + [None], 1), (202, [float("nan")] + [0.0] * 31, None), (203, [float("inf")] * 32, 1), (204, rows[3][1], 9), (205, rows[3][1], None), (7, [0.0] * 32, 0)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("code", F.lit(1))) == brute(rows)


def test_few_and_odd_rows(spark):
    rows = [(5, [0.5] * 16, None), (3, [-0.001] * 16, 1), (3, [-0.001] * 16, 1), (9, [2.0] * 16, 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    other = rows + [(1, [1.0] * 15, 1), (10, [1.0] * 32, 1), (11, [], 1)]
    assert got(spark.createDataFrame(other, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame(other[4:5], SCHEMA)) == [] and got(spark.createDataFrame([], SCHEMA)) == []
    wide = [(1, [3e38] * 16, None), (2, [-3e38] * 16, None), (None, [1.0] * 16, None)]
    out = vector_codes.digests(spark.createDataFrame(wide, SCHEMA)).collect()
    assert len(out) == 3 and all(r["error"] == 0 for r in out)


def test_search_is_exact_and_measures_few():
    rng = np.random.default_rng(7)
    for spread in (3, 400):
        entries = rng.integers(-spread, spread, (4, 64, 3))
        entries[:, 40] = entries[:, 2]
        books, rows = vector_codes.Codebooks.of(entries), rng.integers(-spread, spread, (500, 12))
        counts = []
        numbers, distances = books.nearest(rows, counts)
        all_ = ((rows.reshape(500, 4, 1, 3) - entries[None]) ** 2).sum(-1)
        assert (numbers == all_.argmin(2)).all() and (distances == all_.min(2)).all()
        assert counts[0] < 0.6 * all_.size


def test_columns_stay_and_codes_decode(spark):
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 32)], i) for i in range(40)], SCHEMA)
    frame = frame.select("*", F.lit(1).alias("_c"), F.lit(2).alias("_row"), F.lit(3).alias("a.b"), F.struct(F.array(F.lit("x")).alias("y")).alias("z"))
    books = vector_codes.fit(frame)
    out = vector_codes.encoded(frame, books)
    rows = {r["vec_id"]: r for r in out.collect()}
    assert out.columns == [c for c in frame.columns if c != "embedding"] + ["code", "error"] and len(rows) == 40
    assert rows[3]["a.b"] == 3 and rows[3]["z"]["y"] == ["x"] and rows[3]["label"] == 3
    back = vector_codes.decoded(np.array([rows[i]["code"] for i in range(40)]), books)
    for r in frame.collect():
        gap = np.floor(np.array(r["embedding"]) * 256) - back[r["vec_id"]] * 256
        assert (gap ** 2).sum() == pytest.approx(rows[r["vec_id"]]["error"])
    with pytest.raises(ValueError):
        vector_codes.encoded(frame.withColumn("error", F.lit(0)), books)
