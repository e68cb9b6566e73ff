"""Line deduplication against brute force on odd rows, with its plan and its clashing column names."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = "This line is long enough, and shared"


def brute(rows, min_chars=20, min_documents=3):
    """Rows of (doc_id, text) to rows of (doc_id, n_lines, n_dropped, kept text)."""
    key = lambda line: line.strip(SPACES).translate(LOWER)
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (len(holders[key(x)]) >= min_documents and i != max(holders[key(x)]))]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def same(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in line_dedup.digests(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    want = brute(rows)
    assert sorted(got, key=repr) == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want), key=repr)
    texts = [tuple(r) for r in line_dedup.deduplicated(docs).collect()]
    assert sorted(texts, key=repr) == sorted(((i, t) for i, _, _, t in want), key=repr)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, LONG), (5, f"  {LONG.upper()}\t\nrest"), (6, f"a\n{LONG}\n{LONG} \nb\r\n"), (7, "x" * 19), (8, "x" * 19), (9, "x" * 19),
            (10, "É" * 20), (11, "É" * 20), (12, "É" * 20 + "\n" + "é" * 20), (13, "only two documents hold this"), (14, "only two documents hold this"),
            (None, LONG), (None, f"{LONG}\nno document"), (15, "the same document twice, not thrice"), (15, "the same document twice, not thrice"), (16, "the same document twice, not thrice"),
            (17, f"{LONG}\n" * 200 + "end"), (18, f"{LONG}\n" * 200 + "end"), (18, f"{LONG}\n" * 200 + "end"), (4, LONG), (19, f"\x0b{LONG}\x0c\n {LONG}")]
    same(spark, rows)


def test_random_texts(spark):
    rng = random.Random(3)
    pool = [f"A shared line number {i:03d} of the pool" for i in range(40)] + ["short", "", "   "]
    rows = [(rng.choice([None, *range(30)]), "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {rng.random()} that stands alone" for _ in range(rng.choice([1, 3, 70, 300])))) for _ in range(60)]
    same(spark, rows)


def test_bitmaps_leave_full_words_out(spark):
    gone = "\n".join(LONG if i in (3, 200, 640) else f"line {i}" for i in range(1000))
    docs = spark.createDataFrame([(1, gone), (2, LONG), (3, LONG)], "doc_id long, text string")
    maps = {r["doc"]: [tuple(x) for x in r["keep"]] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert maps == {1: [(0, ~(1 << 3)), (3, ~(1 << 8)), (10, ~1)], 2: [(0, ~1)]}


def test_columns_and_empty_tables(spark):
    names = ["doc", "t1", "t2", "h1", "h2", "slot", "pos", "keep", "bits", "row", "_last", "_held", "word", "line", "key", "n", "top", "a", "b"]
    docs = spark.createDataFrame([(i, LONG) for i in range(4)], "doc_id long, text string").select("*", *[F.lit(k).alias(x) for k, x in enumerate(names)], F.lit(1).alias("a.b"))
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(i, LONG if i == 3 else "", *range(len(names)), 1) for i in range(4)]
    assert line_dedup.digests(docs).count() == 4
    assert line_dedup.digests(docs.limit(0)).count() == 0 and line_dedup.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("step", ["first_occurrences", "digests"])
def test_plan_is_native(spark, step):
    docs = spark.createDataFrame([(i, LONG) for i in range(4)], "doc_id long, text string")
    frame = line_dedup.digests(docs) if step == "digests" else line_dedup.first_occurrences(line_dedup.slotted(line_dedup.line_hashes(docs)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
    if step == "first_occurrences":
        assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and plan.count("Sort [") == 1
