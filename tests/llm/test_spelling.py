"""Spelling variants against brute force, the acceptor and its composition against all pairs."""

import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by = collections.defaultdict(list)
    for a, b in itertools.combinations(sorted(words), 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            by[a].append(b)
            by[b].append(a)
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in by.items()}
    form = {w: best[w] if w in best and words[best[w]] >= 10 * n else None for w, n in words.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(by[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def got(docs):
    return sorted((tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert len(want) > 100 and got(docs) == want


@pytest.mark.parametrize("most_words", [2000, 1])
def test_crowded_words_in_any_partition(spark, monkeypatch, most_words):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (most_words,))
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = ["".join(rng.choice("abé") for _ in range(rng.choice([6, 7, 8, 9]))) for _ in range(40)]
        rows.append((rng.choice([None, i, i]), " ".join(w if rng.random() < 0.5 else w.upper() for w in words)))
    rows += [(100, "fundamental " * 2000), (101, "fundamentel " * 200 + "fundamintel " * 19), (102, "fundamentl fundamntl fundamntl " + "prefix" + "x" * 3000 + " prefix" + "x" * 3000 + " prefix" + "x" * 2999 + "y" + " prefix" + "x" * 2999 + "y"),
             (103, None), (104, ""), (105, "1234567 ÀÀÀÀÀÀÀ àààÀÀÀÀ ÀÀÀÀÀÀÀ àààÀÀÀÀ"), (106, "÷×÷×÷×÷ " * 3)]
    want = brute(rows)
    assert any(r[2] not in (r[0], r[1]) for r in want)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = ["word", "n", "m", "low", "high", "head", "tail", "_words"]
    assert got(docs.select("*", *[F.lit(1).alias(x) for x in names])) == want


def test_empty_tables_and_roots(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    assert got(spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")) == []
    chain = [(f"word{i}", f"word{i + 1}" if i < 9 else None, 10 ** i) for i in range(10)]
    frame = spark.createDataFrame(chain + [("other", None, 5)], "word string, form string, n long")
    roots = {r["word"]: r["root"] for r in spelling.with_roots(frame).collect()}
    assert roots == {f"word{i}": "word9" for i in range(10)} | {"other": "other"}
    texts = spark.createDataFrame([("word3",), ("free",), (None,)], "word string")
    assert {tuple(r) for r in spelling.normalised(texts, spelling.with_roots(frame)).collect()} == {("word3", "word9"), ("free", "free"), (None, None)}


def test_composition_accepts_each_pair_once():
    rng = random.Random(1)
    for _ in range(400):
        words = sorted({"".join(rng.choice("abc"[:rng.choice([2, 3])]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 40))})
        machine = spelling.Acceptor(words)
        pairs = [tuple(sorted(p)) for p in machine.one_edit(99)]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if near(words[i], words[j])}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("walk", "talk", "jump", "play") for b in ("", "ed", "er", "ing", "s"))
    machine = spelling.Acceptor(words)
    languages = [frozenset("".join(p) for p in _accepted(machine, q)) for q in range(len(machine.arcs))]
    assert len(set(languages)) == len(languages) and languages[machine.start] == frozenset(words)


def _accepted(machine, q):
    if machine.final[q]:
        yield ()
    for letter, to in machine.arcs[q].items():
        yield from ((letter, *rest) for rest in _accepted(machine, to))
