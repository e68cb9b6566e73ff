"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of itself and of its character n-grams (hashed into a fixed table), so that a
misspelling that was never seen shares most vectors with the word it comes from.  Vectors are averaged over a window of
words and go to a linear softmax; a text scores as its most toxic window, so that a long text does not dilute an insult.
The window moves by one word, so that a verdict does not depend on where in the text an insult stands.
Embeddings and softmax are trained together: first on averages over whole texts, then on the windows that decide.

The model is fitted on a bounded sample of labelled rows (``sample_rows`` per class, whole texts); scoring covers every
text in full.  The softmax is linear, so a word counts by one number, which tasks remember per word.

Defined cases: a null or empty text is one empty window and scores by the bias; a null doc_id is not held out; a
repeated row is scored again; of labels that share an id the largest counts; no labelled rows at all give the score 0.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"\w+")
MEMORY = 250_000


@dataclass(frozen=True)
class Model:
    """``table`` x dims embeddings, 2 x dims softmax weights and 2 biases."""
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    window: int

    def word_scores(self) -> np.ndarray:
        """What each entry of the table adds to the logit of class 1 over class 0."""
        return self.embeddings @ (self.weights[1] - self.weights[0])


def parts_of(word: str, low: int = 3, high: int = 5) -> list[str]:
    """A word and its character n-grams, with marks at both ends."""
    marked = f"<{word}>"
    return [marked] + [marked[i:i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1)]


def entry(part: str, table: int) -> int:
    return xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) % table


def grams(word: str, table: int) -> list[int]:
    """Table entries of a word and of its n-grams."""
    return [entry(p, table) for p in parts_of(word)]


class Scores(dict):
    """What each n-gram adds to the logit, remembered on first use."""

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, part: str) -> float:
        value = self[part] = float(self.table[entry(part, len(self.table))])
        return value

    def word(self, word: str) -> float:
        first, *rest = parts_of(word)  # the whole word is rarely met again
        return (float(self.table[entry(first, len(self.table))]) + sum(map(self.__getitem__, rest))) / (1 + len(rest))


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def most_toxic(x: np.ndarray, window: int) -> float:
    """Largest mean over ``window`` consecutive words, at every word (over all words of a shorter text)."""
    if len(x) <= window:
        return float(x.mean()) if len(x) else 0.0
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return float((sums[window:] - sums[:-window]).max() / window)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 2500) -> list[tuple[str, int]]:
    """(text, label) of at most ``sample_rows`` rows per class that are not held out, by smallest hash of the id."""
    known = (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
             .filter(~held_out()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = known.filter("y = 1").orderBy(*order).limit(sample_rows).unionByName(known.filter("y = 0").orderBy(*order).limit(sample_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r["text"] or "", int(r["y"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def train(sample: list[tuple[str, int]], table: int = 1 << 17, dims: int = 8, window: int = 8, turns: tuple[int, int] = (20, 60), rate: float = 0.05, decay: float = 0.02,
          calm: float = 4.0, seed: int = 7) -> Model:
    """Fit embeddings and softmax by Adam on all of the sample at once."""
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (table, dims))
    weights, bias = rng.normal(0, 0.1, (2, dims)), np.zeros(2)
    if not sample:
        return Model(np.zeros((1, 1)), np.zeros((2, 1)), np.array([50.0, -50.0]), window)
    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t, _ in sample]
    flat_grams, gram_count = array("i"), array("i")  # packed: the words of thousands of texts have millions of n-grams
    for w in vocabulary or [""]:
        found = grams(w, table)
        flat_grams.extend(found)
        gram_count.append(len(found))
    gram_count = np.array(gram_count)
    gram_of, gram_word = np.array(flat_grams), np.repeat(np.arange(len(gram_count), dtype=np.int32), gram_count)
    y = np.array([label for _, label in sample], float)
    share = np.array([1 / max(1, (y == 0).sum()), 1 / max(1, (y == 1).sum())])[y.astype(int)] * 0.5
    # Windows: the first pass has one per text, the second one at every word; their sums are differences of running sums.
    flat = np.concatenate(texts).astype(np.int32)
    sizes = np.array([len(t) for t in texts])
    begin_of_text = np.cumsum(sizes) - sizes
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (embeddings, weights, bias)]
    step = 0
    for width, count in ((max(1, int(sizes.max(initial=1))), turns[0]), (window, turns[1])):
        pieces = np.maximum(1, sizes - width + 1)
        first_piece = np.cumsum(pieces) - pieces
        begin = (np.arange(pieces.sum()) + np.repeat(begin_of_text - first_piece, pieces)).astype(np.int32)
        end = np.minimum(begin + width, np.repeat(begin_of_text + sizes, pieces)).astype(np.int32)
        held = np.maximum(end - begin, 1)
        # What a window of a text of class 0 counts; in a text of class 1 only the top one does.
        calm_share = np.repeat(np.where(y == 0, share * calm / pieces, 0), pieces)
        for _ in range(count):
            step += 1
            u = weights[1] - weights[0]
            word = np.bincount(gram_word, weights=(embeddings @ u)[gram_of], minlength=len(gram_count)) / gram_count
            sums = np.concatenate([[0], np.cumsum(word[flat])])
            logit = (sums[end] - sums[begin]) / held + bias[1] - bias[0]
            hits = np.flatnonzero(logit == np.repeat(np.maximum.reduceat(logit, first_piece), pieces))
            top = hits[np.searchsorted(hits, first_piece)]
            d = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            # A text of class 1 has one such window at least; in a text of class 0 every window is of class 0.
            p_top = d[top]
            d *= calm_share
            d[top] += (p_top - y) * share
            per_piece = d / held
            steps = np.bincount(begin, weights=per_piece, minlength=len(flat) + 1) - np.bincount(end, weights=per_piece, minlength=len(flat) + 1)
            per_word = np.bincount(flat, weights=np.cumsum(steps)[:-1], minlength=len(gram_count)) / gram_count
            per_gram = np.bincount(gram_of, weights=per_word[gram_word], minlength=table)
            grad_u = per_gram @ embeddings
            for x, g, m in zip((embeddings, weights, bias), (per_gram[:, None] * u + decay * embeddings / len(sample), np.stack([-grad_u, grad_u]), np.array([-d.sum(), d.sum()])), moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                x -= rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-9)
    return Model(embeddings, weights, bias, window)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.word_scores().astype(np.float32), float(model.bias[1] - model.bias[0]), model.window))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias, window = shared.value
        memory: dict[str, float] = {}
        scores_of = Scores(table)
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                if len(memory) > MEMORY:
                    memory.clear()
                if len(scores_of) > MEMORY:
                    scores_of.clear()
                for w in set(words).difference(memory):
                    memory[w] = scores_of.word(w)
                x = np.fromiter(map(memory.__getitem__, words), float, len(words))
                scores[i] = 1 / (1 + np.exp(-np.clip(most_toxic(x, window) + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Train on the labels that are not held out and score all documents."""
    return scored(docs, train(training_sample(docs, labels), **fitting))
