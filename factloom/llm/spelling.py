"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.  The composed machine has states
(a, e, b): a and b are states of the vocabulary's acceptor, e tells whether the edit was made.  Up to the edit both words
read the same letters, so the states are (q, 0, q); at q the edit replaces x by y or inserts y; after it both read the
same letters again.  The edit is taken where the words first differ (at q, x is not y; an inserted y is not the letter that
comes next), so the machine accepts each pair once.

The vocabulary is partitioned by initial states, so that no task holds it whole.  A partition is a range [low, high) of edit
positions among words of m letters and their partners of m or m + 1: such pairs share their first ``low`` letters and,
behind the edit, their last m - high.  These letters are the partition's key: the state that the first ones lead to (and the
mirrored machine's state for the last ones) is the initial state of its acceptor, which holds the letters between them.
At first a word is in two ranges, the first and the second half.  A partition of more than ``MOST_WORDS`` words is cut into the
two halves of its range, again and again; a range of one position holds words that differ in one letter, so partitions
become small whatever the words are, and no pair is lost: its edit position lies in exactly one range at every step.

Each task builds the minimised acceptor of one partition at a time (right languages are shared, and words are numbered by
counting) and enumerates the pairs that the composition accepts.  After the edit, equal states accept the same words, so their
pairs are read off without walking on.

Defined cases: a null or empty text has no words; a null doc_id is the empty string in the hash of a run; repeated rows count
each; ties of n go to the smaller word in code-point order; runs of any length are words; an empty table gives no rows.
Only the named columns of the input are read, so others cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MIN_LETTERS, MIN_COUNT, FORM_FACTOR = 7, 2, 10
#: Where this number divides the hash of a run, one of its letters is deleted (typing errors of the corpus).
DELETE_EVERY = 31
#: Words that a task counts before it hands them on, and words of one partition.
COUNTED_WORDS, MOST_WORDS = 200_000, 2_000
#: Rows of partitions that one task composes.
TASK_ROWS = 20_000
RANGE = ["m", "low", "high", "head", "tail"]


def written(doc_id: str, run: str) -> str:
    """A lower-cased run of a document as it is counted: one letter is deleted where the hash says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DELETE_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """Words of the whole texts and their counts: word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
            words.clear()
            return out

        for batch in batches:
            for i, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs: Counter[str] = Counter()
                for run, n in Counter(RUN.findall(whole or "")).items():
                    if len(run) >= min_letters:
                        runs[run.lower() if run.isascii() else run.translate(LOWER)] += n
                for run, n in runs.items():
                    word = written(i or "", run)
                    if len(word) >= min_letters:
                        words[word] += n
                if len(words) >= COUNTED_WORDS:
                    yield flush()
        if words:
            yield flush()

    counted = docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def keyed(rows: DataFrame) -> DataFrame:
    """Add the key letters of a range to rows of (word, n, m, low, high)."""
    behind = F.greatest(F.col("m") - F.col("high"), F.lit(0))
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("low")), "tail": F.when(behind > 0, F.right("word", behind)).otherwise("")})


def halves(low: Column, high: Column) -> Column:
    """The two halves of a range; a range of one position stays."""
    middle = F.floor((low + high) / 2).cast("int")
    half = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    return F.when(high - low > 1, F.array(half(low, middle), half(middle, high))).otherwise(F.array(half(low, high)))


def partitions(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """Rows (word, n, m, low, high, head, tail): the words of every partition, at most ``most_words`` each unless its range is one position."""
    size = F.length("word")
    # Pairs of m and m letters and of m and m + 1: a word is among those of its own length and of the length below.
    lengths = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    ranges = lengths.select("*", F.inline(halves(F.lit(0), F.col("m") + 1)))
    current, done = stored(keyed(ranges)), []
    while True:
        # Pairs need a word of m letters and a partner; a full partition is cut.
        sizes = current.groupBy(*RANGE).agg(F.count(F.lit(1)).alias("_words"), F.count_if(F.length("word") == F.col("m")).alias("_own"))
        sizes = sizes.filter((F.col("_words") > 1) & (F.col("_own") > 0)).drop("_own")
        rows = stored(current.join(sizes, RANGE))
        cut = (F.col("_words") > most_words) & (F.col("high") - F.col("low") > 1)
        done.append(rows.filter(~cut).drop("_words"))
        full = rows.filter(cut)
        if full.isEmpty():
            break
        current = stored(keyed(full.select("word", "n", "m", F.inline(halves(F.col("low"), F.col("high"))))))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class Acceptor:
    """The minimised acceptor of a sorted list of distinct words: states with equal right languages are one state.

    ``arcs[q]`` maps letters to states, ``final[q]`` tells whether a word ends in q, ``size[q]`` counts the words of q's right
    language, and ``skip[q]`` has per letter the number of those words that come before that letter's: the sum along a
    word is its number in the list.
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self.skip: list[dict[str, int]] = []
        self._register: dict[tuple, int] = {}
        # Unfinished states of the last word, by depth: whether a word ends there, and finished arcs.
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            self._finish(path, last, same)
            path.extend(([False], {}) for _ in range(same, len(word)))
            path[len(word)][0][0] = True
            last = word
        self._finish(path, last, 0)
        self.start = self._state(*path[0])

    def _finish(self, path: list, last: str, depth: int) -> None:
        for at in range(len(last), depth, -1):
            path[at - 1][1][last[at - 1]] = self._state(*path.pop())

    def _state(self, final: list[bool], arcs: dict[str, int]) -> int:
        key = (final[0], *arcs.items())
        found = self._register.get(key)
        if found is None:
            found = self._register[key] = len(self.arcs)
            before, skip = int(final[0]), {}
            for letter, q in arcs.items():
                skip[letter] = before
                before += self.size[q]
            self.arcs.append(arcs)
            self.final.append(final[0])
            self.size.append(before)
            self.skip.append(skip)
        return found

    def common(self, a: int, b: int, i: int, j: int, not_first: str = "") -> Iterator[tuple[int, int]]:
        """Pairs of numbers of the words that a and b both accept, counted from i and j; ``not_first`` bars the first letter."""
        todo = [(a, b, i, j, not_first)]
        while todo:
            a, b, i, j, bar = todo.pop()
            if a == b and not bar:
                yield from ((i + k, j + k) for k in range(self.size[a]))
                continue
            if self.final[a] and self.final[b]:
                yield i, j
            one, two = (a, b) if len(self.arcs[a]) <= len(self.arcs[b]) else (b, a)
            for letter in self.arcs[one]:
                if letter != bar and letter in self.arcs[two]:
                    todo.append((self.arcs[a][letter], self.arcs[b][letter], i + self.skip[a][letter], j + self.skip[b][letter], ""))

    def one_edit(self, positions: int) -> Iterator[tuple[int, int]]:
        """Numbers of the word pairs that the composition accepts, with the edit among the first ``positions`` letters."""
        todo = [(self.start, 0, 0)]
        while todo:
            q, i, depth = todo.pop()
            if self.size[q] < 2 or depth >= positions:
                continue
            arcs, skip = list(self.arcs[q].items()), self.skip[q]
            for k, (x, to) in enumerate(arcs):
                # (q, 0, q) reads nothing against x, and x against every later letter.
                yield from self.common(q, to, i, i + skip[x], x)
                for y, other in arcs[k + 1:]:
                    yield from self.common(to, other, i + skip[x], i + skip[y])
                todo.append((to, i + skip[x], depth + 1))


def near_pairs(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """Every pair of near words once: a, n_a, b, n_b."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[], [], [], []]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, (pa.string(), pa.int64()) * 2)], ["a", "n_a", "b", "n_b"])
            for v in found:
                v.clear()
            return out

        for (m, low, high, head, tail), group in _groups(batches):
            middle = lambda row: row[0][len(head):len(row[0]) - len(tail)]  # noqa: E731, B023
            group.sort(key=middle)
            for i, j in Acceptor([middle(row) for row in group]).one_edit(high - low):
                # Two words of m + 1 letters meet among those of their own length.
                if len(group[i][0]) == m or len(group[j][0]) == m:
                    for v, x in zip(found, (*group[i], *group[j]), strict=True):
                        v.append(x)
            if len(found[0]) >= 10_000:
                yield flush()
        if found[0]:
            yield flush()

    rows = partitions(words, most_words).select(*RANGE, "word", "n")
    # Composing costs far more than its rows' bytes, by which few tasks would do.
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    dealt = rows.repartition(tasks, *RANGE).sortWithinPartitions(*RANGE)
    return dealt.mapInArrow(compose, "a string, n_a long, b string, n_b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, int]]]]:
    """Runs of rows with one key: the key and its (word, n)."""
    last, group = None, []
    for batch in batches:
        for *key, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != last:
                if group:
                    yield tuple(last), group
                last, group = key, []
            group.append((word, n))
    if group:
        yield tuple(last), group


def forms(words: DataFrame, pairs: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """Per word: n, n_near, form (its near word of largest n, if that is ``factor`` times its own) and form_n."""
    pair = lambda a, n, b, k: F.struct(F.col(a).alias("word"), F.col(n).alias("n"), F.col(b).alias("near"), F.col(k).alias("k"))
    both = pairs.select(F.inline(F.array(pair("a", "n_a", "b", "n_b"), pair("b", "n_b", "a", "n_a"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "near")).alias("best"))
    held = words.join(best, "word", "left")
    enough = -F.col("best.k") >= F.col("n") * factor
    return held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
                       F.when(enough, -F.col("best.k")).alias("form_n"))


def with_roots(rows: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """Add root: the last word on the way from form to form.

    n grows ``factor`` times at each step, so a way has at most log(largest n) steps, and doubling halves them each time.
    """
    top, steps = rows.agg(F.max("n")).first()[0] or 1, 0
    while top >= factor:
        top, steps = top // factor, steps + 1
    links = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("to"))
    reached = 1
    while reached < steps:
        on = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        links, reached = stored(links.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"))), 2 * reached
    return rows.join(links, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all documents with their near words' count, form and root."""
    words = stored(vocabulary(docs, doc_id, text))
    return with_roots(stored(forms(words, near_pairs(words)))).select("word", "form", "root", "n", "n_near", "form_n")


def normalised(texts: DataFrame, roots: DataFrame, word: str = "word") -> DataFrame:
    """Rows with a word column, and that word's root beside it (words without one stay)."""
    known = roots.filter(F.col("root") != F.col("word")).select(F.col("word").alias("_variant"), F.col("root").alias("_root"))
    return texts.join(known, F.col(word) == F.col("_variant"), "left").withColumn("root", F.coalesce("_root", word)).drop("_variant", "_root")
