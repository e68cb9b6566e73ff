"""Word-piece token counts by a linear longest-match automaton.

Greedy longest match splits a word into the longest piece of the vocabulary at each place.  The automaton is the trie of
the vocabulary with failure links: where no longer match goes on, ``pops`` says how many pieces are final by then and
``fail`` is the node of what is left, so a word costs a number of steps in proportion to its length and no piece is ever
built.  A word that the vocabulary cannot cover is one unknown token.

Pieces that begin a word carry a mark in the vocabulary (byte-level files: the mark of a space); all others continue one.

Defined cases: a null or empty text has no words and no tokens; repeated rows are counted one by one; an empty table gives
no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY = 250_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary(path: str | None = None) -> set[bytes]:
    """Pieces of a byte-level vocabulary file as bytes; a leading space begins a word."""
    import public_tokenizers
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = json.load(file)
    letters = {c: b for b, c in byte_letters().items()}
    special = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(letters[c] for c in piece) for piece in model["model"]["vocab"] if piece not in special}


class Automaton:
    """Trie with failure links over bytes.  Node 0 is the root; ``pops[v]`` counts the pieces that are final when node v
    is left through its failure link; ``fail[v]`` is -1 where what is left cannot be matched."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][c]
            final[node] = bool(piece)
        self.final = final
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        level = [(0, c, v) for c, v in self.next[0].items()]
        while level:  # breadth first: links of shorter prefixes are known
            after = []
            for parent, c, v in level:
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                elif parent:
                    node, popped = self.fail[parent], self.pops[parent]
                    while node >= 0 and c not in self.next[node]:
                        popped += self.pops[node]
                        node = self.fail[node]
                    if node >= 0:
                        self.fail[v], self.pops[v] = self.next[node][c], popped
                after += [(v, x, w) for x, w in self.next[v].items()]
            level = after

    def count(self, word: bytes) -> int | None:
        """Number of pieces of the greedy longest match, None where it gets stuck."""
        following, fail, pops = self.next, self.fail, self.pops
        node, count = 0, 0
        for c in word:
            while c not in following[node]:
                count += pops[node]
                node = fail[node]
                if node <= 0 and (node < 0 or c not in following[0]):
                    return None
            node = following[node][c]
        while node > 0:
            count += pops[node]
            node = fail[node]
        return None if node < 0 else count


COUNTED = "doc_id long, n_words long, n_tokens long, n_unknown long, max_word_tokens long"
_automata: dict[str | None, Automaton] = {}


def automaton(path: str | None = None) -> Automaton:
    """The automaton of a vocabulary file, built once per process."""
    if path not in _automata:
        _automata[path] = Automaton(vocabulary(path))
    return _automata[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Words, word-piece tokens, unknown words and the most tokens of a word of every text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memory = automaton(path).count, {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(memory) > MEMORY:
                    memory.clear()
                for w in set(words).difference(memory):
                    memory[w] = count(b" " + w) or 0  # 0: unknown
                sizes = list(map(memory.__getitem__, words))
                unknown = sizes.count(0)
                out.append((len(words), sum(sizes) + unknown, unknown, max(max(sizes, default=0), min(1, unknown))))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=[x.split()[0] for x in COUNTED.split(", ")])

    return rows.mapInArrow(run, COUNTED)
