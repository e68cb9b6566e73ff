"""License scans: base phrases, and templates with markup compiled into token automata.

A template is wording with marks: ``[[ ... ]]`` may be left out, ``{{n}}`` stands for up to n words of any kind.  It is
compiled into a nondeterministic automaton over word tokens; a text is accepted where the automaton reaches its end, so
every mandatory word must match exactly and in order.  Automata start only where their first mandatory words stand.

Defined cases: a null or empty text has no words and no labels; repeated rows are scanned one by one; an empty table
gives no rows; long texts cost a pass over their words; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Own templates: label -> wording with markup, or several wordings.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "mit-notice": "released under the [[terms of the]] mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]",
    "gpl-3-notice": tuple(f"{begin} gnu general public license [[as published by the free software foundation [[either]]]] version 3 [[of the license]] [[or at your option any later version]]"
                          for begin in ("licensed under the [[terms of the]]", "under the terms of the")),
    "gpl-2-notice": tuple(f"{begin} gnu general public license [[as published by the free software foundation [[either]]]] version 2 [[of the license]] [[or at your option any later version]]"
                          for begin in ("licensed under the [[terms of the]]", "under the terms of the")),
    "cc-by-nc": ("licensed under [[a]] [[creative commons]] cc by nc [[4 0]]", "licensed under [[a]] [[the]] creative commons attribution noncommercial [[4 0]] [[international]] [[license]]"),
    "cc-by-sa": ("licensed under [[a]] [[creative commons]] cc by sa [[4 0]]", "licensed under [[a]] [[the]] creative commons attribution sharealike [[4 0]] [[international]] [[license]]"),
    "cc-by-nd": ("licensed under [[a]] [[creative commons]] cc by nd [[4 0]]", "licensed under [[a]] [[the]] creative commons attribution noderivatives [[4 0]] [[international]] [[license]]"),
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of {{12}} to deal in the software without restriction including "
                "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
                "notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[the software is provided as is]]",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
                "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
                "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
                "documentation and or other materials provided with the distribution",
    "isc-text": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above "
                "copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Automaton:
    """States 0..n; ``next_word[state]``: word -> state; ``any_word[state]``: state reached by any word, or -1;
    ``free[state]``: states reached without a word, closed.  ``start``: the first words, all mandatory."""
    label: str
    next_word: tuple[dict[str, int], ...]
    any_word: tuple[int, ...]
    free: tuple[frozenset[int], ...]
    start: str
    mandatory: int

    def end(self, words: list[str], at: int) -> int | None:
        """End (exclusive) of the longest acceptance that begins at ``at``."""
        final, states, found = len(self.free) - 1, self.free[0], None
        for i in range(at, len(words) + 1):
            if final in states:
                found = i
            if i == len(words) or not states:
                break
            after: set[int] = set()
            for s in states:
                if (to := self.next_word[s].get(words[i])) is not None:
                    after |= self.free[to]
                if self.any_word[s] >= 0:
                    after |= self.free[self.any_word[s]]
            states = frozenset(after)
        return found


def compiled(label: str, template: str) -> Automaton:
    """Compile a template; its wording must begin with at least one mandatory word."""
    next_word: list[dict[str, int]] = [{}]
    any_word, skips, opened = [-1], [], []
    mandatory, start = 0, []

    def state() -> int:
        next_word.append({})
        any_word.append(-1)
        return len(next_word) - 1

    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\w+", template):
        at = len(next_word) - 1
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            skips.append((opened.pop(), at))
        elif token[0] == "{":
            for _ in range(int(token[2:-2])):
                begin = len(next_word) - 1
                any_word[begin] = state()
                skips.append((begin, len(next_word) - 1))
        else:
            next_word[at][token] = state()
            if not opened:
                mandatory += 1
                if at == len(start):
                    start.append(token)
    if not start:
        raise ValueError(f"{label} begins with no mandatory word")
    free = [{s} for s in range(len(next_word))]
    for s in range(len(next_word) - 1, -1, -1):
        for a, b in skips:
            if a == s:
                free[s] |= free[b]
    return Automaton(label, tuple(next_word), tuple(any_word), tuple(frozenset(f) for f in free), " ".join(start), mandatory)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_APART).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word places where the words of ``phrase`` stand, in `` a b c `` with a space around every word."""
    out, at, counted, words = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        out.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def scan(text: str | None, phrases: dict[bytes, str], automata: list[Automaton]) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Number of words, base places (start, end, label), accepted templates (start, end, label)."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = [(at, at + p.count(b" ") + 1, label) for p, label in phrases.items() if p in joined for at in places(joined, p)]
    accepted, plain = [], None
    for a in automata:
        start = a.start.encode()
        if start in joined:
            plain = plain or [w.decode("utf-8", "surrogatepass") for w in words]
            accepted += [(at, end, a.label) for at in places(joined, start) if (end := a.end(plain, at)) is not None]
    return len(words), base, outermost(accepted)


def outermost(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that lie in no other span of their label: wordings of one label may share words."""
    out, last = [], {}
    for start, end, label in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if end > last.get(label, -1):
            out.append((start, end, label))
            last[label] = end
    return out


SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "templates array<struct<start: long, end: long, label: string>>")


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str | tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Base counts and labels of every text, and the spans (in words) of the templates that it holds.

    score: 1 where a template is accepted, 0.5 where base phrases alone stand, else 0.
    """
    base = {p.encode(): label for p, label in phrases.items()}
    automata = [compiled(label, t) for label, wordings in templates.items() for t in ([wordings] if isinstance(wordings, str) else wordings)]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                n, found, accepted = scan(text.as_py(), base, automata)
                starts = [s for s, _, _ in found]
                labels = {x for _, _, x in found}
                out.append((n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for _, _, x in accepted})),
                            1.0 if accepted else 0.5 if found else 0.0, [{"start": s, "end": e, "label": x} for s, e, x in sorted(accepted)]))
            columns = list(zip(*out, strict=True)) or [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]
            names = [x.split()[0] for x in SCANNED.split(", templates")[0].split(", ")] + ["templates"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    return rows.mapInArrow(run, SCANNED)
