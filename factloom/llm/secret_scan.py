"""Secret scans: base patterns, and novelty measured by a primed zstandard compressor.

Beside the base patterns, every long token of mixed characters in a sensitive context is a candidate.  Its novelty is
the number of bytes that it adds to the compressed text around it, with a dictionary of identifiers priming the
compressor: a random key adds nearly all its bytes, a name next to none.  A token's own copies are cut out of that text.
Tokens that add at least ``least_ratio`` of their length are reported at every place where they stand.

Spans are code points, end exclusive.  Defined cases: a null or empty text has no spans; repeated rows are scanned one by
one; an empty table gives no rows; columns of the input are kept by ``redacted`` and not read elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base patterns with the least length of the part that counts; letters of the words of assign in either case.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
#: Whole runs of at least the length that counts for assign; longer ones than PIECE are measured in pieces.
SHORTEST, PIECE = 12, 256
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
SENSITIVE = re.compile(r"(?:key|secret|token|passw|pwd|credential|auth|bearer|private)", re.ASCII | re.IGNORECASE)
#: Identifiers that prime the compressor.
IDENTIFIERS = ("access_key secret_key client_secret api_key auth_token password username authorization bearer private_key public_key credentials configuration "
               "environment connection database localhost example default undefined function return import class string integer boolean object array "
               "https://www.example.com/index.html application/json charset=utf-8 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef")


class Novelty:
    """Bytes that a token adds to its surroundings, compressed behind a dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS) -> None:
        primer = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False)

    def added(self, around: str, token: str) -> int:
        context = around.encode("utf-8", "surrogatepass")
        return len(self.compressor.compress(context + token.encode())) - len(self.compressor.compress(context))

    def is_new(self, before: str, token: str, after: str, around: int, least_ratio: float) -> bool:
        """Whether one of the even pieces of a token adds ``least_ratio`` of its length to what stands before it and after the token."""
        pieces = -(-len(token) // PIECE)
        cuts = [i * len(token) // pieces for i in range(pieces + 1)]
        known = before + token
        for a, b in zip(cuts, cuts[1:]):
            at = len(before) + a
            if self.added(known[max(0, at - around):at] + after, token[a:b]) >= least_ratio * (b - a):
                return True
        return False


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the base patterns, leftmost and apart per kind, failing lengths dropped."""
    low = text.lower()
    spans = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return spans


def mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def value_of(token: str) -> str:
    """The part of a token that its copies share: the longest between ``=`` and ``/`` if it could be a token itself, else all."""
    value = max(re.split("[=/]", token), key=len)
    return value if len(value) >= SHORTEST and mixed(value) else token


def without(text: str, start: int, end: int, value: str) -> str:
    """text[start:end] without the occurrences of ``value``, those that reach over its ends included."""
    out, at = [], text.find(value, max(0, start - len(value) + 1), end + len(value) - 1)
    while at >= 0:
        out.append(text[start:max(start, at)])
        start = min(end, at + len(value))
        at = text.find(value, start, end + len(value) - 1)
    return "".join(out) + text[start:end]


def places_of(text: str, runs: list[tuple[int, int]], values: set[str]) -> Iterator[tuple[int, int]]:
    """(start, end) wherever one of the values stands in the runs, by their first characters."""
    heads: dict[str, list[str]] = {}
    for v in values:
        heads.setdefault(v[:SHORTEST], []).append(v)
    for start, end in runs:
        for at in range(start, end - SHORTEST + 1):
            for v in heads.get(text[at:at + SHORTEST], ()):
                if text.startswith(v, at, end):
                    yield at, at + len(v)


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, near: int = 48, around: int = 512, least_ratio: float = 0.6) -> list[tuple[int, int, str]]:
    """Tokens that stand in a sensitive context and whose compressed bytes are mostly new, at every place where they stand.

    A token's own copies are no part of its surroundings.  Places that a base span touches are left to it."""
    if not SENSITIVE.search(text):
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    found: set[tuple[int, int]] = set()
    values: set[str] = set()
    for start, end in runs:
        token = text[start:end]
        if not mixed(token):
            continue
        value = value_of(token)
        named = token.rfind("=", 0, token.find(value)) + 1
        if not SENSITIVE.search(text, max(0, start + named - near), start + named):
            continue
        if value not in values:
            before, after = without(text, max(0, start - around), start, value), without(text, end, end + around, value)
            head, _, tail = token[named:].partition(value)
            if not novelty.is_new(before, head + value + tail.replace(value, ""), after, around, least_ratio):
                continue
            values.add(value)
        found.add((start, end))
    if values:
        last = -1
        for start, end in sorted(found | set(places_of(text, runs, values)), key=lambda x: (x[0], -x[1])):
            if end <= last:
                found.discard((start, end))
            else:
                found.add((start, end))
                last = end
    ends = sorted((s, e) for s, e, _ in base)
    return [(s, e, "novel") for s, e in sorted(found) if not any(a < e and s < b for a, b in ends)]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, identifiers: str = IDENTIFIERS, least_ratio: float = 0.6) -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans of every text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = base + novel_spans(text, base, novelty, least_ratio=least_ratio)
                kinds = [k for _, _, k in spans]
                out.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                                             names=[x.split()[0] for x in SCANNED.split(", ")])

    return rows.mapInArrow(run, SCANNED)


def redacted(docs: DataFrame, mark: str = "[secret]", identifiers: str = IDENTIFIERS, least_ratio: float = 0.6) -> DataFrame:
    """The documents with every span replaced by ``mark`` (touching and overlapping spans by one); n_chars follows."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        novelty = Novelty(identifiers)
        return pd.Series([_cleaned(t, novelty, mark, least_ratio) for t in texts], dtype=object)

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _cleaned(text: str | None, novelty: Novelty, mark: str, least_ratio: float) -> str | None:
    if not text:
        return text
    base = base_spans(text)
    out, last = [], 0
    for start, end, _ in sorted(base + novel_spans(text, base, novelty, least_ratio=least_ratio)):
        if start > last or (start == last and not out):
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join(out) + text[last:] if out else text
