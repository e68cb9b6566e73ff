"""Text clean-up, keyword tests and small text facts."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.rules import text as T

# Unicode white space as one character class.
SPACE = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# The characters of this class.
_SPACES = " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
# Characters on either side of a Han one that :func:`near_han` keeps.
_NEAR = 8
# A character reference, as HTML reads it: the semicolon may be missing, a name may run into what follows.
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# One that ends with its semicolon, so that a text cut inside a reference keeps what is left of it.
_TERMINATED = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[^\t\n\f <&#;]{1,32});"
# Names that pages and feeds use most; they stand first in the table, whose look-up ends at the name.
_COMMON = ["amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "hellip", "mdash", "ndash", "lsquo", "rsquo", "ldquo", "rdquo", "middot"]
# All names of the HTML list, with and without semicolon, as the text of one map.
_NAMES = dict.fromkeys([n + ";" for n in _COMMON] + sorted(html5))
_PAIR, _NEXT = "\u0003", "\u0002"
_TABLE = _NEXT.join(f"{n}{_PAIR}{html5[n]}" for n in _NAMES)
# Names that need no semicolon, longest first.
_OPEN = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
# References to the code points 128 to 159 mean the characters of those bytes in windows-1252, where it has one.
_C1 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def as_column(value: Column | str) -> Column:
    """A column name or a Column as a Column."""
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside one expression."""
    return F.transform(F.array(value), use)[0]


def sql_text(value: str | int | float) -> str:
    """A value as a SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def constant_map(pairs: dict | list[tuple]) -> Column:
    """A map of fixed values, folded to one literal."""
    items = pairs.items() if isinstance(pairs, dict) else pairs
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in items) + ")")


def constant_rules(pairs: list[tuple[str, str]]) -> Column:
    """An array of (key, label) structs of fixed values, folded to one literal."""
    rows = ", ".join(f"named_struct('key', {sql_text(k)}, 'label', {sql_text(v)})" for k, v in pairs)
    return F.expr(f"array({rows})")


def squash(value: Column | str) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(as_column(value), SPACE + "+", " "))


def strip(value: Column | str) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(as_column(value), F.lit(_SPACES))


def unescape(value: Column | str, terminated: bool = False, names: Sequence[str] | None = None) -> Column:
    """Decode HTML character references: numeric ones and all named ones, a longest known name winning.

    ``terminated`` decodes only references that end with a semicolon and whose whole name is known; ``names`` only these
    names, each as it is spelled (``amp;`` with its semicolon, ``amp`` without).
    """
    if names is not None:
        return _of_names(as_column(value), names)
    tokens = F.regexp_extract_all(as_column(value), F.lit(f"{_TERMINATED if terminated else _ENTITY}|[^&]+|&"), F.lit(0))
    decoded = F.array_join(F.transform(tokens, lambda token: _decoded(token, terminated)), "")
    return F.when(F.contains(as_column(value), F.lit("&")), decoded).otherwise(as_column(value))


def _of_names(value: Column, names: Sequence[str]) -> Column:
    """The text with these references decoded; those that mean '&' come last, so that what they leave is not read as another one."""
    for char in sorted({html5[n] for n in names}, key=lambda char: (char == "&", char)):
        spelled = "|".join(sorted((n for n in names if html5[n] == char), key=len, reverse=True))
        value = F.regexp_replace(value, f"&(?:{spelled})", re.sub(r"([\\$])", r"\\\1", char))
    return value


def _decoded(token: Column, terminated: bool) -> Column:
    """What one token of :func:`unescape` stands for."""
    table = F.str_to_map(F.lit(_TABLE), F.lit(_NEXT), F.lit(_PAIR))

    def number(code: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        unknown = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        dropped = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        return F.when(unknown, "\ufffd").when(code.between(128, 159), F.substring(F.lit(_C1), code.cast("int") - 127, F.lit(1))).when(dropped, "").otherwise(char)

    def name(text: Column) -> Column:
        start = F.regexp_extract(text, _OPEN, 0)
        whole = F.when(F.endswith(text, F.lit(";")), F.try_element_at(table, text))
        if terminated:
            return F.coalesce(whole, token)
        return F.coalesce(whole, F.when(start != "", F.concat(F.try_element_at(table, start), F.substring(text, F.length(start) + 1, F.length(text)))), token)

    digits, hexa = F.regexp_extract(token, "^&#0*([0-9]*);?$", 1), F.regexp_extract(token, "^&#[xX]0*([0-9A-Fa-f]*);?$", 1)
    code = (F.when(token.rlike("^&#[0-9]"), F.when(F.length(digits) < 8, F.concat(F.lit("0"), digits).cast("bigint")).otherwise(F.lit(0x110000)))
            .when(F.length(hexa) < 7, F.conv(F.concat(F.lit("0"), hexa), 16, 10).cast("bigint")).otherwise(F.lit(0x110000)))
    named = bind(F.substring(token, 2, 40), name)
    return F.when(token.rlike("^&#"), bind(code, number)).when(token.rlike("^&."), named).otherwise(token)


@functools.cache
def _clean_sql() -> str:
    """SQL of :func:`clean` for the lambda variable ``x``; one text, so that plans stay small."""
    q = sql_text
    table = f"str_to_map({q(_TABLE)}, {q(_NEXT)}, {q(_PAIR)})"
    number = (f"CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '\ufffd' WHEN n BETWEEN 128 AND 159 THEN substring({q(_C1)}, int(n) - 127, 1) "
              "WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR (n & 65534) = 65534 THEN '' "
              "ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END")
    code = ("CASE WHEN t RLIKE '^&#[0-9]' THEN coalesce(try_cast(regexp_extract(t, '^&#0*([0-9]{1,7});?$', 1) AS BIGINT), if(t RLIKE '^&#0+;?$', 0, 1114112)) "
            "WHEN length(regexp_extract(t, '^&#[xX]0*([0-9A-Fa-f]*);?$', 1)) < 7 THEN bigint(conv('0' || regexp_extract(t, '^&#[xX]0*([0-9A-Fa-f]*);?$', 1), 16, 10)) ELSE 1114112 END")
    name = (f"CASE WHEN w RLIKE ';$' AND map_contains_key({table}, w) THEN element_at({table}, w) "
            f"WHEN w RLIKE {q(_OPEN)} THEN element_at({table}, regexp_extract(w, {q(_OPEN)}, 0)) || regexp_replace(w, {q(_OPEN)}, '') ELSE t END")
    token = (f"CASE WHEN t RLIKE '^&#' THEN transform(array({code}), n -> {number})[0] "
             f"WHEN t RLIKE '^&.' THEN transform(array(substring(t, 2)), w -> {name})[0] ELSE t END")
    decoded = (f"CASE WHEN contains(x, '&') THEN array_join(transform(regexp_extract_all(x, "
               f"{q(_ENTITY + '|[^&]+|&')}, 0), t -> {token}), '') ELSE x END")
    return f"trim(regexp_replace({decoded}, {q(SPACE + '+')}, ' '))"


def clean(value: Column | str, limit: int | None = None, terminated: bool = False, names: Sequence[str] | None = None) -> Column:
    """NULL to '', decode entities, squash white space and cut to ``limit`` characters."""
    if isinstance(value, str) and not terminated and names is None:
        # Texts without a reference, most of them, need no decoding and so no lambda; blank ones need nothing.
        text, spaces = f"coalesce(string({value}), '')", sql_text(SPACE + "+")
        out = F.expr(f"CASE WHEN {text} = '' THEN '' WHEN contains({text}, '&') THEN transform(array({text}), x -> {_clean_sql()})[0] ELSE trim(regexp_replace({text}, {spaces}, ' ')) END")
    else:
        out = squash(unescape(F.coalesce(as_column(value).cast("string"), F.lit("")), terminated, names))
    return F.substring(out, 1, limit) if limit else out


def blank_to_null(value: Column | str) -> Column:
    """'' (after trimming) to NULL."""
    col = as_column(value)
    return F.when(strip(col) != "", col)


def first_text(*values: Column | str, default: str | Column = "待核实") -> Column:
    """First value that is not blank, trimmed; else the default."""
    last = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(*[blank_to_null(strip(as_column(v).cast("string"))) for v in values], last)


def optional_metadata(value: Column | str, limit: int) -> Column:
    """Placeholder metadata ('n/a', 'none', ...) to ''."""
    text = clean(value, limit)
    return F.when(F.lower(text).isin(T.OPTIONAL_METADATA), F.lit("")).otherwise(text)


def title_key(value: Column | str) -> Column:
    """Comparison key of a title: lowercase letters, digits and Han characters only."""
    return F.regexp_replace(F.lower(as_column(value)), "[^0-9a-z\\u4e00-\\u9fff]+", "")


def literal_pattern(words: list[str]) -> str:
    """One alternation of literal words."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def near_han(value: Column | str) -> Column:
    """The text without the middle of long runs of characters that are not Han: a word that :func:`is_near_han` accepts is found in it just as in the text."""
    return F.regexp_replace(as_column(value), f"([^\\u4e00-\\u9fff]{{{_NEAR}}})[^\\u4e00-\\u9fff]+([^\\u4e00-\\u9fff]{{{_NEAR}}})", "$1\u0001$2")


def is_near_han(word: str) -> bool:
    """Whether a word has a Han character, no run of more others than :func:`near_han` keeps, and not its mark."""
    return all(len(run) <= _NEAR for run in re.split("[\u4e00-\u9fff]", word)) and re.search("[\u4e00-\u9fff]", word) is not None and "\u0001" not in word


def has_any(value: Column | str, words: list[str]) -> Column:
    """Whether the text holds any of the words (the words must be lowercase for a lowercase text)."""
    return F.coalesce(as_column(value).rlike(literal_pattern(words)), F.lit(False))


def matches_any(value: Column | str, patterns: list[str]) -> Column:
    """Whether any of the patterns is found, ignoring case."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(as_column(value).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)),
                      F.lit(False))


def first_rule(value: Column | str, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first rule with any of its words in the text."""
    out: Column | None = None
    for label, words in rules:
        test = has_any(value, words)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def claim_type(value: Column | str) -> Column:
    """Guess the claim type of a source text."""
    return first_rule(F.lower(as_column(value)), T.CLAIM_RULES, T.CLAIM_DEFAULT)


def sector_type(value: Column | str) -> Column:
    """Sector of a company text."""
    return first_rule(F.lower(as_column(value)), T.SECTOR_RULES, "default")


def is_negative(stance: Column, claim: Column, text: Column,
                phrases: list[str] | None = None) -> Column:
    """Negative evidence: by stance, by claim type or by phrase."""
    return (F.coalesce(F.lower(strip(stance)) == "negative", F.lit(False))
            | F.coalesce(strip(claim).isin(T.NEGATIVE_CLAIMS), F.lit(False))
            | has_any(F.lower(text), phrases or T.NEGATIVE_PHRASES))


def is_meaningful(value: Column | str) -> Column:
    """Whether a text is more than a placeholder."""
    col = as_column(value)
    return F.coalesce(~F.lower(strip(col)).isin(T.PLACEHOLDERS), F.lit(False))


def count_meaningful(*values: Column | str) -> Column:
    """How many of the texts are more than placeholders."""
    return sum((is_meaningful(v).cast("int") for v in values), F.lit(0))


def distinct_ignoring_case(items: Column) -> Column:
    """Ordered distinct of an array of texts, comparing without case; the first spelling stays.

    Equal spellings are neighbours after a sort, so a long list costs n log n.
    """
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("v"))))
    kept = bind(keyed, lambda s: F.filter(s, lambda e, j: (j == 0) | (F.get(s, j - 1)["k"] != e["k"])))
    return F.transform(F.sort_array(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v")))), lambda e: e["v"])


def focus_terms(value: Column | str) -> Column:
    """Split a topic at commas, enumeration marks, slashes and line ends."""
    parts = F.transform(F.split(as_column(value), "[,，、/\\n]+"), strip)
    return distinct_ignoring_case(F.filter(parts, lambda p: p != ""))


def brief_keywords(value: Column | str) -> Column:
    """Keywords of a research brief: 2 to 28 characters, not blocked."""
    parts = F.transform(F.split(as_column(value), "[，。；;、\\n]+"),
                        lambda p: F.regexp_replace(F.regexp_replace(p, SPACE + "+", " "),
                                                   "^[ ：:,.。；;]+|[ ：:,.。；;]+$", ""))
    kept = F.filter(parts, lambda p: F.length(p).between(2, 28)
                    & ~F.lower(p).isin(T.BRIEF_BLOCKED)
                    & ~F.lower(p).rlike(literal_pattern(T.BRIEF_BLOCKED_PARTS)))
    return distinct_ignoring_case(kept)


def research_terms(value: Column | str, company: str | None = None, limit: int = 12) -> Column:
    """Focus terms then brief keywords, distinct, at most ``limit``; else the trimmed text itself."""
    col = as_column(value)
    if company:
        rest = F.filter(brief_keywords(col), lambda x: F.lower(x) != company.lower())
        return F.slice(F.concat(F.array(F.lit(company)), rest), 1, limit)
    terms = distinct_ignoring_case(F.concat(focus_terms(col), brief_keywords(col)))
    return F.when(F.size(terms) > 0, F.slice(terms, 1, limit)).otherwise(F.array(strip(col)))


def site_terms(value: Column | str, limit: int = 12) -> Column:
    """Hosts named by ``site:`` terms, lowercase, ordered distinct."""
    hits = F.regexp_extract_all(as_column(value), F.lit(r"site:([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(hits, F.lower)), 1, limit)


def allow_listed(value: Column | str, allowed: list[str], default: str | Column) -> Column:
    """Value in snake case when it is allowed, else the default."""
    code = F.replace(F.lower(clean(value, 40)), F.lit(" "), F.lit("_"))
    return F.when(code.isin(allowed), code).otherwise(
        F.lit(default) if isinstance(default, str) else default)


def redact(value: Column | str, keys: str = T.SECRET_KEYS, limit: int | None = 2000) -> Column:
    """Replace the value of every secret-like ``key = value`` by a mark; collapse white space."""
    return F.regexp_replace(clean(value, limit),
                            f"(?i)\\b({keys})\\b\\s*[:=]\\s*[^\\s,;]+", "$1=[redacted]")


def redact_quoted(value: Column | str, limit: int = 500) -> Column:
    """Redaction that also understands quoted keys and values, cut to ``limit``."""
    pattern = (f"(?i)(?:[\"']({T.FETCH_SECRET_KEYS})[\"']|({T.FETCH_SECRET_KEYS}))"
               "\\s*[:=]\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s,;}]+)")
    return F.substring(F.regexp_replace(strip(F.coalesce(as_column(value), F.lit(""))), pattern,
                                        "$1$2=[REDACTED]"), 1, limit)


def fallback_group_key(*parts: Column) -> Column:
    """Stable group key of a row without one: 24 hex digits of the hash of its parts."""
    return F.concat(F.lit("fallback:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def word_overlap_score(topic: str, words_found: Column) -> Column:
    """Two points per topic word found, at most ten."""
    return F.least(F.lit(10.0), words_found * 2.0)
