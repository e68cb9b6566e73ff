"""Quality rules: a threshold table compiled into one projection of Spark expressions.

``measures`` turns a text into counts; ``Rule`` rows compare a ratio of two expressions with a threshold; ``judged``
compiles the table into one struct of failed rules.  No user functions, joins or shuffles: each row is judged alone.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged one by one; an empty
table gives no rows; columns of the input are kept whatever their names, but for _m and _verdict, which ``judged`` returns (``kept``
keeps even those).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import apart, together

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages in the corpus.
STOP_WORDS = ("the of and to in is that for was with a on be at or as it by le la de et les des en un une du que qui est au der die und das den "
              "von zu mit ist des auf für im el los las y del que se por con para una no su es lo").split()


@dataclass(frozen=True)
class Rule:
    """Fails where ``numerator`` is below ``low`` or above ``high`` times ``denominator``; texts without the denominator pass."""
    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def failed(self, m: Column) -> Column:
        n, d = m[self.numerator].cast("double"), m[self.denominator].cast("double")
        tests = ([n < self.low * d] if self.low is not None else []) + ([n > self.high * d] if self.high is not None else [])
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return (d > 0) & out


#: The base rule: 50 words at least, and at most half of them in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 0.5
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=14.0),
    Rule("symbols", "n_symbols", "n_words", high=0.3),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=0.35),
    Rule("stop_words", "n_stop_words", "n_words", low=0.04),
)


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once: lambdas and filters above read it, as nothing is pushed through a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def measured(df: DataFrame, text: str = "text", name: str = "_m") -> DataFrame:
    """Add a struct of counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words.

    n_repeat_words counts the words that lie in a three-word window whose words occur again in the text; windows are
    compared by a 64-bit hash and sorted within the row, so a long text costs n log n.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long")
    arrays = F.struct(F.array_remove(F.split(whole, SPACE), "").alias("w"), F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("l"))
    out = bound(df, "_arrays", arrays).withColumns({"_words": F.col("_arrays.w"), "_lines": F.col("_arrays.l")}).drop("_arrays")
    n = F.size("_words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p"))))
    out = bound(out, "_windows", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,p:int>>"))))
    again = F.filter("_windows", lambda x, i: (F.get("_windows", i - 1)["h"] == x["h"]) | (F.get("_windows", i + 1)["h"] == x["h"]))
    out = bound(out, "_places", F.when(F.size("_windows") > 1, F.sort_array(F.transform(again, lambda x: x["p"]))).otherwise(F.array().cast("array<int>")))
    # Each repeated window adds the words that the next one does not cover.
    gaps = F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    measures = F.struct(
        n.cast("long").alias("n_words"), bare.alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"))
    return bound(out, name, measures).drop("_words", "_lines", "_windows", "_places")


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Add _m (the measures) and _verdict: base_failed, failed (names of the failed rules), kept."""
    inner, names = apart(df, [text])
    m = F.col("_m")
    base = (m["n_words"] < min_words) | (m["n_repeat_words"] > max_repeat * m["n_words"])
    failed = F.array_compact(F.array(*[F.when(r.failed(m), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    out = measured(inner, text).withColumn("_failed", failed)
    verdict = F.struct(base.alias("base_failed"), F.col("_failed").alias("failed"), (~base & (F.size("_failed") == 0)).alias("kept"))
    return out.select(*together(names, ("_m", "_verdict")), "_m", verdict.alias("_verdict"))


def kept(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass, with the columns of the input."""
    inner, names = apart(df, [text])
    return judged(inner, rules, text).filter("_verdict.kept").select(*together(names))
