"""Lenient numbers, clamps, thresholds and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import as_column, strip
from factloom.rules import scoring as S


def lenient_long(value: Column | str) -> Column:
    """Whole number of a text with optional thousands commas; NULL when it is none."""
    text = F.replace(strip(as_column(value).cast("string")), F.lit(","), F.lit(""))
    number = F.when(text.rlike("^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?$"),
                    text.try_cast("double"))
    return F.when(text.rlike("^[+-]?\\d{1,18}$"), text.try_cast("bigint")).otherwise(
        F.when(F.abs(number) < 9.0e18, number.cast("bigint")))


def lenient_bool(value: Column | str) -> Column:
    """Truth of 1, true, yes, y and deleted, in any case."""
    text = F.lower(strip(as_column(value).cast("string")))
    return F.coalesce(text.isin("1", "true", "yes", "y", "deleted"), F.lit(False))


def safe_int(value: Column | str, default: int | Column = 0) -> Column:
    """Whole number, else the default."""
    fallback = F.lit(default) if isinstance(default, int) else default
    return F.coalesce(as_column(value).try_cast("int"), fallback)


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit a value to [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(value, digits)


def by_threshold(value: Column, table: list[tuple[float, str]], default: str) -> Column:
    """Label of the first threshold the value reaches."""
    out: Column | None = None
    for limit, label in table:
        out = F.when(value >= limit, label) if out is None else out.when(value >= limit, label)
    return out.otherwise(default)


def score_bucket(score: Column) -> Column:
    return by_threshold(score, S.BUCKETS, S.BUCKET_DEFAULT)


def score_grade(score: Column) -> Column:
    return by_threshold(score, S.GRADES, S.GRADE_DEFAULT)


def confidence_label(score: Column) -> Column:
    return by_threshold(score, S.CONFIDENCE_BUCKETS, S.CONFIDENCE_DEFAULT)


def level(value: Column, limits: tuple[float, float, float, float]) -> Column:
    """Level 1 to 5 by four rising thresholds."""
    return (F.when(value >= limits[3], 5).when(value >= limits[2], 4)
            .when(value >= limits[1], 3).when(value >= limits[0], 2).otherwise(1))


def stage_fit(value: Column | str) -> Column:
    """How well a funding stage fits an early-stage mandate, 1 to 5."""
    text = F.lower(strip(F.coalesce(as_column(value), F.lit(""))))
    return (F.when(text == "", 2)
            .when(text.rlike("种子|天使|pre-a|prea"), 5)
            .when(text.rlike("a\\+|a轮|a round"), 4)
            .when(text.rlike("b轮|b round"), 3)
            .when(text.rlike("c轮|c round"), 2)
            .when(text.rlike("d轮|pre-ipo|ipo|后期"), 1)
            .when(text.rlike("成长"), 3)
            .otherwise(2))


def percentage(value: Column | str) -> Column:
    """First percentage of a text as a number."""
    hit = F.regexp_extract(as_column(value), "(\\d+(?:\\.\\d+)?)\\s*%", 1)
    return F.when(hit != "", hit.try_cast("double"))
