"""View labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import url as U
from factloom.functions.numbers import by_threshold
from factloom.functions.text import constant_map, strip
from factloom.rules import scoring as S
from factloom.rules import text as T


def labelled(value: Column, table: dict[str, str], missing: str) -> Column:
    """Label of a code; an unknown code stays, a blank one becomes ``missing``."""
    return F.coalesce(F.try_element_at(constant_map(table), value), F.when(value != "", value), F.lit(missing))


def claim_label(value: Column) -> Column:
    return labelled(value, T.CLAIM_LABELS, "未分类")


def tier_label(value: Column) -> Column:
    return labelled(value, T.TIER_LABELS, "未标注")


def confidence_label(value: Column) -> Column:
    return labelled(value, T.CONFIDENCE_LABELS, "未标注")


def traceability_label(value: Column) -> Column:
    return labelled(strip(value), T.TRACEABILITY_LABELS, "未标注")


def view_bucket(score: Column) -> Column:
    return by_threshold(score, S.VIEW_BUCKETS, S.VIEW_BUCKET_DEFAULT)


def view_badge(score: Column) -> Column:
    return by_threshold(score, S.VIEW_BADGES, S.VIEW_BADGE_DEFAULT)


def platform_label(platform: Column, url: Column) -> Column:
    """Platform of a row for display: its own name, else by host."""
    name = strip(F.coalesce(platform, F.lit("")))
    domain = F.lower(U.authority(F.coalesce(url, F.lit(""))))
    known = labelled(name, {"weixin": "微信公众号", "xiaohongshu": "小红书", "zsxq": "知识星球"}, "")
    return (F.when(~name.isin("", "general", "unknown"), known)
            .when(F.contains(domain, F.lit("mp.weixin.qq.com")), "微信公众号")
            .when(F.contains(domain, F.lit("xiaohongshu.com")), "小红书")
            .when(F.contains(domain, F.lit("zsxq.com")), "知识星球")
            .when(F.contains(domain, F.lit("gov.cn")), "政府/监管")
            .otherwise(F.when(domain != "", domain).otherwise("通用网页")))


def level_of_score(score: Column, weight: Column) -> Column:
    """Level 1 to 5 of a score with a weight; 0 without either."""
    raw = F.bround(score / weight * 5).cast("int")
    return F.when(score.isNull() | weight.isNull() | (weight == 0), 0).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(5), raw)))
