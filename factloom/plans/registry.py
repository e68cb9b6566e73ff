"""Query registry and the tables that queries derive from the given ones."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30"
NOW_TEXT = "2024-01-31T00:00:00"
NOW = 1706659200

# Derived tables as SQL that Spark and other engines read alike; {name} is a given table.
DERIVED = {
    # Evidence rows: one per document, dated by an event, verified by a label.
    "evidence": """
        SELECT d.doc_id AS seq,
          concat('启明', d.source, split_part('科技有限公司|科技|科技股份有限公司|（上海）科技有限公司', '|', CAST(d.doc_id % 4 AS INT) + 1)) AS entity,
          split_part('demand_signal|commercial_signal|product_signal|founder_signal|hiring_signal|policy_signal|partnership_signal|risk_signal|contradiction|funding_signal|exit_signal|competitive_signal', '|', CAST(d.doc_id % 12 AS INT) + 1) AS claim_type,
          split_part('positive|neutral|negative|positive|neutral', '|', CAST(d.doc_id % 5 AS INT) + 1) AS stance,
          split_part('primary_official||mainstream_media|social_post|aggregator|unknown|T1/T2', '|', CAST(d.doc_id % 7 AS INT) + 1) AS source_tier,
          CAST(d.doc_id % 5 + 1 AS INT) AS importance,
          concat('https://', split_part('www.gov.cn|36kr.com|mp.weixin.qq.com|www.qcc.com|www.zhihu.com|news.example.org|blog.example.net|cninfo.com.cn', '|', CAST(d.doc_id % 8 AS INT) + 1), '/a/', CAST(d.doc_id % 997 AS STRING)) AS source_url,
          split_part('未上市公司完成A轮融资1.5亿元|客户签约并量产交付|毛利率达到45%，专利与认证领先|营收超过3亿元，同比增长30%|对标海外龙头，国产替代|产品发布获批|订单取消，客户流失|公司介绍|平台生态合作伙伴', '|', CAST(d.doc_id % 9 AS INT) + 1) AS source_title,
          d.text AS quote,
          CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'general' END AS platform,
          CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE substr(CAST(e.ts AS STRING), 1, 19) END AS published_at,
          CASE WHEN d.doc_id % 6 = 0 THEN substr(CAST(e.ts AS STRING), 1, 10) WHEN d.doc_id % 29 = 0 THEN '2024-06-01' ELSE NULL END AS event_date,
          l.quality = 1 AS quote_verified,
          d.doc_id % 13 = 0 AS discovery_only,
          d.doc_id % 17 <> 0 AS evidence_eligible,
          CAST(d.doc_id % 4 AS INT) AS retrieval_provider_count,
          CAST(d.doc_id % 3 AS INT) AS independent_source_count,
          d.doc_id % 2 = 0 AS independently_corroborated
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id LEFT JOIN {events} e ON e.event_id = d.doc_id""",
    # Radar records: one per event.
    "records": """
        SELECT event_id AS seq,
          concat(split_part('鉴芯|星辰|甲乙丙丁|光子|海川|云起|青禾|常州鉴芯', '|', CAST(user_id % 8 AS INT) + 1), split_part('半导体|科技|机器人|光电|半导体有限公司', '|', CAST(user_id % 5 AS INT) + 1)) AS company,
          concat(split_part('鉴芯|星辰|甲乙丙丁|光子|海川|云起|青禾|常州鉴芯', '|', CAST(user_id % 8 AS INT) + 1), split_part('半导体|科技|机器人|光电|半导体有限公司', '|', CAST(user_id % 5 AS INT) + 1),
                 split_part('完成A轮融资|芯片实现量产|中标芯片订单|计划明年量产芯片|完成C+轮融资|机器人正式发布|介绍公司文化|获批临床|芯片流片成功|（600000）中标芯片|递表|通过芯片客户认证', '|', CAST(event_id % 12 AS INT) + 1),
                 CASE WHEN event_id % 3 = 0 THEN concat('第', CAST(event_id AS STRING), '号') ELSE '' END) AS title,
          concat('https://news.example.org/', CAST(event_id % 7919 AS STRING)) AS url,
          CASE WHEN event_id % 4 = 0 THEN concat(substr(CAST(ts AS STRING), 1, 4), '年', substr(CAST(ts AS STRING), 6, 2), '月', substr(CAST(ts AS STRING), 9, 2), '日')
               WHEN event_id % 4 = 1 THEN substr(CAST(ts AS STRING), 1, 10)
               WHEN event_id % 4 = 2 THEN concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8), 'Z')
               ELSE replace(substr(CAST(ts AS STRING), 1, 10), '-', '/') END AS published_at,
          CASE WHEN event_id % 19 = 0 THEN substr(CAST(ts AS STRING), 1, 10) ELSE NULL END AS event_date,
          CASE WHEN event_id % 10 = 0 THEN 'https://finance.eastmoney.com/' ELSE 'https://news.example.org/' END AS publisher_url,
          concat(event_type, ' ', props) AS summary,
          CASE WHEN event_id % 2 = 0 THEN 'google_news_rss' ELSE 'wechat_pool_body' END AS source_type,
          event_type = 'click' AS discovery_only
        FROM {events}""",
    # Imported articles: one per order of a customer.
    "imports": """
        SELECT o.o_orderkey AS seq, CASE WHEN c.c_custkey % 7 = 0 THEN '' ELSE c.c_name END AS account_name,
          CASE WHEN c.c_custkey % 5 = 0 THEN concat('Fake', CAST(c.c_custkey AS STRING)) ELSE '' END AS fakeid,
          concat(CASE WHEN o.o_orderkey % 41 = 0 THEN 'http://mp.weixin.example' ELSE 'http://mp.weixin.qq.com' END, '/s?scene=1&amp;mid=', CAST(o.o_orderkey % 7000 AS STRING), '&idx=', CAST(o.o_orderkey % 2 + 1 AS STRING), '&__biz=B', CAST(o.o_custkey % 50 AS STRING), '#rd') AS url,
          CASE WHEN o.o_orderkey % 6 = 0 THEN '' ELSE concat('标题 ', o.o_orderpriority) END AS title,
          CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE substr(CAST(o.o_orderdate AS STRING), 1, 10) END AS publish_time,
          CASE WHEN o.o_orderkey % 4 = 0 THEN '' ELSE CAST(o.o_orderkey % 100000 AS STRING) END AS read_count,
          CASE WHEN o.o_orderkey % 3 = 0 THEN 'body.md' ELSE '' END AS body_markdown_path,
          CASE WHEN o.o_orderstatus = 'P' THEN concat('token=', CAST(o.o_orderkey AS STRING), ' failed') ELSE '' END AS error,
          CASE WHEN o.o_orderkey % 8 = 0 THEN concat(substr(CAST(o.o_orderdate AS STRING), 1, 10), 'T03:00:00Z') ELSE '' END AS discovered_at,
          CAST(o.o_orderkey % 3 AS INT) AS copyright_type, CAST(o.o_orderkey % 2 AS INT) AS copyright_stat,
          CASE WHEN o.o_orderkey % 23 = 0 THEN '1' ELSE '0' END AS is_deleted,
          concat('g', CAST(o.o_orderkey % 3500 AS STRING)) AS msgid
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    # Search hits: three per page, from different providers and queries.
    "hits": """
        SELECT p.page_id * 3 + k.k AS seq, p.page_id, k.k AS provider_no,
          split_part('brave|exa|serper', '|', CAST((p.page_id + k.k) % 3 AS INT) + 1) AS provider,
          concat('q', CAST(p.page_id % 20 + k.k AS STRING)) AS query, CAST(p.page_id % 20 + k.k AS INT) AS query_pos,
          CASE WHEN k.k = 0 THEN p.url ELSE regexp_replace(p.url, '[?#].*$', '') END AS url,
          CASE WHEN k.k = 1 THEN '' ELSE concat('page ', CAST(p.page_id AS STRING)) END AS title
        FROM {pages} p JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k ON k.k <= p.page_id % 3""",
}


class Tables:
    """The given tables of one folder, and the tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            names = set(re.findall(r"\{(\w+)\}", DERIVED[name]))
            return self.spark.sql(DERIVED[name], **{n: getattr(self, n) for n in names})
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def with_derived(sql: str) -> str:
    """Complete a twin: every derived table it names becomes a common table expression."""
    used = [n for n in DERIVED if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
    parts = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', DERIVED[n])})" for n in used]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def query(name: str, operators: str, oracle: str | None = None):
    """Register a query with the operators it shows and its SQL twin."""
    def register(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        REGISTRY[name] = Query(name, operators, run, with_derived(oracle) if oracle else None)
        return run
    return register
