import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as X
from factloom.operators import evidence as E
from factloom.operators import scoring as S
from factloom.rules import scoring as R

NOW = D.to_epoch("2026-08-21T12:00:00")
TODAY = date(2026, 8, 21)


def item(seq, quote, **kw):
    row = {"seq": seq, "entity": "测试公司", "claim_type": "product_signal", "stance": "positive",
           "source_tier": "mainstream_media", "importance": 3, "source_url": f"https://source{seq}.example.com/article",
           "source_title": f"报道{seq}", "quote": quote, "platform": "general", "tags": [],
           "published_at": TODAY.isoformat(), "event_date": None, "captured_at": None, "quote_verified": True,
           "discovery_only": False, "evidence_eligible": True, "retrieval_provider_count": 1,
           "independent_source_count": 1, "independently_corroborated": False}
    row.update(kw)
    return row


SCHEMA = ", ".join(f"{k} {v}" for k, v in E.EVIDENCE_COLUMNS.items() if k not in ("event_type", "provider_count"))


def table(spark, rows):
    names = [p.split(" ")[0] for p in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def score(spark, rows, topic=""):
    return S.score_companies(table(spark, rows), NOW, topic).cache()


def test_future_and_capture_dates_are_never_recent(spark):
    old, future = (TODAY - timedelta(365)).isoformat(), (TODAY + timedelta(365)).isoformat()
    rows = [item(1, "无发布日期的历史介绍", published_at=None, captured_at=TODAY.isoformat()),
            item(2, "未来日期异常", published_at=future), item(3, "旧事件在今天被转载", event_date=old)]
    out = E.evidence_stats(E.normalize(table(spark, rows), NOW)).first()
    assert (out["dated"], out["recent_90"], out["recent_180"]) == (1, 0, 0)


def test_topic_does_not_move_scores(spark):
    rows = [item(i, "该公司发布企业介绍。") for i in range(1, 5)]
    plain = score(spark, rows, "工业科技").first()
    loaded = score(spark, rows, "未上市 B轮 核心算法 国产替代 平台底座 股权结构 估值 3-5年 IPO 产业方").first()
    for name in ["total_score", "priority_score", "sector_type"] + [f"{d}__level" for d in R.DIMENSION_KEYS]:
        assert plain[name] == loaded[name]


def test_failed_events_give_no_momentum(spark):
    rows = [item(1, "本轮融资失败，估值下调。", claim_type="funding_signal", stance="neutral"),
            item(2, "订单取消，客户终止合作。", claim_type="commercial_signal", stance="neutral"),
            item(3, "量产延期，产品需要召回。", stance="neutral"),
            item(4, "尚未实现收入，暂无复购客户。", claim_type="commercial_signal", stance="neutral")]
    out = score(spark, rows).first()
    assert out["momentum_bonus"] == 0.0 and out["momentum_signals"] == []
    assert out["customer_validation__objective"] <= 1 and out["commercialization_progress__objective"] <= 1


def test_unknown_listing_is_capped(spark):
    out = score(spark, [item(1, "该公司发布企业介绍。")]).first()
    assert out["listed_status"] == "未知" and out["score_cap"] == 35.0
    assert "一级属性门槛" in [g["name"] for g in out["gates"]]
    out = score(spark, [item(2, "测试公司完成B轮融资。", claim_type="funding_signal")]).first()
    assert out["listed_status"] == "未上市"
    assert "一级属性门槛" not in [g["name"] for g in out["gates"]]


def test_alias_merge_and_ignored_rows(spark):
    rows = [item(1, "x", entity="视觉智能科技有限公司"), item(2, "y", entity="视觉智能科技"), item(3, "z", entity=""),
            item(4, "w", discovery_only=True, evidence_eligible=False, quote_verified=False)]
    frame = table(spark, rows)
    counts = {r["reason"]: r["n"] for r in E.admission_counts(frame).collect()}
    assert counts == {"admitted": 2, "no_entity": 1, "not_eligible": 1}
    names = E.entity_names(E.admit(frame)).collect()
    assert [(r["entity"], r["alias_count"], r["evidence_count"]) for r in names] == [("视觉智能科技有限公司", 2, 2)]


def test_retrieval_is_not_corroboration(spark):
    rows = [item(1, "测试科技完成产品验证。", retrieval_provider_count=3),
            item(2, "测试科技完成产品验证。", entity="乙", independently_corroborated=True, independent_source_count=2)]
    out = {r["entity_key"]: r for r in E.evidence_stats(E.normalize(table(spark, rows), NOW)).collect()}
    assert out["测试"]["multi_provider"] == 1 and out["测试"]["corroborated"] == 0
    assert out["测试"]["cross_validation"] == 0.0
    assert out["乙"]["corroborated"] == 1 and out["乙"]["cross_validation"] == 35.0


def test_irrelevant_evidence_keeps_confidence_low(spark):
    rows = [item(i, "该公司发布企业介绍。") for i in range(1, 5)]
    out = score(spark, rows).first()
    assert out["customer_validation__confidence"] == "low"
    assert out["exit_feasibility__confidence"] == "low"


def test_support_and_stats_by_hand(spark):
    rows = [item(1, "q", source_url="https://www.gov.cn/a", source_tier="", claim_type="policy_signal"),
            item(2, "q", source_url="https://zhihu.com/a", source_tier="social_post", platform="知乎",
                 published_at="2026-04-01", quote_verified=False, claim_type="policy_signal")]
    items = E.normalize(table(spark, rows), NOW)
    s = E.evidence_stats(items).first()
    assert (s["t1"], s["official"], s["social"], s["verified"], s["domains"]) == (1, 1, 1, 1, 2)
    assert s["freshness"] == 22 + 11 + 8 and s["authority"] == 28 + 12
    assert s["traceability_score"] == 82.5 and s["chain"] == 18 + 6 + 10 + 8 and s["social_ratio"] == 0.5
    d = {r["dimension"]: r for r in E.dimension_support(items).collect()}
    assert d["sector_prosperity"]["support_score"] == 20 + 14 + 12 + 16 + 20
    assert d["profit_pool"]["n"] == 0 and d["profit_pool"]["support_score"] == 0.0
    assert d["information_sufficiency"]["n"] == 2


def test_weights():
    rows = S.weight_rows()
    for sector in R.SECTOR_ADJUSTMENTS:
        assert abs(sum(w for s, _, w in rows if s == sector) - 100) < 0.05
    assert {d: w for s, d, w in rows if s == "default"} == R.DIMENSION_WEIGHTS


def _facts_by_hand(text):
    import re
    first = lambda p, g=1: (m.group(g) if (m := re.search(p, text, re.I)) else "")
    return {"latest_round": first(R.ROUND_PATTERN), "funding_total": first(R.AMOUNT_PATTERN),
            "latest_valuation": first(R.VALUATION_PATTERN), "gross_margin_text": first(R.MARGIN_PATTERN),
            "revenue_text": first(R.REVENUE_PATTERN),
            "growth_text": "；".join(re.findall(R.GROWTH_PATTERN, text, re.I)[:2]),
            "rivals": re.findall(R.RIVAL_PATTERN, text, re.I)[:3]}


@pytest.mark.parametrize("block,tail", [(256, 32), (8, 6)])
def test_text_facts_equal_one_long_text(spark, monkeypatch, block, tail):
    import random
    monkeypatch.setattr(E, "BLOCK_ROWS", block)
    monkeypatch.setattr(E, "TAIL_ROWS", tail)
    rng = random.Random(3)
    words = ["毛利率", "达到45%", "同比", "增长30%", "营收", "超过3亿元", "融资", "a轮", "估值20亿元", "约 5 亿元", "对标", "特斯拉",
             "。", "相比", "普通介绍", "；", "竞争对手为 某公司"]
    rows = []
    for seq in range(1, 400):
        entity = "甲芯科技" if seq % 3 else f"乙{seq % 5}"
        rows.append(item(seq, "".join(rng.choice(words) for _ in range(rng.randint(1, 4))), entity=entity,
                         importance=rng.randint(1, 5), source_title=rng.choice(["", "标题", "营收"]),
                         published_at=rng.choice(["2026-08-01", "2026-07-01", None])))
    items = E.normalize(E.admit(table(spark, rows)), NOW)
    got = {r["entity_key"]: r.asDict() for r in E.text_facts(items, E.entity_names(items)).collect()}
    plain = items.select("entity_key", "entity", "seq", "importance", "age", "profile_text").collect()
    for key in {r["entity_key"] for r in plain}:
        mine = sorted([r for r in plain if r["entity_key"] == key],
                      key=lambda r: (-r["importance"], 99999 if r["age"] is None else r["age"], r["seq"]))
        name = max((len(r["entity"]), r["entity"]) for r in mine)[1]
        want = _facts_by_hand(" ".join([name.lower()] + [r["profile_text"] for r in mine]))
        assert {k: got[key][k] for k in want} == want, key


def test_report_outputs(spark):
    rows = [item(i, "未上市公司完成A轮融资1.5亿元，客户签约并量产交付，毛利率达到45%，营收超过3亿元，同比增长80%，对标海外龙头，拥有专利与认证。",
                 claim_type=t, source_url=f"https://{h}/a{i}", published_at="2026-08-10", source_tier="")
            for i, (t, h) in enumerate([("commercial_signal", "www.gov.cn"), ("partnership_signal", "36kr.com"),
                                        ("product_signal", "qcc.com"), ("founder_signal", "leiphone.com")], 1)]
    rows += [item(9, "公司遭处罚并被诉讼", entity="乙公司", claim_type="risk_signal", stance="negative", importance=5)]
    scored = score(spark, rows, "量产 专利")
    top = S.rank_candidates(scored).orderBy("rank").collect()
    assert [r["entity"] for r in top] == ["测试公司", "乙公司"] and [r["rank"] for r in top] == [1, 2]
    first = top[0]
    assert first["stage"] == "a轮" and first["gross_margin_pct"] == 45.0 and first["tracking_stage"] == "深跟"
    assert first["fit"] == 4.0 and first["momentum_bonus"] == 3.0 and first["listed_status"] == "未上市"
    assert first["total_score"] <= first["score_cap"] and first["priority_score"] <= first["total_score"]
    assert top[1]["high_risks"] == 1 and [r["risk_type"] for r in top[1]["risks"]] == ["合规/诉讼"]
    dims = S.dimension_rows(scored).filter(F.col("entity") == "测试公司").collect()
    assert len(dims) == 9
    total = sum(r["score"] for r in dims)
    expected = round(max(0, total - first["penalty"]), 1)
    expected = round(expected + first["momentum_bonus"], 1)
    expected = round(max(0, expected - first["risk_penalty"]), 1)
    expected = round(max(0, expected - first["reliability_penalty"]), 1)
    assert abs(expected - first["pre_gate_score"]) < 0.11
    assert S.sub_dimension_rows(scored).count() == 70
    assert S.gate_rows(scored).count() >= 2


def test_gates_are_computed_once(spark):
    flags = spark.range(3).select(F.col("id").alias("entity_key"), F.lit("e").alias("entity"), F.lit(1.0).alias("pre_gate_score"), F.lit(1.0).alias("total_score"),
                                  F.filter(F.array(F.struct(F.concat(F.lit("g"), F.col("id")).alias("name"), F.lit(5).alias("cap"))), lambda g: g["name"] != "g1").alias("gates"))
    rows = S.gate_rows(flags)
    assert sorted((r["entity_key"], r["name"]) for r in rows.collect()) == [(0, "g0"), (2, "g2")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("concat(g") == 1


def test_word_groups_in_the_short_form_equal_whole_texts(spark):
    """Words are found beside long stretches of other letters just as by a pattern over the whole text."""
    groups = [*R.HIT_GROUPS.values(), *R.TEXT_FLAGS.values(), R.FINANCING_WORDS, R.RISK_WORDS, R.OBJECTIVE_CUSTOMER]
    words = sorted({w for g in groups for w in g})
    rng = random.Random(4)
    noise = ["x" * n for n in (1, 7, 8, 9, 16, 17, 18, 40)] + ["世界", "50", "前", "3", "年", "a", " ", "\n", "𝒳" * 9, "-"]
    texts = ["".join(rng.choice([rng.choice(noise), rng.choice(words), rng.choice(words)[:-1]]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "blob string").withColumn("blob_near", X.near_han("blob"))
    tests = [F.expr(E._words("blob", g)).alias(f"g{i}") for i, g in enumerate(groups)]
    for row in df.select("blob", "blob_near", *tests).collect():
        assert [row[f"g{i}"] for i in range(len(groups))] == [any(w in row["blob"] for w in g) for g in groups], row["blob"]
        assert len(row["blob_near"]) <= len(row["blob"])


def test_fact_heads_hide_no_match():
    for kind, pattern, _, _ in E.TEXT_FACTS:
        for text in ("pre-a+", "pre ipo", "seed", "c+轮", "天使轮", "约 人民币 3.5 亿美金", "20 万人民币", "valuation about 3亿元", "投后估值：2 亿元", "yoy 30%", "提升大幅增长", "毛利率 4.5%", "营收超过3万", "相比某某", "竞争对手为甲"):
            if re.search(pattern, text):
                assert any(w in text for w in E.FACT_HEADS[kind]), (kind, text)


def test_profile_reads_the_evidence_once(spark):
    """Names, counters, lists and text facts read stored rows: no word search is left in the plan of the profile."""
    plan = S.company_profile(table(spark, [item(i, "客户签约") for i in range(3)]), NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "source_title" not in plan and "quote_verified" not in plan


def test_evidence_of_one_split_is_scored_by_many_tasks(spark):
    rows = table(spark, [item(i, "客户签约") for i in range(64)]).coalesce(1)
    stored = S.company_profile(rows, NOW)
    sizes = E.entity_counters(E.normalize(E.admit(S.spread(rows, "seq")), NOW)).count(), S.spread(rows, "seq").rdd.getNumPartitions()
    assert stored.first()["n"] == 64 and sizes[0] == 1 and sizes[1] > 4


def test_facts_of_one_split_are_scored_by_many_tasks(spark):
    from factloom.plans import scores
    from factloom.plans.registry import Tables
    tables = Tables(spark, "/root/testdata/sf0.001")
    assert tables.customer.rdd.getNumPartitions() == 1
    assert scores.scored_facts(tables).select("entity_key").rdd.getNumPartitions() > 4


def test_ranking_sorts_stored_scores(spark, monkeypatch):
    """Scores are computed once, not again for the sample of the order."""
    seen = []
    monkeypatch.setattr(S, "indexed", lambda df, order, name: seen.append(df) or df.withColumn(name, F.lit(0)))
    S.rank_candidates(spark.range(3).selectExpr("id + 1 AS n"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "ExistingRDD" in plan or "LogicalRDD" in plan
