import random
from datetime import date

from pyspark.sql import functions as F

from factloom.operators import radar as R
from factloom.rules.radar import RadarRules

RULES = RadarRules(
    principles=["投早", "投硬科技"],
    core_variables=[("客户验证", ["中标", "订单", "认证"]), ("规模化与交付能力", ["量产", "交付"]), ("资本与产业资源到位", ["融资"])],
    sectors=[("半导体与光电", ["芯片", "光电", "半导体"])], confirmed_events={}, non_events=[], late_stage=[],
    entity_stopwords=["中国", "行业", "公司", "项目"], generic_entities=[], mature_entities=[], blocked_publishers=[])
SCHEMA = ("seq bigint, company string, title string, url string, published_at string, event_date string, publisher string, "
          "source_type string, discovery_only boolean, fit_tags array<string>")


def one_name(a, b):
    """Equal keys, or a key of four letters or more that gained one to four at one of its ends."""
    gained = lambda short, full: len(short) >= 4 and any(short in (full[k:], full[:len(full) - k]) for k in range(1, 5))
    return a == b or gained(a, b) or gained(b, a)


def record(seq, company, published, keyword="量产", **kw):
    row = dict(seq=seq, company=company, title=f"{company}芯片{keyword}取得新进展{seq}", url=f"https://news.example.com/{seq}",
               published_at=published, event_date=None, publisher="测试来源", source_type="google_news_rss",
               discovery_only=True, fit_tags=["投硬科技"])
    row.update(kw)
    return tuple(row.values())


def build(spark, rows, as_of="2026-07-14", rules=RULES):
    frame = spark.createDataFrame(rows, SCHEMA)
    return R.weekly_radar(frame, as_of, rules).orderBy("rank").collect()


def test_window_and_basis(spark):
    out = build(spark, [record(1, "起点光电", "2026-07-08"), record(2, "终点光电", "2026-07-14"),
                        record(3, "过早光电", "2026-07-07"), record(4, "未来光电", "2026-07-15"),
                        record(5, "实证光电", "2026-07-30", event_date="2026-07-12"), record(6, "无日光电", None)])
    assert {r["company"] for r in out} == {"起点光电", "终点光电", "实证光电"}
    basis = {r["company"]: r["date_basis"] for r in out}
    assert basis["实证光电"] == "事件发生日" and basis["起点光电"] == "以文章发布日期代替，待核实事件日"


def test_same_company_and_limit(spark):
    out = build(spark, [record(1, "星辰科技有限公司", "2026-07-10", "融资"), record(2, "星辰科技股份有限公司", "2026-07-13")])
    assert len(out) == 1 and str(out[0]["event_day"]) == "2026-07-13"
    names = ["甲芯科技", "乙芯科技", "丙芯科技", "丁芯科技", "戊芯科技", "己芯科技", "庚芯科技"]
    out = build(spark, [record(i, n, f"2026-07-{8 + i:02d}") for i, n in enumerate(names)])
    assert len(out) == 5 and [r["rank"] for r in out] == [1, 2, 3, 4, 5]
    assert all(r["evidence_level"] == "discovery_only" and r["verification_status"] == "待核实" for r in out)


def test_prefix_alias_and_late_round(spark):
    rules = RadarRules(core_variables=[("资本与产业资源到位", ["融资"])], confirmed_events={"资本与产业资源到位": ["完成.{0,16}融资"]},
                       sectors=[("半导体与光电", ["半导体"])], late_stage=["(?:C\\+?轮|D轮|Pre[- ]?IPO)"], entity_stopwords=[])
    rows = [record(1, "鉴芯半导体", "2026-08-19", title="鉴芯半导体完成天使轮融资"),
            record(2, "常州鉴芯半导体", "2026-08-19", title="常州鉴芯半导体完成天使轮融资"),
            record(3, "晚期半导体", "2026-08-19", title="晚期半导体完成C+轮融资")]
    out = build(spark, rows, "2026-08-21", rules)
    assert len(out) == 1 and out[0]["company"] == "常州鉴芯半导体"
    assert out[0]["company_aliases"] == ["常州鉴芯半导体", "鉴芯半导体"]


def test_default_rules_reject_reasons(spark):
    title = lambda t: dict(title=t, fit_tags=[])
    rows = [record(1, "", "2026-07-10", **title("甲芯半导体完成A轮融资")), record(2, "", "2026-07-10", **title("乙光电计划明年量产")),
            record(3, "", "2026-07-10", **title("某公司（600000）中标芯片订单")), record(4, "", "2026-07-10", **title("今日天气")),
            record(5, "", "2026-07-10", **title("丙半导体完成D轮融资")), record(6, "", "2026-07-10", **title("行业完成芯片融资")),
            record(7, "", "2026-07-10", **title("张三获批临床")), record(8, "", "2026-07-10", **title("丁公园餐饮完成A轮融资")),
            record(9, "", "2025-07-10", **title("x"))]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["seq"]: r["reject_reason"] for r in R.gate(frame).collect()}
    assert got[1] is None and got[2] == "not_completed" and got[3] == "stock_code" and got[4] == "core_variable"
    assert got[5] == "late_stage" and got[6] == "company" and got[7] == "weak_entity" and got[8] == "fit_tags"
    counts = {r["reason"]: r["n"] for r in R.gate_counts(frame, "2026-07-14").collect()}
    assert counts["window"] == 1 and counts["accepted"] == 1


def greedy(rows, limit):
    """The sequential rule, on rows in radar order."""
    picks = []
    for r in rows:
        if not r["company_key"] or any(r["url_key"] == p["url"] or r["title_key"] == p["title"] for p in picks):
            continue
        hit = next((p for p in picks if one_name(r["company_key"], p["key"])), None)
        if hit:
            hit["aliases"].add(r["company"])
            if len(r["company"]) > len(hit["company"]):
                hit["company"], hit["key"] = r["company"], r["company_key"]
            continue
        picks.append({"company": r["company"], "key": r["company_key"], "url": r["url_key"], "title": r["title_key"],
                      "seq": r["seq"], "aliases": {r["company"]}})
        if len(picks) >= limit:
            break
    return [(p["seq"], p["company"], sorted(p["aliases"])) for p in picks]


def test_selection_equals_the_sequential_rule(spark):
    rng = random.Random(11)
    heads, cores = ["", "常州", "上海", "新"], ["鉴芯半导", "星辰动力", "甲乙丙丁", "光子"]
    tails = ["", "体", "科技", "体科技甲", "有限公司", "公司"]
    rows = []
    for week in range(40):
        day = date(2026, 1, 1 + week % 28) if week < 28 else date(2026, 2, week - 27)
        for _ in range(rng.choice([1, 5, 40, 90])):
            seq = len(rows)
            name = rng.choice(heads) + rng.choice(cores) + rng.choice(tails)
            rows.append((day, seq, name, f"u{rng.randint(0, 25)}", f"t{rng.randint(0, 25)}", rng.randint(0, 1),
                         rng.randint(1, 3), rng.randint(1, 3), day))
    frame = spark.createDataFrame(rows, "as_of date, seq bigint, company string, url_key string, title_key string, "
                                        "rank_exact int, entity_confidence int, rank_variable int, event_day date")
    frame = frame.withColumn("company_key", R.N.radar_key("company")).withColumns({
        "discovery": F.lit(True), "event": F.lit("e"), "core_variable": F.lit("v"), "tags": F.array(F.lit("t"))})
    ordered = frame.orderBy(*R.radar_order()).collect()
    for block in (3, 64):
        got = {}
        for r in R.select_candidates(frame, 5, block).orderBy("as_of", "rank").collect():
            got.setdefault(r["as_of"], []).append((r["seq"], r["company"], sorted(r["company_aliases"])))
        want = {d: greedy([r for r in ordered if r["as_of"] == d], 5) for d in {r["as_of"] for r in ordered}}
        assert got == want


def test_alias_keys(spark):
    frame = spark.createDataFrame([("鉴芯半导体",), ("常州鉴芯半导体",), ("鉴芯半导体有限公司",), ("甲乙",), ("abcdefgh",), ("abcd",)],
                                  "company string")
    got = {(r["long_key"], r["short_key"]) for r in R.alias_keys(frame).collect()}
    assert got == {("常州鉴芯半导体", "鉴芯半导体"), ("abcdefgh", "abcd")}


def test_replay_counts_every_window(spark):
    rows = [record(1, "起点光电", "2026-07-08"), record(2, "终点光电", "2026-07-14")]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = R.weekly_radar(frame, "2026-07-20", RULES, first_as_of="2026-07-01")
    days = {(str(r["as_of"]), r["company"]) for r in out.collect()}
    assert len(days) == 14 and ("2026-07-14", "起点光电") in days and ("2026-07-15", "起点光电") not in days


def test_followups(spark):
    leads = spark.createDataFrame(
        [(1, "u1", "甲芯半导体完成A轮融资", "号", "2026-08-20T03:00:00Z", 3), (2, "u2", "甲芯半导体完成融资", "号", "2026-08-21T03:00:00Z", 1),
         (3, "u3", "丙半导体完成D轮融资", "号", "2026-08-20T03:00:00Z", 1), (4, "u4", "旧闻动力实现量产", "号", "2026-08-01T03:00:00Z", 1),
         (5, "u5", "戊光电实现量产", "号", "2026-08-19T15:00:00Z", 2)],
        "seq bigint, url string, title string, account_name string, discovered_at string, discovery_rank int")
    seeds = R.followup_seeds(leads, "2026-08-21")
    assert [(r["company"], r["url"], r["priority"]) for r in seeds.collect()] == [("甲芯半导体", "u1", 5), ("戊光电", "u5", 2)]
    news = spark.createDataFrame([(10, "独家：甲芯半导体融资细节", "n1", "2026-08-10"), (11, "甲芯半导体融资旧闻", "n2", "2026-06-10"),
                                  (12, "甲芯半导体招聘", "n3", "2026-08-10"), (13, "戊光电投产", "n4", "Thu, 20 Aug 2026 02:00:00 GMT")],
                                 "seq bigint, title string, url string, published_at string")
    hits = R.followup_news(seeds, news, "2026-08-21").collect()
    assert {(r["url"], r["seed_url"]) for r in hits} == {("n1", "u1"), ("n4", "u5")}


def test_costly_columns_are_computed_once(spark):
    leads = spark.createDataFrame([(1, "u1", "甲芯半导体完成A轮融资", "号", "2026-08-20T03:00:00Z", 3)],
                                  "seq bigint, url string, title string, account_name string, discovered_at string, discovery_rank int")
    plan = R.followup_seeds(leads, "2026-08-21")._jdf.queryExecution().optimizedPlan().toString()
    # The pattern of names before an event verb: once, for the one company of a lead.
    assert plan.count("regexp_extract_all(") <= 8


def test_accepted_equals_the_gated_rows_of_the_windows(spark):
    rows = [record(i, f"{'甲乙丙丁'[i % 4]}芯科技", f"2026-07-{1 + i % 28:02d}", ["量产", "融资", "晴天"][i % 3]) for i in range(60)] + [record(60, "", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = R.in_windows(R.gate(frame, RULES), "2026-07-09", "2026-07-16", 7)
    got = R.accepted(frame, "2026-07-09", "2026-07-16", 7, RULES)
    assert got.columns == want.columns and got.count() > 0
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_fetch_list(spark):
    cands = spark.createDataFrame([("a", "2026-08-20T00:00:00Z", 2, 1), ("a", "2026-08-21T00:00:00Z", 1, 2),
                                   ("b", "2026-08-20T00:00:00Z", 1, 3), ("c", "2026-08-20T00:00:00Z", 1, 4),
                                   ("d", "2026-08-20T00:00:00Z", 1, 5)],
                                  "url string, discovered_at string, discovery_rank int, seq bigint")
    pool = spark.createDataFrame([("b", "2026-01-01", "", 1), ("c", "2026-08-20", "text", 2), ("d", None, "", 3)],
                                 "canonical_url string, publish_time string, body string, seq bigint")
    out = {r["url"]: r["deferred"] for r in R.fetch_list(cands, pool, "2026-08-21", limit=1).collect()}
    assert out == {"a": False, "d": True}
