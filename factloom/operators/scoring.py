"""Deep report: company profile, dimension levels, confidence, penalties, gates and priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.functions.numbers import half_even
from factloom.operators import evidence as E
from factloom.operators.common import checkpointed, constant_table, indexed, settled, spread
from factloom.rules import scoring as S
from factloom.rules import text as T

c = F.col


def _flag(name: str) -> Column:
    """Whether the text of a company (its name included) has a word group."""
    return c(f"text_{name}") > 0


def _known(value: Column) -> Column:
    return F.when(value != "", value).otherwise(S.PENDING)


# -- weights --------------------------------------------------------------------------------------

def weight_rows() -> list[tuple[str, str, float]]:
    """(sector, dimension, weight) with the sector adjustments, renormalised to 100."""
    rows = []
    for sector, changes in S.SECTOR_ADJUSTMENTS.items():
        raw = {d: w * changes.get(d, 1.0) for d, w in S.DIMENSION_WEIGHTS.items()}
        rows += [(sector, d, round(w * 100.0 / sum(raw.values()), 2)) for d, w in raw.items()]
    return rows


def adjusted_weights(spark: SparkSession) -> DataFrame:
    """Weight per sector and dimension."""
    return constant_table(spark, weight_rows(), "sector_type string, dimension string, weight double")


# -- facts ----------------------------------------------------------------------------------------

def with_inferred_facts(df: DataFrame) -> DataFrame:
    """Listed status, stage, finances, rivals, exits, moat, gaps and exclusion tags of a company."""
    df = df.withColumns({f"text_{k}": F.greatest(c(f"text_{k}"), X.has_any(F.lower("entity"), w).cast("int"))
                         for k, w in S.TEXT_FLAGS.items()})
    sector = F.when(F.lit(False), "")
    for name, words in T.SECTOR_RULES:
        sector = sector.when(c(f"sector_{name}") > 0, name)
    listed = _flag("listed_words") & ~_flag("unlisted_word")
    df = df.withColumns({
        "sector_type": sector.otherwise("default"),
        "listed_status": F.when(listed, "上市公司/二级主体").when(_flag("unlisted_hints"), "未上市").otherwise("未知"),
        "stage": _known(c("latest_round")),
        "gross_margin_pct": N.percentage("gross_margin_text"),
        "estimated_revenue": _known(c("revenue_text")), "revenue_trend": _known(c("growth_text")),
        "gross_margin_estimate": _known(c("gross_margin_text")), "funding_known": _known(c("funding_total")),
        "valuation_known": _known(c("latest_valuation")),
        "comparable_exits": F.when(_flag("exit_ipo"), "公开证据提及IPO/上市锚点，说明该赛道存在一定二级承接逻辑。")
        .otherwise(S.PENDING),
        "potential_acquirers": F.when(_flag("exit_merger"), "公开材料出现产业整合或并购语境，潜在买方可能来自上下游龙头。")
        .otherwise(S.PENDING),
        "ipo_timeline": F.when(_flag("exit_ipo"), "若后续客户验证和商业化延续，理论上具备3-5年资本化窗口。")
        .otherwise(S.PENDING),
        "exit_path": F.when(_flag("exit_ipo"), "IPO优先").when(_flag("exit_merger"), "并购优先").otherwise(S.PENDING),
        "target_multiple": F.when(_flag("exit_ipo") & _flag("exit_merger"), "退出倍数需结合收入增速、毛利和稀缺性进一步校准。")
        .otherwise(S.PENDING),
        "moat_type": F.when(_flag("moat_technology"), "技术/工艺").when(_flag("moat_certificate"), "认证/准入")
        .when(_flag("moat_stickiness"), "客户粘性/平台效应").otherwise(S.PENDING),
        "moat_threats": F.when((c("hit_competitor") > 0) | (c("hit_risk") > 0), "主要威胁来自同质化竞争、价格压力和大客户验证周期。")
        .otherwise(S.PENDING),
        "rival_names": F.filter(F.transform("rivals", lambda s: F.substring(
            F.regexp_replace(s, "^[ ：:，,。；;]+|[ ：:，,。；;]+$", ""), 1, 40)), lambda s: s != ""),
    })
    rivals = F.transform("rival_names", lambda n: F.struct(
        n.alias("name"), F.concat(F.lit("公开材料提及与 "), F.substring(n, 1, 20), F.lit(" 的对比或替代关系。")).alias("comparison"),
        F.lit("具备一定差异化，但仍需补充更量化的市场份额和客户替换证据。").alias("relative_strength")))
    head = F.array(F.struct(F.lit("行业头部竞对").alias("name"), F.lit("公开证据显示存在直接竞品和同赛道头部玩家。").alias("comparison"),
                            F.lit("具备初步差异化，但格局和份额仍需进一步补证。").alias("relative_strength")))
    project_risk = F.array(F.struct(
        F.lit("交付/规模化").alias("risk_type"), F.lit("公开材料更偏项目制或定制化，规模化效率可能承压。").alias("description"),
        F.lit("中").alias("severity"), F.lit("中").alias("probability")))
    df = df.withColumns({
        "tracking_stage": F.when(_flag("abandoned"), "放弃")
        .when((c("recent_90") >= 3) & (c("hit_customer") >= 2) & (c("hit_financing") >= 1), "深跟")
        .when((c("recent_180") >= 2) & ((c("hit_customer") >= 1) | (c("hit_commercialization") >= 2)), "立项")
        .when((c("n") < 3) | (c("domains") < 2), "补证").otherwise("观察"),
        "moat_durability": F.when(c("moat_type") != S.PENDING, "公开证据显示存在一定持续性，但仍需用份额、替换率或认证周期补证护城河持久性。")
        .otherwise(S.PENDING),
        "competitors": F.when(F.size("rival_names") > 0, rivals).when(c("hit_competitor") >= 2, head)
        .otherwise(F.slice(head, 1, 0)),
        "risks": F.when((F.size("risks") == 0) & (c("hit_project") >= 2), project_risk).otherwise(c("risks")),
        "exit_anchors": X.count_meaningful("comparable_exits", "potential_acquirers", "exit_path"),
    })
    gap_tests = [
        ~X.is_meaningful("estimated_revenue"), ~X.is_meaningful("gross_margin_estimate"),
        ~X.is_meaningful("valuation_known"), c("hit_customer") < 2, c("hit_customer_depth") == 0,
        F.size("competitors") < 2, c("exit_anchors") < 2, (c("recent_180") == 0) & (c("n") > 0)]
    gaps = F.array(*[F.when(test, name) for test, name in zip(gap_tests, S.INFO_GAPS)])
    margin = c("gross_margin_pct")
    thin = F.when(margin.isNotNull() & (margin < 15), True).otherwise(_flag("thin_margin"))
    tag_tests = {
        "标准耗材型": (c("hit_consumable") >= 2) & ~_flag("consumable_offset"),
        "区域性强": _flag("regional") & ~_flag("nationwide"),
        "单一产品依赖": _flag("single_product") | ((c("hit_product") >= 3) & _flag("single_word")),
        "配套功能件型": _flag("functional_part") & ~_flag("functional_offset"),
        "工程项目型": c("hit_project") >= 2, "宽口径拼装型": c("hit_assembly") >= 2,
        "客户集中度过高": _flag("customer_concentration"), "团队经验不匹配": _flag("team_mismatch"),
        "独立客户入口弱": c("hit_channel_dependency") > c("hit_direct_entry") + 1, "利润池过薄": thin,
        "退出锚缺失": c("exit_anchors") < 2,
        "估值严重偏高": X.has_any(F.lower("valuation_known"), S.VALUATION_HIGH) | _flag("overvalued"),
        "合规/诉讼风险": _flag("compliance"), "上市公司仅作参照": F.startswith("listed_status", F.lit("上市公司")),
        "重大造假嫌疑": _flag("fraud"),
    }
    tags = F.array(*[F.when(tag_tests[name], F.struct(F.lit(name).alias("tag"), F.lit(points).alias("penalty")))
                     for name, points in S.EXCLUSIONS])
    return df.withColumns({"info_gaps": F.filter(gaps, lambda g: g.isNotNull()),
                           "penalties": F.filter(tags, lambda t: t.isNotNull())})


# -- levels ---------------------------------------------------------------------------------------

def _cases(default: int, *cases: tuple[int, str]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for value, test in cases) + f" ELSE {default} END"


def _ladder(value: str, *limits: float) -> str:
    return _cases(1, *[(i, f"{value} >= {limit}") for i, limit in reversed(list(enumerate(limits, 2)))])


def sub_levels() -> dict[str, str]:
    """SQL of the level 1 to 5 of every sub-dimension."""
    pending, flag = X.sql_text(S.PENDING), lambda name: f"text_{name} > 0"
    return {
        "policy_catalyst": _ladder("hit_policy", 1, 2, 3, 4),
        "demand_expansion": _ladder("hit_customer + hit_commercialization", 1, 2, 4, 6),
        "penetration_rate": _cases(2, (4, flag("penetration")), (3, "hit_product >= 2")),
        "industry_cycle": _cases(2, (4, "recent_180 >= 3 AND hit_policy + hit_financing >= 2"), (3, "recent_180 >= 1")),
        "value_chain_pos": _cases(2, (5, flag("core_value")), (3, flag("mid_value"))),
        "pricing_power": _cases(2, (4, flag("pricing")), (3, "hit_benchmark > 0 OR hit_customer_depth > 0")),
        "gross_margin": _cases(
            1, (5, "gross_margin_pct >= 50"), (4, "gross_margin_pct >= 40"), (3, "gross_margin_pct >= 25"),
            (2, "gross_margin_pct >= 15"), (1, "gross_margin_pct IS NOT NULL"),
            (4, "gross_margin_estimate RLIKE '55%-80%|高毛利'"), (3, f"gross_margin_estimate <> {pending}")),
        "aftermarket": _ladder("hit_aftermarket", 1, 2, 3, 4),
        "tech_barrier": _ladder("hit_moat + hit_research", 1, 2, 4, 6),
        "certification": _ladder("hit_certification", 1, 2, 3, 4),
        "process_knowhow": _cases(2, (4, flag("process")), (3, "hit_commercialization >= 2")),
        "import_sub": _cases(2, (5, flag("localisation")), (3, flag("import_replacement"))),
        "benchmark_client": _ladder("hit_benchmark + hit_customer", 1, 2, 3, 5),
        "adoption_depth": _cases(2, (5, "hit_customer_depth >= 2"), (4, "hit_customer_depth >= 1"),
                                 (3, "hit_customer >= 2")),
        "repurchase": _ladder("hit_customer_depth", 1, 1.5, 2, 3),
        "cross_industry": _cases(2, (4, "hit_cross_industry >= 3"), (3, "hit_cross_industry >= 1")),
        "mass_production": _ladder("hit_mass_production", 1, 2, 3, 4),
        "order_conversion": _ladder("hit_order", 1, 2, 3, 4),
        "channel_build": _cases(2, (4, flag("channels")), (3, "hit_platform >= 1")),
        "scale_efficiency": _cases(2, (4, "lower(revenue_trend) RLIKE '翻倍|>80%|增长|yoy'"),
                                   (3, "hit_commercialization >= 2")),
        "round_match": "stage_level",
        "valuation": _cases(2, (4, f"valuation_known <> {pending}")),
        "equity_structure": _cases(2, (4, flag("equity"))),
        "timing_window": _cases(2, (5, "hit_financing >= 2 AND hit_financing_close >= 1"), (3, "hit_financing >= 1")),
        "ipo_comparable": _cases(2, (4, flag("ipo_comparable"))),
        "ma_appetite": _cases(2, (4, flag("merger_comparable"))),
        "exit_timeline": _cases(2, (4, flag("exit_timeline"))),
        "buyer_density": _cases(2, (4, flag("buyers"))),
        "differentiation": _ladder("hit_competitor + hit_moat", 1, 2, 3, 5),
        "market_position": _cases(2, (5, flag("market_first")), (4, flag("market_leading")), (3, "hit_competitor > 0")),
        "customer_mindshare": _cases(2, (4, "hit_benchmark >= 1 OR hit_customer_depth >= 1"), (3, "hit_customer >= 2")),
        "platform_extension": _cases(2, (4, "hit_platform >= 2"), (3, "hit_platform >= 1")),
        "public_evidence": _ladder("n + recent_180", 2, 4, 6, 8),
        "cross_validation_level": _ladder("domains + authoritative", 2, 3, 5, 7),
        "info_consistency": _cases(2, (5, "negatives = 0 AND traceability_score >= 70"),
                                   (4, "traceability_score >= 55"), (3, "traceability_score >= 35")),
    }


# The sub-dimension named like an evidence score has its own column name.
_SUB_COLUMN = {"cross_validation": "cross_validation_level"}


def _sub(name: str) -> str:
    return f"sub_{_SUB_COLUMN.get(name, name)}"


def objective_levels() -> dict[str, str]:
    """SQL of the levels that follow from evidence alone."""
    weighted = "(recent_90 * 2.0D + (recent_180 - recent_90) * 1.5D + (n - recent_180) * 0.5D)"
    info = _cases(
        0, (5, f"{weighted} >= 12 AND domains >= 5 AND recent_90 >= 3 AND traceability_score >= 75 AND authority >= 65"),
        (4, f"{weighted} >= 8 AND domains >= 4 AND recent_180 >= 3 AND traceability_score >= 55"),
        (3, f"{weighted} >= 5 AND domains >= 3 AND traceable >= 2"), (2, f"{weighted} >= 2 AND domains >= 2"),
        (1, "n >= 1"))
    info = f"least({info}, CASE WHEN recent_180 = 0 AND n > 0 THEN 3 ELSE 5 END)"
    info = f"least({info}, CASE WHEN social_ratio >= 0.75 AND authoritative = 0 THEN 2 ELSE 5 END)"
    # The reason why a company was selected is always stated, so the moat count starts at one.
    moat = "(known_moats + 1)"
    signals = ("(known_finances + objective_commercial"
               " + int(lower(revenue_trend) RLIKE '增长|翻倍|上升|>50%|>80%|yoy'))")
    return {
        "information_sufficiency": info,
        "exit_feasibility": _cases(1, (5, "known_exits >= 5 AND core_exit"), (4, "known_exits >= 4 AND core_exit"),
                                   (3, "known_exits >= 3"), (2, "known_exits >= 2")),
        "competitive_position": _cases(2, (5, f"size(competitors) >= 3 AND {moat} >= 3"),
                                       (4, f"size(competitors) >= 2 AND {moat} >= 2"),
                                       (3, f"size(competitors) >= 1 AND {moat} >= 1")),
        "customer_validation": _cases(
            1, (5, "objective_customer >= 4 AND objective_depth >= 2 AND authoritative >= 2"),
            (4, "objective_customer >= 3 AND objective_depth >= 1"), (3, "objective_customer >= 2"),
            (2, "objective_customer >= 1")),
        "commercialization_progress": _cases(1, (5, f"{signals} >= 7 AND traceability_score >= 60"),
                                             (4, f"{signals} >= 5"), (3, f"{signals} >= 3"), (2, f"{signals} >= 2")),
        "investability": _cases(
            1, (0, "NOT contains(listed_status, '未上市')"),
            (5, "stage_level >= 4 AND known_money >= 3 AND traceability_score >= 55"),
            (4, "stage_level >= 4 AND known_money >= 2"), (3, "stage_level >= 3 AND known_money >= 1"),
            (2, "stage_level >= 2")),
    }


def confidence_score(d: str) -> str:
    """SQL of the confidence score of a dimension: its own support and a little global reliability."""
    local = (f"least({d}__n, 4) * 8 + least({d}__domains, 4) * 9 + least({d}__authoritative_strict, 3) * 7"
             f" + least({d}__verified, 3) * 6 + least({d}__recent_180, 3) * 4 + least({d}__corroborated, 2) * 8")
    caps = (f"CASE WHEN {d}__n = 1 OR {d}__domains = 1 THEN 49.0D ELSE 100.0D END, "
            f"CASE WHEN {d}__authoritative_strict = 0 THEN 64.0D ELSE 100.0D END, "
            f"CASE WHEN {d}__social = {d}__n AND {d}__authoritative_strict = 0 THEN 34.0D ELSE 100.0D END")
    return f"least(({local}) * 0.80D + reliability * 0.20D, {caps})"


def with_dimension_scores(df: DataFrame) -> DataFrame:
    """Model, objective and final level, confidence and score of every dimension."""
    df = df.withColumns({
        "stage_level": N.stage_fit("stage"),
        "known_exits": X.count_meaningful("comparable_exits", "potential_acquirers", "ipo_timeline", "target_multiple",
                                          "exit_path"),
        "core_exit": X.is_meaningful("comparable_exits") & X.is_meaningful("potential_acquirers"),
        "known_moats": X.count_meaningful("moat_type", "moat_durability", "moat_threats"),
        "known_finances": X.count_meaningful("estimated_revenue", "revenue_trend", "gross_margin_estimate", "stage"),
        "known_money": X.count_meaningful("stage", "valuation_known", "funding_known"),
    })
    keep = ["*"]
    df = df.selectExpr(*keep, *[f"{v} AS sub_{k}" for k, v in sub_levels().items()],
                       *[f"{v} AS {d}__objective" for d, v in objective_levels().items()])
    models = {d: " + ".join(f"{_sub(k)} * {w}" for k, _, w in S.SUB_DIMENSIONS[d]) for d in S.DIMENSION_KEYS}
    df = df.selectExpr(*keep, *[f"int(bround(({m}) / 100.0D)) AS {d}__model" for d, m in models.items()],
                       *[f"{confidence_score(d)} AS {d}__confidence_score" for d in S.DIMENSION_KEYS])
    levels = []
    for d in S.DIMENSION_KEYS:
        out, goal = f"{d}__model", f"{d}__objective"
        if d in S.MODEL_WEIGHTS:
            w = S.MODEL_WEIGHTS[d]
            out = f"greatest(0, least(5, int(bround({d}__model * {w}D + {goal} * {1 - w}D))))"
            if d in S.DISCIPLINED:
                out = f"least({out}, CASE WHEN {d}__model - {goal} >= 2 THEN {goal} + 1 ELSE 5 END)"
        label = " ".join(f"WHEN {d}__confidence_score >= {t} THEN '{n}'" for t, n in S.CONFIDENCE_BUCKETS)
        weight = " ".join(f"WHEN '{s}' THEN {w}D" for s, x, w in weight_rows() if x == d)
        levels += [f"{out} AS {d}__level", f"CASE sector_type {weight} END AS {d}__weight",
                   f"CASE WHEN {d}__n = 0 THEN 'low' {label} ELSE '{S.CONFIDENCE_DEFAULT}' END AS {d}__confidence"]
    df = df.selectExpr(*keep, *levels)
    factor = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in S.CONFIDENCE_FACTOR.items())
    return df.selectExpr(*keep, *[
        f"bround(bround({d}__weight * {d}__level / 5.0D, 2) * CASE {d}__confidence {factor} END, 2) AS {d}__score"
        for d in S.DIMENSION_KEYS])


def _total(keys: list[str]) -> Column:
    return F.expr(" + ".join(f"{d}__score" for d in keys))


def gate_tests() -> list[tuple[str, float, Column]]:
    """Hard gates in order: name, cap and when they apply."""
    any_rows = c("n") > 0
    finance = X.count_meaningful("estimated_revenue", "revenue_trend", "gross_margin_estimate")
    tests = [
        ~F.contains("listed_status", F.lit("未上市")), (c("n") < 3) | (c("domains") < 2),
        (c("official") == 0) & (c("authoritative") < 2) & any_rows,
        (c("social_ratio") >= 0.60) & (c("official") == 0), (c("chain") < 45) & any_rows,
        F.size("info_gaps") >= 5, finance == 0, c("exit_anchors") < 2, F.size("competitors") < 2,
        (c("recent_180") == 0) & any_rows, c("tracking_stage") == "放弃"]
    return [(name, cap, test) for (name, cap), test in zip(S.GATES, tests)]


def with_total_score(df: DataFrame) -> DataFrame:
    """Penalties, momentum, risk, reliability, gates, total, confidence and priority of a company."""
    def floor0(v: Column) -> Column:
        return half_even(F.greatest(F.lit(0.0), v), 1)

    count = lambda s: F.size(F.filter("risks", lambda r: r["severity"] == s))
    risk_level = X.constant_map(S.RISK_LEVELS)
    pressure = F.aggregate("risks", F.lit(0), lambda a, r: a + F.element_at(risk_level, r["severity"])
                           * F.element_at(risk_level, r["probability"]))
    points = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in S.CONFIDENCE_INDEX.items())
    index = " + ".join(f"CASE {d}__confidence {points} END" for d in S.DIMENSION_KEYS)
    gates = F.filter(F.array(*[F.when(test, F.struct(F.lit(n).alias("name"), F.lit(cap).alias("cap")))
                               for n, cap, test in gate_tests()]), lambda g: g.isNotNull())
    df = df.withColumns({
        "penalty": F.least(F.lit(25), F.aggregate("penalties", F.lit(0), lambda a, t: a + t["penalty"])),
        "momentum_bonus": half_even(F.least(F.lit(3.0), c("momentum_tenths") / 10.0), 1),
        "high_risks": count("高"), "medium_risks": count("中"), "low_risks": count("低"), "weighted_risk": pressure,
        "confidence_score": F.expr(f"bround(({index}) / {len(S.DIMENSION_KEYS)}, 1)"),
        "static_score": half_even(_total(["sector_prosperity", "profit_pool", "high_end_attribute",
                                          "competitive_position"]), 1),
        "dynamic_score": half_even(_total(["customer_validation", "commercialization_progress",
                                           "information_sufficiency"]), 1),
        "deal_score": half_even(_total(["investability", "exit_feasibility"]), 1),
        "total_possible": F.expr("bround(" + " + ".join(f"{d}__weight" for d in S.DIMENSION_KEYS) + ", 1)"),
        "gates": gates,
    })
    df = df.withColumns({
        "risk_penalty": half_even(F.least(F.lit(10.0), c("high_risks") * 2.5 + c("medium_risks") * 1.0
                                          + c("low_risks") * 0.3), 1),
        "risk_pressure": half_even(F.least(F.lit(100.0), c("weighted_risk") * 5 + c("penalty") * 2.5), 1),
        "reliability_penalty": half_even(F.least(F.lit(8.0), F.greatest(
            F.lit(0.0), (62.0 - F.least("reliability", "chain")) / 6.5)), 1),
        "score_cap": F.coalesce(F.array_min(F.transform("gates", lambda g: g["cap"])), F.lit(100.0)),
    })
    df = df.withColumn("_t", floor0(_total(S.DIMENSION_KEYS) - c("penalty")))
    df = df.withColumn("_t", half_even(c("_t") + c("momentum_bonus"), 1))
    df = df.withColumn("_t", floor0(c("_t") - c("risk_penalty")))
    df = df.withColumn("pre_gate_score", floor0(c("_t") - c("reliability_penalty"))).drop("_t")
    tracking = X.constant_map(S.TRACKING_SIGNAL)
    df = df.withColumns({
        "total_score": half_even(F.least("pre_gate_score", "score_cap"), 1),
        "execution_readiness": half_even(F.least(F.lit(100.0), (
            F.element_at(tracking, c("tracking_stage")) * 0.30 + c("investability__level") / 5.0 * 25
            + c("customer_validation__level") / 5.0 * 20 + c("commercialization_progress__level") / 5.0 * 15
            + F.least(c("momentum_bonus") / 3.0, F.lit(1.0)) * 10)), 1),
        "data_quality": half_even(F.least(F.lit(100.0), (
            c("confidence_score") * 0.24 + c("strength") * 0.18 + c("reliability") * 0.34
            + F.greatest(F.lit(0), 100 - F.size("info_gaps") * 10) * 0.15
            + F.least(c("recent_90") * 15, F.lit(100)) * 0.09)), 1),
    })
    return df.withColumns({
        "score_pct": half_even(c("total_score") / c("total_possible") * 100, 1),
        "score_bucket": N.score_bucket(c("total_score")), "score_grade": N.score_grade(c("total_score")),
        "priority_score": half_even(c("total_score") * half_even(0.55 + 0.45 * c("confidence_score") / 100.0, 4), 1),
    })


def with_breakdown(df: DataFrame, topic: str) -> DataFrame:
    """Score groups for display, and the top and bottom three dimensions."""
    hits = sum((c(f"topic_{i}") for i in range(len(E.topic_words(topic)))), F.lit(0))
    groups = {"demand": ["sector_prosperity", "profit_pool"],
              "traction": ["customer_validation", "commercialization_progress"],
              "team": ["high_end_attribute", "competitive_position"],
              "timing": ["investability", "exit_feasibility"], "proof": ["information_sufficiency"]}
    dims = F.array(*[F.struct(c(f"{d}__level").alias("level"), c(f"{d}__score").alias("score"),
                              F.lit(S.DIMENSION_LABELS[d]).alias("label")) for d in S.DIMENSION_KEYS])
    upward = F.array_sort(F.transform(dims, lambda d: F.struct(d["level"], d["score"], d["label"])))
    downward = F.array_sort(F.transform(dims, lambda d: F.struct(-d["level"], -d["score"], d["label"])))
    labels = lambda a: F.transform(F.slice(a, 1, 3), lambda d: d["label"])
    df = df.withColumns({
        **{k: half_even(_total(v), 1) for k, v in groups.items()},
        "fit": half_even(X.word_overlap_score(topic, hits), 1),
        "deductions": half_even(c("risk_penalty") + c("penalty") + c("reliability_penalty"), 1),
        "strengths": labels(downward), "watchouts": labels(upward)})
    # A fixed text: the one-line summary of a candidate.
    return df.withColumn("summary", F.format_string(
        "%s：%s，%d条证据/%d个域名，近180天%d条，官方/数据库锚点%d条；优势在%s，短板在%s。", c("entity"), c("score_bucket"),
        c("n"), c("domains"), c("recent_180"), c("official"), F.array_join(F.slice("strengths", 1, 2), "、"),
        F.array_join(F.slice("watchouts", 1, 2), "、")))


def company_profile(evidence: DataFrame, now: int, topic: str = "", strict: bool = False) -> DataFrame:
    """One wide row per company: counters, scores of its evidence and inferred facts."""
    items = E.normalize(E.admit(spread(evidence, "seq"), strict), now)
    # Stored, as names, counters, lists and text facts read it: the texts are searched once.
    items = checkpointed(E.counter_rows(items, topic, ["entity", "seq", "importance", "age", "profile_text", E.evidence_roles().alias("roles")]))
    names = E.entity_names(items)
    counters = E.with_evidence_scores(E.summed_counters(items, topic))
    df = counters.join(names.select("entity_key", "entity", "alias_count"), "entity_key")
    df = df.join(E.leading_evidence(items), "entity_key", "left").join(E.text_facts(items, names), "entity_key", "left")
    blanks = {k: F.coalesce(c(k), F.lit("")) for k in ["latest_round", "funding_total", "latest_valuation",
                                                        "gross_margin_text", "revenue_text", "growth_text"]}
    empty_risks = F.array().cast("array<struct<risk_type:string,description:string,severity:string,probability:string>>")
    return with_inferred_facts(df.withColumns({
        **blanks, "rivals": F.coalesce("rivals", F.array().cast("array<string>")),
        "risks": F.coalesce("risks", empty_risks),
        "momentum_signals": F.coalesce("momentum_signals", F.array().cast("array<string>"))}))


def score_companies(evidence: DataFrame, now: int, topic: str = "", strict: bool = False) -> DataFrame:
    """Deep report: one wide scored row per company.  The topic never moves a score."""
    profile = company_profile(evidence, now, topic, strict)
    return with_breakdown(with_total_score(with_dimension_scores(profile)), topic)


REPORT_COLUMNS = [
    "entity_key", "entity", "summary", "n", "total_score", "pre_gate_score", "score_cap", "score_bucket",
    "score_grade", "score_pct", "confidence_score", "priority_score", "penalty", "momentum_bonus", "risk_penalty",
    "reliability_penalty", "risk_pressure", "execution_readiness", "data_quality", "static_score", "dynamic_score",
    "deal_score", "demand", "traction", "team", "timing", "proof", "fit", "deductions", "sector_type",
    "listed_status", "tracking_stage", "stage", "reliability", "chain", "strength", "freshness",
    "traceability_score", "authority", "cross_validation", "social_ratio", "strengths", "watchouts", "gates",
    "penalties", "risks", "momentum_signals", "info_gaps", "competitors", "high_risks", "medium_risks", "low_risks"]


def report_order() -> list[Column]:
    """Order of candidates: priority, confidence, evidence; then the key, so that it is total."""
    return [F.desc("priority_score"), F.desc("confidence_score"), F.desc("n"), F.asc("entity_key")]


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Add the exact report rank (from 1).  Scores are stored first, as sampling the order and sorting each read them."""
    return indexed(checkpointed(scored), report_order(), "rank").withColumn("rank", c("rank") + 1)


def dimension_rows(scored: DataFrame) -> DataFrame:
    """One row per company and dimension."""
    rows = F.array(*[F.struct(
        F.lit(d).alias("dimension"), F.lit(S.DIMENSION_LABELS[d]).alias("label"), c(f"{d}__weight").alias("weight"),
        c(f"{d}__model").alias("model_level"),
        (c(f"{d}__objective") if d in S.MODEL_WEIGHTS else F.lit(None).cast("int")).alias("objective_level"),
        c(f"{d}__level").alias("level"), c(f"{d}__confidence").alias("confidence"), c(f"{d}__score").alias("score"),
        c(f"{d}__n").alias("support"), E.support_score(d).alias("support_score")) for d in S.DIMENSION_KEYS])
    return scored.select("entity_key", "entity", F.inline(rows))


def sub_dimension_rows(scored: DataFrame) -> DataFrame:
    """One row per company and sub-dimension."""
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("sub_dimension"), F.lit(label).alias("label"),
                              F.lit(w).alias("weight_pct"), c(_sub(k)).alias("level"))
                     for d in S.DIMENSION_KEYS for k, label, w in S.SUB_DIMENSIONS[d]])
    return scored.select("entity_key", "entity", F.inline(rows))


def gate_rows(scored: DataFrame) -> DataFrame:
    """One row per company and hard gate it hits."""
    columns = ["entity_key", "entity", "pre_gate_score", "total_score"]
    # Settled, else the filter of empty arrays computes all gates once more below.
    return settled(scored.select(*columns, "gates"), "gates").select(*columns, F.inline("gates"))
