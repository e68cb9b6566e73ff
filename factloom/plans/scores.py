"""Queries of the scoring chain on company facts that vary so that all levels, gates and penalties occur.

The facts are derived from the customers; the twins restate the rules in SQL, long-form, from the base constants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import evidence as E
from factloom.operators import scoring as S
from factloom.operators.common import spread
from factloom.plans.registry import DERIVED, Tables, query
from factloom.rules import scoring as R
from factloom.rules import text as T

c = F.col
_COUNTS = [*[f"hit_{g}" for g in R.HIT_GROUPS], "hit_financing", "hit_financing_close", "hit_risk", "objective_customer", "objective_depth", "objective_commercial"]
_DIMENSION_COUNTS = ["n", "domains", "authoritative_strict", "verified", "recent_180", "corroborated"]


def _spread(i: int, most: int) -> str:
    """A whole number from 0 to ``most`` that goes its own way through the customers."""
    return f"CAST((c_custkey * {2 * i + 3} + {7 * i + 1} + CAST(floor(c_custkey / {i % 5 + 2}) AS BIGINT)) % {most + 1} AS INT)"


#: Every fourth company is a strong one: well covered, with most good signs and none of the bad ones.
_STRONG = "c_custkey % 4 = 0"
_BAD_FLAGS = ["listed_words", "abandoned", "regional", "single_product", "single_word", "functional_part", "customer_concentration", "team_mismatch", "thin_margin", "overvalued", "compliance", "fraud"]
_BAD_COUNTS = ["hit_project", "hit_assembly", "hit_consumable", "hit_channel_dependency", "hit_risk"]


def _either(strong: str, other: str) -> str:
    return f"CASE WHEN {_STRONG} THEN {strong} ELSE {other} END"


def _facts_sql() -> str:
    counts = [f"{_either('0' if name in _BAD_COUNTS else f'2 + {_spread(i, 4)}', _spread(i, 5))} AS {name}" for i, name in enumerate(_COUNTS)]
    sign = lambda i, few: f"CASE WHEN {_spread(i, 30)} < {few} THEN 1 ELSE 0 END"
    flags = [f"{_either('0' if name in _BAD_FLAGS else sign(i, 24), sign(i, [9, 5, 14][i % 3]))} AS text_{name}" for i, name in enumerate(R.TEXT_FLAGS, 40)]
    sectors = [f"CASE WHEN {_spread(i, 12)} = 0 THEN 1 ELSE 0 END AS sector_{name}" for i, (name, _) in enumerate(T.SECTOR_RULES, 5)]
    rows = [f"{_either('2', '0')} + {_spread(i + 9 * j, 5 if name == 'n' else 4)} AS {d}__{name}" for i, d in enumerate(R.DIMENSION_KEYS) for j, name in enumerate(_DIMENSION_COUNTS)]
    social = [f"CASE WHEN {_spread(i, 3)} = 0 THEN {_spread(i, 5)} ELSE 0 END AS {d}__social" for i, d in enumerate(R.DIMENSION_KEYS)]
    tenths = [f"{_either(f'70 + CAST({_spread(i, 300)} AS DOUBLE) / 10', f'CAST({_spread(i, 1000)} AS DOUBLE) / 10')} AS {name}"
              for i, name in enumerate(["traceability_score", "authority", "reliability", "chain", "strength"], 70)]
    text = lambda name, i, *values: f"split_part('{'|'.join(values)}', '|', {_spread(i, len(values) - 1)} + 1) AS {name}"
    texts = [text("latest_round", 80, "", "种子轮", "天使轮", "pre-a轮", "a轮", "b轮", "c轮", "d轮", "pre-ipo", "成长期", "seed"),
             text("gross_margin_text", 81, "", "毛利率45%", "毛利率12.5%", "毛利率20%", "毛利率61%", "毛利率30%", "高毛利", "毛利稳定", "毛利率3%"),
             text("revenue_text", 82, "", "营收3亿", "", "营收5000万"), text("growth_text", 83, "", "同比增长30%", "翻倍", "提升3%", ""),
             text("funding_total", 84, "", "1亿元", "2亿美元"), text("latest_valuation", 85, "", "10亿元", "估值过高", "30x", ""),
             text("rival_text", 86, "", "甲公司", "甲公司，;乙公司", "：;丙;丁;戊", "")]
    return f"""
        SELECT concat('c', CAST(c_custkey AS STRING)) AS entity_key, concat('公司', CAST(c_custkey AS STRING)) AS entity, n, least(n, {_either(f"3 + {_spread(61, 4)}", _spread(61, 6))}) AS domains, least(n, {_spread(62, 5)}) AS recent_90,
          least(n, {_spread(62, 5)} + {_spread(63, 4)}) AS recent_180, least(n, {_spread(64, 4)}) AS authoritative, least(n, {_spread(65, 2)}) AS official, least(n, {_spread(66, 6)}) AS traceable,
          least(n, {_either("0", _spread(67, 2))}) AS negatives, CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(least(n, {_either(_spread(68, 2), _spread(68, 9))}) AS DOUBLE) / n END AS social_ratio,
          {_spread(69, 45)} AS momentum_tenths, {_either("0", _spread(75, 3))} AS highs, {_either("0", _spread(76, 2))} AS mediums, {_spread(77, 3)} AS lows, {', '.join(counts + flags + sectors + rows + social + tenths + texts)}
        FROM (SELECT *, {_either(f"4 + {_spread(60, 5)}", _spread(60, 9))} AS n FROM {{customer}}) x"""


DERIVED["company_facts"] = _facts_sql()


def scored_facts(t: Tables) -> DataFrame:
    """The chain from company facts to scores."""
    risk = lambda severity, probability, n: F.array_repeat(F.struct(
        F.lit("类").alias("risk_type"), F.lit("述").alias("description"), F.lit(severity).alias("severity"), F.lit(probability).alias("probability")), c(n))
    # Only their keys are dealt; all facts of a customer follow from its key.
    customers = spread(t.customer.select("c_custkey"), "c_custkey")
    facts = t.spark.sql(DERIVED["company_facts"], customer=customers).withColumns({
        "rivals": F.filter(F.split("rival_text", ";"), lambda x: x != ""), "risks": F.concat(risk("高", "高", "highs"), risk("中", "中", "mediums"), risk("低", "中", "lows")),
        "momentum_signals": F.array().cast("array<string>"), "core_product": F.lit("")})
    return S.with_breakdown(S.with_total_score(S.with_dimension_scores(S.with_inferred_facts(facts))), "")


# -- twins ------------------------------------------------------------------------------------------

def _even(x: str, digits: int) -> str:
    """Half-even rounding of the decimal text of a number."""
    ten = 10 ** digits
    return (f"(list_transform([CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 18)) * {ten}], lambda v: floor(v) + "
            f"CASE WHEN v - floor(v) > 0.5 OR (v - floor(v) = 0.5 AND floor(v) % 2 = 1) THEN 1 ELSE 0 END)[1]::DOUBLE / {ten})")


def _steps(value: str, two: float, three: float, four: float, five: float) -> str:
    return f"CASE WHEN {value} >= {five} THEN 5 WHEN {value} >= {four} THEN 4 WHEN {value} >= {three} THEN 3 WHEN {value} >= {two} THEN 2 ELSE 1 END"


def _when(*cases: tuple[str, int | str]) -> str:
    """CASE of (test, value); the last one is the default."""
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in cases[:-1]) + f" ELSE {cases[-1][1]} END"


_KNOWN = lambda name: f"{name} <> '{R.PENDING}'"
_SUBS = {
    "policy_catalyst": _steps("hit_policy", 1, 2, 3, 4), "demand_expansion": _steps("hit_customer + hit_commercialization", 1, 2, 4, 6),
    "penetration_rate": _when(("text_penetration = 1", 4), ("hit_product >= 2", 3), ("", 2)),
    "industry_cycle": _when(("recent_180 >= 3 AND hit_policy + hit_financing >= 2", 4), ("recent_180 >= 1", 3), ("", 2)),
    "value_chain_pos": _when(("text_core_value = 1", 5), ("text_mid_value = 1", 3), ("", 2)),
    "pricing_power": _when(("text_pricing = 1", 4), ("hit_benchmark > 0 OR hit_customer_depth > 0", 3), ("", 2)),
    "gross_margin": _when(("pct IS NOT NULL", _steps("pct", 15, 25, 40, 50)), ("regexp_matches(margin, '55%-80%|高毛利')", 4), (_KNOWN("margin"), 3), ("", 1)),
    "aftermarket": _steps("hit_aftermarket", 1, 2, 3, 4), "tech_barrier": _steps("hit_moat + hit_research", 1, 2, 4, 6), "certification": _steps("hit_certification", 1, 2, 3, 4),
    "process_knowhow": _when(("text_process = 1", 4), ("hit_commercialization >= 2", 3), ("", 2)),
    "import_sub": _when(("text_localisation = 1", 5), ("text_import_replacement = 1", 3), ("", 2)),
    "benchmark_client": _steps("hit_benchmark + hit_customer", 1, 2, 3, 5),
    "adoption_depth": _when(("hit_customer_depth >= 2", 5), ("hit_customer_depth = 1", 4), ("hit_customer >= 2", 3), ("", 2)),
    "repurchase": _steps("hit_customer_depth", 1, 1.5, 2, 3), "cross_industry": _when(("hit_cross_industry >= 3", 4), ("hit_cross_industry >= 1", 3), ("", 2)),
    "mass_production": _steps("hit_mass_production", 1, 2, 3, 4), "order_conversion": _steps("hit_order", 1, 2, 3, 4),
    "channel_build": _when(("text_channels = 1", 4), ("hit_platform >= 1", 3), ("", 2)),
    "scale_efficiency": _when(("regexp_matches(lower(trend), '翻倍|>80%|增长|yoy')", 4), ("hit_commercialization >= 2", 3), ("", 2)),
    "round_match": "stage_level", "valuation": _when((_KNOWN("valued"), 4), ("", 2)), "equity_structure": _when(("text_equity = 1", 4), ("", 2)),
    "timing_window": _when(("hit_financing >= 2 AND hit_financing_close >= 1", 5), ("hit_financing >= 1", 3), ("", 2)),
    "ipo_comparable": _when(("text_ipo_comparable = 1", 4), ("", 2)), "ma_appetite": _when(("text_merger_comparable = 1", 4), ("", 2)),
    "exit_timeline": _when(("text_exit_timeline = 1", 4), ("", 2)), "buyer_density": _when(("text_buyers = 1", 4), ("", 2)),
    "differentiation": _steps("hit_competitor + hit_moat", 1, 2, 3, 5),
    "market_position": _when(("text_market_first = 1", 5), ("text_market_leading = 1", 4), ("hit_competitor > 0", 3), ("", 2)),
    "customer_mindshare": _when(("hit_benchmark >= 1 OR hit_customer_depth >= 1", 4), ("hit_customer >= 2", 3), ("", 2)),
    "platform_extension": _when(("hit_platform >= 2", 4), ("hit_platform = 1", 3), ("", 2)),
    "public_evidence": _steps("n + recent_180", 2, 4, 6, 8), "cross_validation": _steps("domains + authoritative", 2, 3, 5, 7),
    "info_consistency": _when(("negatives = 0 AND traceability_score >= 70", 5), ("traceability_score >= 55", 4), ("traceability_score >= 35", 3), ("", 2)),
}
_AGE = "(recent_90 * 2e0 + (recent_180 - recent_90) * 1.5e0 + (n - recent_180) * 0.5e0)"
_SIGNALS = "(finances + objective_commercial + CASE WHEN regexp_matches(lower(trend), '增长|翻倍|上升|>50%|>80%|yoy') THEN 1 ELSE 0 END)"
_GOALS = {
    "information_sufficiency": "least(" + _when(
        (f"{_AGE} >= 12 AND domains >= 5 AND recent_90 >= 3 AND traceability_score >= 75 AND authority >= 65", 5), (f"{_AGE} >= 8 AND domains >= 4 AND recent_180 >= 3 AND traceability_score >= 55", 4),
        (f"{_AGE} >= 5 AND domains >= 3 AND traceable >= 2", 3), (f"{_AGE} >= 2 AND domains >= 2", 2), ("n >= 1", 1), ("", 0))
        + ", CASE WHEN recent_180 = 0 AND n > 0 THEN 3 ELSE 5 END, CASE WHEN social_ratio >= 0.75 AND authoritative = 0 THEN 2 ELSE 5 END)",
    "exit_feasibility": _when(("exits >= 5 AND ipo + merger = 2", 5), ("exits >= 4 AND ipo + merger = 2", 4), ("exits >= 3", 3), ("exits >= 2", 2), ("", 1)),
    "competitive_position": _when(("rivals >= 3 AND moats >= 2", 5), ("rivals >= 2 AND moats >= 1", 4), ("rivals >= 1", 3), ("", 2)),
    "customer_validation": _when(("objective_customer >= 4 AND objective_depth >= 2 AND authoritative >= 2", 5), ("objective_customer >= 3 AND objective_depth >= 1", 4), ("objective_customer >= 2", 3),
                                 ("objective_customer >= 1", 2), ("", 1)),
    "commercialization_progress": _when((f"{_SIGNALS} >= 7 AND traceability_score >= 60", 5), (f"{_SIGNALS} >= 5", 4), (f"{_SIGNALS} >= 3", 3), (f"{_SIGNALS} >= 2", 2), ("", 1)),
    "investability": _when(("NOT contains(listed, '未上市')", 0), ("stage_level >= 4 AND money >= 3 AND traceability_score >= 55", 5), ("stage_level >= 4 AND money >= 2", 4),
                           ("stage_level >= 3 AND money >= 1", 3), ("stage_level >= 2", 2), ("", 1)),
}
_TAGS = {
    "标准耗材型": "hit_consumable >= 2 AND text_consumable_offset = 0", "区域性强": "text_regional = 1 AND text_nationwide = 0",
    "单一产品依赖": "text_single_product = 1 OR (hit_product >= 3 AND text_single_word = 1)", "配套功能件型": "text_functional_part = 1 AND text_functional_offset = 0",
    "工程项目型": "hit_project >= 2", "宽口径拼装型": "hit_assembly >= 2", "客户集中度过高": "text_customer_concentration = 1", "团队经验不匹配": "text_team_mismatch = 1",
    "独立客户入口弱": "hit_channel_dependency > hit_direct_entry + 1", "利润池过薄": "coalesce(pct < 15, false) OR text_thin_margin = 1", "退出锚缺失": "anchors < 2",
    "估值严重偏高": "regexp_matches(lower(valued), '30x|过高|高估值') OR text_overvalued = 1", "合规/诉讼风险": "text_compliance = 1", "上市公司仅作参照": "starts_with(listed, '上市公司')",
    "重大造假嫌疑": "text_fraud = 1"}
_GAPS = ["revenue = '待核实'", "margin = '待核实'", "valued = '待核实'", "hit_customer < 2", "hit_customer_depth = 0", "rivals < 2", "anchors < 2", "recent_180 = 0 AND n > 0"]
_GATES = ["NOT contains(listed, '未上市')", "n < 3 OR domains < 2", "official = 0 AND authoritative < 2 AND n > 0", "social_ratio >= 0.60 AND official = 0", "chain < 45 AND n > 0", "len(gaps) >= 5",
          "revenue = '待核实' AND trend = '待核实' AND margin = '待核实'", "anchors < 2", "rivals < 2", "recent_180 = 0 AND n > 0", "tracking = '放弃'"]


def _listed(tests: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {value} END" for test, value in tests) + "], lambda x: x IS NOT NULL)"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}" for v in row) + ")" for row in rows)


_PENDING = lambda name: f"coalesce(nullif({name}, ''), '{R.PENDING}')"
_FACTS = f"""
f1 AS (SELECT *, {_when(*[(f"sector_{n} > 0", f"'{n}'") for n, _ in T.SECTOR_RULES], ("", "'default'"))} AS sector,
  CASE WHEN text_listed_words = 1 AND text_unlisted_word = 0 THEN '上市公司/二级主体' WHEN text_unlisted_hints = 1 THEN '未上市' ELSE '未知' END AS listed,
  {_PENDING("latest_round")} AS stage, {_PENDING("gross_margin_text")} AS margin, {_PENDING("revenue_text")} AS revenue, {_PENDING("growth_text")} AS trend, {_PENDING("funding_total")} AS funded,
  {_PENDING("latest_valuation")} AS valued, TRY_CAST(nullif(regexp_extract(gross_margin_text, '(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS DOUBLE) AS pct, text_exit_ipo AS ipo, text_exit_merger AS merger,
  CASE latest_round WHEN '种子轮' THEN 5 WHEN '天使轮' THEN 5 WHEN 'pre-a轮' THEN 5 WHEN 'a轮' THEN 4 WHEN 'b轮' THEN 3 WHEN 'd轮' THEN 1 WHEN 'pre-ipo' THEN 1 WHEN '成长期' THEN 3 ELSE 2 END AS stage_level,
  greatest(text_moat_technology, text_moat_certificate, text_moat_stickiness) * 2 + CASE WHEN hit_competitor > 0 OR hit_risk > 0 THEN 1 ELSE 0 END AS moats,
  len(list_filter(string_split(rival_text, ';'), lambda x: regexp_replace(x, '[ ：:，,。；;]+', '', 'g') <> '')) AS named,
  highs + mediums + lows = 0 AND hit_project >= 2 AS project_risk FROM company_facts),
f2 AS (SELECT *, 2 * ipo + merger + ipo * merger + greatest(ipo, merger) AS exits, ipo + merger + greatest(ipo, merger) AS anchors, CASE WHEN named > 0 THEN named WHEN hit_competitor >= 2 THEN 1 ELSE 0 END AS rivals,
  ({_KNOWN("revenue")})::INT + ({_KNOWN("trend")})::INT + ({_KNOWN("margin")})::INT + ({_KNOWN("stage")})::INT AS finances, ({_KNOWN("stage")})::INT + ({_KNOWN("valued")})::INT + ({_KNOWN("funded")})::INT AS money,
  CASE WHEN text_abandoned = 1 THEN '放弃' WHEN recent_90 >= 3 AND hit_customer >= 2 AND hit_financing >= 1 THEN '深跟' WHEN recent_180 >= 2 AND (hit_customer >= 1 OR hit_commercialization >= 2) THEN '立项'
    WHEN n < 3 OR domains < 2 THEN '补证' ELSE '观察' END AS tracking FROM f1),
f3 AS (SELECT *, {_listed([(t, f"'{g}'") for t, g in zip(_GAPS, R.INFO_GAPS, strict=True)])} AS gaps, {_listed([(_TAGS[g], f"'{g}'") for g, _ in R.EXCLUSIONS])} AS tags,
  {" + ".join(f"CASE WHEN {_TAGS[g]} THEN {p} ELSE 0 END" for g, p in R.EXCLUSIONS)} AS points FROM f2),
facts AS (SELECT *, {_listed([(t, f"{{'gate': '{g}', 'cap': {cap}e0}}") for t, (g, cap) in zip(_GATES, R.GATES, strict=True)])} AS gates FROM f3),
subs AS (SELECT entity_key, unnest([{", ".join(f"{{'d': '{d}', 's': '{k}', 'w': {w}, 'l': {_SUBS[k]}}}" for d in R.DIMENSION_KEYS for k, _, w in R.SUB_DIMENSIONS[d])}]) AS x FROM facts)"""
_POINTS = f"""
base(d, base) AS (VALUES {_values(list(R.DIMENSION_WEIGHTS.items()))}), change(sector, d, factor) AS (VALUES {_values([(s, d, v) for s, ch in R.SECTOR_ADJUSTMENTS.items() for d, v in ch.items()])}),
sectors(sector) AS (VALUES {_values([(s,) for s in R.SECTOR_ADJUSTMENTS])}),
raw AS (SELECT sector, d, base::DOUBLE * coalesce(factor, 1)::DOUBLE AS raw FROM sectors CROSS JOIN base LEFT JOIN change USING (sector, d)),
weights AS (SELECT sector, d, {_even("raw * 100 / sum(raw) OVER (PARTITION BY sector)", 2)} AS weight FROM raw),
model AS (SELECT entity_key, x.d AS d, {_even("sum(x.l * x.w) / 100e0", 0)} AS model FROM subs GROUP BY ALL),
rows AS (SELECT entity_key, sector, reliability, unnest([{", ".join(
    f"{{'d': '{d}', 'n': {d}__n, 'domains': {d}__domains, 'strict': {d}__authoritative_strict, 'verified': {d}__verified, 'recent': {d}__recent_180, 'corroborated': {d}__corroborated, 'social': {d}__social, 'goal': {_GOALS.get(d, 'NULL')}}}"
    for d in R.DIMENSION_KEYS)}]) AS x FROM facts),
sure AS (SELECT r.entity_key, r.x.d AS d, r.x.n AS support, r.x.goal AS goal, m.model, w.weight, least((least(r.x.n, 4) * 8 + least(r.x.domains, 4) * 9 + least(r.x.strict, 3) * 7 + least(r.x.verified, 3) * 6 + least(r.x.recent, 3) * 4
    + least(r.x.corroborated, 2) * 8) * 0.8e0 + r.reliability * 0.2e0, CASE WHEN r.x.n = 1 OR r.x.domains = 1 THEN 49 ELSE 100 END, CASE WHEN r.x.strict = 0 THEN 64 ELSE 100 END,
    CASE WHEN r.x.social = r.x.n AND r.x.strict = 0 THEN 34 ELSE 100 END) AS sure FROM rows r JOIN model m ON m.entity_key = r.entity_key AND m.d = r.x.d JOIN weights w ON w.sector = r.sector AND w.d = r.x.d),
mixed(d, mix, strict) AS (VALUES {_values([(d, R.MODEL_WEIGHTS.get(d, 1.0), int(d in R.DISCIPLINED)) for d in R.DIMENSION_KEYS])}),
lev AS (SELECT s.*, CASE WHEN support = 0 THEN 'low' {" ".join(f"WHEN sure >= {t} THEN '{n}'" for t, n in R.CONFIDENCE_BUCKETS)} ELSE '{R.CONFIDENCE_DEFAULT}' END AS confidence,
    CASE WHEN goal IS NULL THEN model ELSE least(greatest(0, least(5, {_even("model * mix::DOUBLE + goal * (1 - mix::DOUBLE)", 0)})), CASE WHEN x.strict = 1 AND model - goal >= 2 THEN goal + 1 ELSE 5 END) END AS level
  FROM sure s JOIN mixed x ON x.d = s.d),
pts AS (SELECT *, {_even(f"{_even('weight * level / 5e0', 2)} * CASE confidence " + " ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in R.CONFIDENCE_FACTOR.items()) + " END", 2)} AS score FROM lev)"""
_WIDE = ", ".join(f"max(CASE WHEN d = '{d}' THEN {x} END) AS {x}_{d}" for d in R.DIMENSION_KEYS for x in ("score", "weight", "level"))
_SUM = lambda what, *dims: "(" + " + ".join(f"{what}_{d}" for d in dims) + ")"
_TOTALS = f"""
wide AS (SELECT entity_key, {_WIDE}, sum(CASE confidence {" ".join(f"WHEN '{k}' THEN {v!r}" for k, v in R.CONFIDENCE_INDEX.items())} END)::DOUBLE AS sure FROM pts GROUP BY 1),
t1 AS (SELECT *, least(25, points) AS penalty, {_even("least(3e0, momentum_tenths / 10e0)", 1)} AS momentum, {_even("sure / 9", 1)} AS conf, {_even(_SUM("weight", *R.DIMENSION_KEYS), 1)} AS possible,
    {_even("least(10e0, highs * 2.5e0 + (mediums + project_risk::INT) * 1e0 + lows * 0.3e0)", 1)} AS risk_penalty, highs * 9 + mediums * 4 + lows * 2 + project_risk::INT * 4 AS weighted,
    {_even("least(8e0, greatest(0e0, (62e0 - least(reliability, chain)) / 6.5e0))", 1)} AS doubt, coalesce(list_min(list_transform(gates, lambda g: g.cap)), 100) AS cap FROM facts JOIN wide USING (entity_key)),
t2 AS (SELECT *, {_even(f"greatest(0e0, {_SUM('score', *R.DIMENSION_KEYS)} - penalty)", 1)} AS a, {_even("least(100e0, weighted * 5 + penalty * 2.5e0)", 1)} AS risk_pressure, {_even("0.55e0 + 0.45e0 * conf / 100e0", 4)} AS trust FROM t1),
t3 AS (SELECT *, {_even("a + momentum", 1)} AS b FROM t2), t4 AS (SELECT *, {_even("greatest(0e0, b - risk_penalty)", 1)} AS e FROM t3), t5 AS (SELECT *, {_even("greatest(0e0, e - doubt)", 1)} AS pre FROM t4),
t6 AS (SELECT *, {_even("least(pre, cap)", 1)} AS total FROM t5), t7 AS (SELECT *, {_even("total * trust", 1)} AS priority FROM t6)"""


@query("sub_levels_of_facts", "K4 K6 A15", f"""
WITH {_FACTS} SELECT entity_key, x.d AS dimension, x.s AS sub_dimension, x.w AS weight_pct, x.l AS level FROM subs""")
def sub_levels_of_facts(t: Tables) -> DataFrame:
    return S.sub_dimension_rows(scored_facts(t)).select("entity_key", "dimension", "sub_dimension", "weight_pct", "level")


@query("dimension_points", "K3 K4 K5 K7", f"""
WITH {_FACTS}, {_POINTS} SELECT entity_key, d AS dimension, weight, CAST(model AS INT) AS model_level, CAST(goal AS INT) AS objective_level, CAST(level AS INT) AS level, confidence, score, support FROM pts""")
def dimension_points(t: Tables) -> DataFrame:
    return S.dimension_rows(scored_facts(t).withColumns({f"{d}__{x}": F.lit(0) for d in R.DIMENSION_KEYS for x in ("authoritative",)})).select(
        "entity_key", "dimension", "weight", "model_level", "objective_level", "level", "confidence", "score", "support")


@query("gates_of_facts", "K8 K6", f"""
WITH {_FACTS}, {_POINTS}, {_TOTALS} SELECT entity_key, g.gate AS name, g.cap AS cap, pre AS pre_gate_score, total AS total_score FROM (SELECT entity_key, pre, total, unnest(gates) AS g FROM t7)""")
def gates_of_facts(t: Tables) -> DataFrame:
    return S.gate_rows(scored_facts(t)).select("entity_key", "name", "cap", "pre_gate_score", "total_score")


@query("totals_of_facts", "K6 K10 K11 K12 K19 W6", f"""
WITH {_FACTS}, {_POINTS}, {_TOTALS} SELECT row_number() OVER (ORDER BY priority DESC, conf DESC, n DESC, entity_key) AS rank, entity_key, total AS total_score, pre AS pre_gate_score, cap AS score_cap, priority AS priority_score,
  conf AS confidence_score, penalty, momentum AS momentum_bonus, risk_penalty, doubt AS reliability_penalty, risk_pressure, {_even("total / possible * 100", 1)} AS score_pct,
  {_when(*[(f"total >= {t}", f"'{n}'") for t, n in R.BUCKETS], ("", f"'{R.BUCKET_DEFAULT}'"))} AS score_bucket, {_when(*[(f"total >= {t}", f"'{n}'") for t, n in R.GRADES], ("", f"'{R.GRADE_DEFAULT}'"))} AS score_grade,
  {_even(_SUM("score", "sector_prosperity", "profit_pool", "high_end_attribute", "competitive_position"), 1)} AS static_score,
  {_even(_SUM("score", "customer_validation", "commercialization_progress", "information_sufficiency"), 1)} AS dynamic_score, {_even(_SUM("score", "investability", "exit_feasibility"), 1)} AS deal_score,
  {_even("least(100e0, CASE tracking " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.TRACKING_SIGNAL.items())
         + " END * 0.3e0 + level_investability / 5e0 * 25 + level_customer_validation / 5e0 * 20 + level_commercialization_progress / 5e0 * 15 + least(momentum / 3e0, 1e0) * 10)", 1)} AS execution_readiness,
  {_even("least(100e0, conf * 0.24e0 + strength * 0.18e0 + reliability * 0.34e0 + greatest(0, 100 - len(gaps) * 10) * 0.15e0 + least(recent_90 * 15, 100) * 0.09e0)", 1)} AS data_quality,
  listed AS listed_status, stage, tracking AS tracking_stage, sector AS sector_type, array_to_string(gaps, '|') AS info_gaps, array_to_string(tags, '|') AS tags, rivals AS competitors FROM t7""")
def totals_of_facts(t: Tables) -> DataFrame:
    rows = S.rank_candidates(scored_facts(t).select(*[x for x in S.REPORT_COLUMNS if x not in ("freshness", "cross_validation")]))
    return rows.select(
        "rank", "entity_key", "total_score", "pre_gate_score", "score_cap", "priority_score", "confidence_score", "penalty", "momentum_bonus", "risk_penalty", "reliability_penalty", "risk_pressure",
        "score_pct", "score_bucket", "score_grade", "static_score", "dynamic_score", "deal_score", "execution_readiness", "data_quality", "listed_status", "stage", "tracking_stage", "sector_type",
        F.array_join("info_gaps", "|").alias("info_gaps"), F.array_join(F.transform("penalties", lambda x: x["tag"]), "|").alias("tags"), F.size("competitors").alias("competitors"))
