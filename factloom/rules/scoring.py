"""Deep-report scoring rules: dimensions, weights, keyword groups, penalties, gates."""

from __future__ import annotations

# Dimensions in order (key, label, weight).
DIMENSIONS = [
    ("sector_prosperity", "赛道景气", 10), ("profit_pool", "利润池", 10),
    ("high_end_attribute", "高端属性", 6), ("customer_validation", "客户验证", 16),
    ("commercialization_progress", "商业化进度", 13), ("investability", "可投性", 14),
    ("exit_feasibility", "退出可行性", 12), ("competitive_position", "竞争卡位", 10),
    ("information_sufficiency", "信息充分度", 9),
]
DIMENSION_KEYS = [d[0] for d in DIMENSIONS]
DIMENSION_LABELS = {d[0]: d[1] for d in DIMENSIONS}
DIMENSION_WEIGHTS = {d[0]: float(d[2]) for d in DIMENSIONS}

# Sub-dimensions (key, label, weight in percent).
SUB_DIMENSIONS = {
    "sector_prosperity": [("policy_catalyst", "政策催化", 30), ("demand_expansion", "需求扩张", 30),
                          ("penetration_rate", "渗透率空间", 20), ("industry_cycle", "产业景气周期", 20)],
    "profit_pool": [("value_chain_pos", "价值链位置", 30), ("pricing_power", "议价能力", 25),
                    ("gross_margin", "毛利厚度", 25), ("aftermarket", "后市场潜力", 20)],
    "high_end_attribute": [("tech_barrier", "技术壁垒", 30), ("certification", "认证门槛", 25),
                           ("process_knowhow", "工艺know-how", 25), ("import_sub", "国产替代难度", 20)],
    "customer_validation": [("benchmark_client", "标杆客户", 30), ("adoption_depth", "导入深度", 25),
                            ("repurchase", "复购率", 25), ("cross_industry", "跨行业复制", 20)],
    "commercialization_progress": [("mass_production", "量产能力", 30),
                                   ("order_conversion", "订单转化", 25),
                                   ("channel_build", "渠道建设", 25),
                                   ("scale_efficiency", "规模化效率", 20)],
    "investability": [("round_match", "轮次匹配", 30), ("valuation", "估值合理性", 30),
                      ("equity_structure", "股权结构", 20), ("timing_window", "融资窗口", 20)],
    "exit_feasibility": [("ipo_comparable", "IPO可比", 30), ("ma_appetite", "并购承接", 25),
                         ("exit_timeline", "退出时间窗口", 25), ("buyer_density", "产业买家密度", 20)],
    "competitive_position": [("differentiation", "差异化", 30), ("market_position", "行业地位", 25),
                             ("customer_mindshare", "客户心智", 25),
                             ("platform_extension", "平台化延展", 20)],
    "information_sufficiency": [("public_evidence", "公开证据", 35), ("cross_validation", "交叉验证", 35),
                                ("info_consistency", "信息一致性", 30)],
}

# Claim types that support a dimension (empty = every claim).
CLAIM_HINTS = {
    "sector_prosperity": ["demand_signal", "policy_signal", "commercial_signal"],
    "profit_pool": ["commercial_signal", "partnership_signal"],
    "high_end_attribute": ["product_signal", "founder_signal", "partnership_signal"],
    "customer_validation": ["partnership_signal", "commercial_signal"],
    "commercialization_progress": ["commercial_signal", "product_signal", "partnership_signal"],
    "investability": ["commercial_signal", "founder_signal", "risk_signal"],
    "exit_feasibility": ["commercial_signal", "partnership_signal", "competitive_signal"],
    "competitive_position": ["product_signal", "competitive_signal", "partnership_signal",
                             "commercial_signal"],
    "information_sufficiency": [],
}

# Sector weight adjustments.
SECTOR_ADJUSTMENTS = {
    "hardware": {"high_end_attribute": 1.15, "profit_pool": 1.10,
                 "commercialization_progress": 1.10, "information_sufficiency": 0.90},
    "software": {"competitive_position": 1.20, "customer_validation": 1.10,
                 "high_end_attribute": 0.90, "profit_pool": 1.15},
    "platform": {"competitive_position": 1.25, "customer_validation": 1.15,
                 "exit_feasibility": 1.10, "commercialization_progress": 0.90},
    "robotics": {"high_end_attribute": 1.10, "commercialization_progress": 1.15,
                 "profit_pool": 1.05, "exit_feasibility": 1.05},
    "semiconductor": {"high_end_attribute": 1.25, "customer_validation": 1.15,
                      "profit_pool": 1.10, "information_sufficiency": 0.85,
                      "commercialization_progress": 0.90},
    "medical_device": {"high_end_attribute": 1.20, "exit_feasibility": 1.15,
                       "customer_validation": 1.10, "sector_prosperity": 0.90},
    "new_energy": {"sector_prosperity": 1.15, "commercialization_progress": 1.15,
                   "profit_pool": 1.10, "competitive_position": 0.90},
    "new_material": {"high_end_attribute": 1.20, "profit_pool": 1.15,
                     "customer_validation": 1.10, "competitive_position": 0.90},
    "default": {},
}

# Blend, discipline and confidence constants.
MODEL_WEIGHTS = {"customer_validation": 0.50, "commercialization_progress": 0.55,
                 "investability": 0.45, "exit_feasibility": 0.45, "competitive_position": 0.65,
                 "information_sufficiency": 0.30}
DISCIPLINED = ["customer_validation", "commercialization_progress", "investability",
               "exit_feasibility", "information_sufficiency"]
CONFIDENCE_FACTOR = {"high": 1.00, "medium_high": 0.90, "medium": 0.80, "medium_low": 0.70,
                     "low": 0.55}
CONFIDENCE_INDEX = {"high": 100.0, "medium_high": 80.0, "medium": 60.0, "medium_low": 40.0,
                    "low": 20.0}
TRACKING_SIGNAL = {"立项": 100, "深跟": 85, "约访": 70, "补证": 55, "观察": 40, "放弃": 10}
RISK_LEVELS = {"低": 1, "中": 2, "高": 3, "一票否决": 4}

# Exclusion tags in the order they are tested, with penalty.
EXCLUSIONS = [
    ("标准耗材型", 3), ("区域性强", 3), ("单一产品依赖", 4), ("配套功能件型", 5), ("工程项目型", 5),
    ("宽口径拼装型", 5), ("客户集中度过高", 5), ("团队经验不匹配", 5), ("独立客户入口弱", 6),
    ("利润池过薄", 6), ("退出锚缺失", 7), ("估值严重偏高", 7), ("合规/诉讼风险", 8),
    ("上市公司仅作参照", 20), ("重大造假嫌疑", 20),
]

# Keyword groups counted over evidence that is not negative.
HIT_GROUPS = {
    "customer": ["客户", "签约", "中标", "合作", "案例", "导入", "项目落地", "验证"],
    "customer_depth": ["复购", "扩单", "战略供应商", "独家", "批量采购", "框架协议", "续费", "续约"],
    "commercialization": ["量产", "交付", "订单", "收入", "商业化", "出货", "产线", "下线", "发布", "装机"],
    "policy": ["政策", "补贴", "标准", "指南", "规划", "条例", "试点", "专项"],
    "product": ["产品", "发布", "量产", "升级", "迭代", "认证", "获批", "装机", "芯片流片"],
    "exit": ["ipo", "上市", "并购", "收购", "退出", "并表", "整合"],
    "moat": ["专利", "壁垒", "护城河", "know-how", "knowhow", "工艺", "认证", "资质", "国产替代", "自主可控"],
    "competitor": ["竞品", "竞争", "对标", "替代", "份额", "龙头", "领先", "第一", "前五"],
    "platform": ["平台", "生态", "底座", "系统", "套件", "矩阵"],
    "cross_industry": ["汽车", "锂电", "3c", "半导体", "医疗", "仓储", "物流", "光伏", "消费电子"],
    "benchmark": ["头部客户", "标杆客户", "top3", "top5", "龙头客户", "央企", "国企", "世界500强"],
    "direct_entry": ["直销", "终端客户", "自建销售", "客户成功"],
    "channel_dependency": ["经销商", "代理商", "渠道商", "集成商"],
    "project": ["项目制", "定制化", "工程服务", "交钥匙"],
    "assembly": ["集成", "拼装", "方案集成", "外购"],
    "consumable": ["耗材", "试剂", "配件", "一次性"],
    "aftermarket": ["订阅", "维保", "服务费", "耗材", "软件授权", "续费"],
    "research": ["专利", "发明", "研发", "算法", "芯片", "配方"],
    "certification": ["认证", "注册证", "获批", "资质", "标准"],
    "mass_production": ["量产", "批量", "规模交付", "出货"],
    "order": ["订单", "签约", "收入", "回款"],
}
# Groups counted with other conditions.
FINANCING_WORDS = ["融资", "投资方", "领投", "跟投", "估值", "投后", "轮"]
FINANCING_CLOSE_WORDS = ["融资", "交割", "募集"]
RISK_WORDS = ["风险", "诉讼", "处罚", "违规", "召回", "造假", "负面", "下滑", "亏损", "价格战", "压价"]
OBJECTIVE_CUSTOMER = ["客户", "签约", "案例", "验证", "合作", "导入", "中标"]
OBJECTIVE_DEPTH = ["复购", "扩单", "战略供应商", "独家", "批量采购", "框架协议"]
OBJECTIVE_COMMERCIAL = ["量产", "交付", "订单", "收入", "发布", "商业化", "出货", "产线", "下线"]

# Word groups tested on the whole text of a company.
TEXT_FLAGS = {
    "listed_words": ["上市公司", "股票代码", "科创板", "创业板", "港交所", "纳斯达克", "纽交所", "a股"],
    "unlisted_word": ["未上市"],
    "unlisted_hints": ["未上市", "创业公司", "b轮", "a轮", "pre-ipo", "pre-a"],
    "abandoned": ["放弃", "终止合作", "清算", "停业", "重大造假"],
    "exit_ipo": ["ipo", "上市", "科创板", "创业板", "港股", "纳斯达克"],
    "exit_merger": ["并购", "收购", "整合", "并表", "产业方"],
    "moat_technology": ["专利", "研发", "算法", "芯片", "材料配方"],
    "moat_certificate": ["认证", "注册证", "资质", "准入"],
    "moat_stickiness": ["续费", "复购", "粘性", "平台", "生态"],
    "consumable_offset": ["平台", "订阅", "高值耗材", "独家"],
    "regional": ["区域龙头", "本地市场", "华东地区", "华南地区", "区域市场"],
    "nationwide": ["全国", "全球", "海外"],
    "single_product": ["单一产品", "单品", "核心产品占比"],
    "single_word": ["唯一", "单一"],
    "functional_part": ["功能件", "配套件", "配件", "模组"],
    "functional_offset": ["核心部件", "底层软件"],
    "customer_concentration": ["客户集中度", "前五大客户", "前3大客户", "单一大客户"],
    "team_mismatch": ["跨界创业", "转型", "团队经验不足", "无行业经验"],
    "thin_margin": ["低毛利", "价格战", "压价严重"],
    "overvalued": ["估值倒挂", "估值过高", "高估值"],
    "compliance": ["诉讼", "处罚", "违规", "召回", "环保处罚", "行政处罚"],
    "fraud": ["造假", "财务造假", "数据造假", "虚假宣传", "重大失信"],
    "penetration": ["渗透率", "蓝海", "国产替代", "增量空间"],
    "core_value": ["核心部件", "底层软件", "平台底座", "核心材料", "核心算法"],
    "mid_value": ["系统", "模组", "方案"],
    "pricing": ["议价", "不可替代", "高粘性", "标准制定"],
    "process": ["工艺", "量产经验", "调参", "know-how", "knowhow"],
    "localisation": ["国产替代", "自主可控", "卡脖子"],
    "import_replacement": ["进口替代"],
    "channels": ["代理商", "渠道", "生态伙伴", "合作伙伴"],
    "equity": ["股权结构", "创始人持股", "老股东", "优先权", "对赌"],
    "ipo_comparable": ["ipo", "上市", "科创板", "创业板"],
    "merger_comparable": ["并购", "收购", "产业整合"],
    "exit_timeline": ["3-5年", "三到五年", "上市计划"],
    "buyers": ["产业方", "龙头", "上下游", "战略买家"],
    "market_first": ["第一", "前3", "龙头", "top3"],
    "market_leading": ["领先", "前五", "头部"],
}
VALUATION_HIGH = ["30x", "过高", "高估值"]

# Deal-momentum classes in order (signal, points, words).
MOMENTUM = [
    ("融资事件", 1.0, ["融资", "战略投资", "估值"]),
    ("客户签约", 0.8, ["客户", "签约", "中标", "订单"]),
    ("产品进展", 0.6, ["产品", "发布", "量产", "下线"]),
    ("资质认证", 0.4, ["专利", "获批", "认证"]),
]

# Risk classes in order; the default is the last entry.
RISK_TYPES = [
    ("合规/诉讼", ["诉讼", "处罚", "违规", "合规"]),
    ("财务/融资", ["亏损", "现金流", "融资", "估值"]),
    ("技术/交付", ["技术", "量产", "交付", "缺陷", "召回"]),
]
RISK_TYPE_DEFAULT = "市场/竞争"

# Patterns of facts in the text of a company.
ROUND_PATTERN = ("(pre-ipo|pre ipo|pre-a\\+?|seed|angel|天使轮|pre-a轮|a\\+轮|a轮|b\\+轮|b轮|c\\+轮|"
                 "c轮|d轮)")
AMOUNT_PATTERN = ("((?:累计|近|约|超|逾)?\\s*(?:人民币|美元)?\\s*\\d+(?:\\.\\d+)?\\s*"
                  "(?:亿元|亿人民币|亿美元|亿美金|万元|万人民币|万美元))")
VALUATION_PATTERN = ("(?:投后估值|估值|valuation)[^，。；;]{0,24}?((?:人民币|美元)?\\s*\\d+(?:\\.\\d+)?\\s*"
                     "(?:亿元|亿人民币|亿美元|亿美金))")
GROWTH_PATTERN = "(?:同比|yoy|增长|提升)[^。；;\\n]{0,20}?(?:\\d+(?:\\.\\d+)?%|翻倍|大幅增长)"
MARGIN_PATTERN = "(毛利率[^。；;\\n]{0,20}?(?:\\d+(?:\\.\\d+)?%))"
REVENUE_PATTERN = "(营收[^。；;\\n]{0,20}(?:\\d+(?:\\.\\d+)?\\s*(?:亿|万元|万)))"
RIVAL_PATTERN = "(?:对标|相比|竞争对手为|替代)([^。；;\\n]{0,36})"

# Score buckets and grades (threshold, label), highest first.
BUCKETS = [(78, "最终推荐"), (68, "重点跟踪"), (58, "备选观察"), (45, "待补证")]
BUCKET_DEFAULT = "低优先级"
VIEW_BUCKETS = [(78, "证据较完整"), (68, "优先核验"), (58, "持续观察"), (45, "待补证")]
VIEW_BUCKET_DEFAULT = "暂缓核验"
VIEW_BADGES = [(78, "badge-green"), (68, "badge-blue"), (58, "badge-orange")]
VIEW_BADGE_DEFAULT = "badge-gray"
GRADES = [(82, "A+"), (76, "A"), (68, "B+"), (60, "B"), (52, "C+"), (44, "C")]
GRADE_DEFAULT = "D"
CONFIDENCE_BUCKETS = [(80, "high"), (65, "medium_high"), (50, "medium"), (35, "medium_low")]
CONFIDENCE_DEFAULT = "low"

# Information gaps in order.
INFO_GAPS = ["缺少营收规模或收入区间", "缺少毛利率或价值链利润池证据", "缺少最新估值信息", "客户验证深度不足",
             "缺少复购/扩单/战略供应商证据", "竞争对手对比不足", "退出锚点不足", "缺少近180天有效证据"]

# Hard gates in order (name, cap).
GATES = [("一级属性门槛", 35.0), ("证据充分度门槛", 57.0), ("官方锚门槛", 63.0), ("社交依赖门槛", 58.0),
         ("证据链门槛", 61.0), ("信息缺口门槛", 60.0), ("财务数据门槛", 62.0), ("退出锚门槛", 65.0),
         ("竞争格局门槛", 68.0), ("时效性门槛", 70.0), ("放弃状态门槛", 30.0)]
PENDING = "待核实"
