"""Weekly radar rules: core variables, event patterns, exclusions and limits."""

from __future__ import annotations

from dataclasses import dataclass, field

# Core variables in order, with their trigger keywords.
CORE_VARIABLES = [
    ("客户验证", ["客户认证", "通过认证", "定点", "中标", "订单", "采购", "首单", "框架协议", "签约", "战略合作"]),
    ("规模化与交付能力", ["量产", "投产", "产线", "交付", "出货", "扩产"]),
    ("监管或临床里程碑", ["获批", "批准", "临床", "注册证", "备案"]),
    ("技术去风险", ["流片", "首发", "突破", "验证", "样机", "首套", "国产替代", "发布"]),
    ("资本与产业资源到位", ["融资", "增资", "战略投资", "完成交割"]),
    ("退出可见性", ["上市辅导", "递表", "IPO", "并购", "挂牌"]),
]

# Sector keywords in order.
SECTORS = [
    ("半导体与光电", ["半导体", "芯片", "光模块", "光通信", "光电", "封装", "GPU", "算力"]),
    ("具身智能", ["机器人", "具身智能", "Physical AI", "世界模型", "空间智能", "关节模组"]),
    ("高端装备", ["高端装备", "高端仪器", "核聚变", "量子", "精密测量", "工业软件"]),
    ("生命科技", ["AI制药", "生物医药", "医疗器械", "临床", "药物", "注册证"]),
    ("新材料", ["新材料", "特种材料", "复合材料", "稀土", "高温合金"]),
]
PRINCIPLES = ["早期阶段", "技术进展", "客户验证", "规模化进展", "监管里程碑", "公开证据充分"]

# Patterns of a completed milestone per core variable.
CONFIRMED_EVENTS = {
    "客户验证": ["通过.{0,12}认证", "获(?:得|取).{0,12}认证", "中标", "获得.{0,12}订单",
             "签署.{0,12}(?:合同|协议)", "首单", "定点"],
    "规模化与交付能力": ["正式量产", "实现量产", "进入量产", "已量产", "首批.{0,8}量产", "正式投产",
                 "建成投产", "完成.{0,12}交付", "首批.{0,8}交付", "出货"],
    "监管或临床里程碑": ["获批", "批准", "取得.{0,12}注册证", "进入.{0,8}临床", "完成.{0,8}临床",
                 "临床.{0,8}(?:成功|达到)"],
    "技术去风险": ["完成.{0,8}流片", "流片成功", "技术突破", "通过.{0,12}验证", "完成.{0,12}验证",
              "首台.{0,8}样机", "首套", "正式发布"],
    "资本与产业资源到位": ["完成.{0,16}融资", "获(?:得|取).{0,16}融资", "融资.{0,8}(?:到账|交割)",
                  "完成交割", "战略投资"],
    "退出可见性": ["完成上市辅导", "递表", "提交.{0,8}IPO", "并购.{0,8}完成", "正式挂牌"],
}

# Patterns of plans, forecasts and questions.
NON_EVENTS = [
    "[？?]", "FAQ", "将(?:于.{0,12})?(?:量产|投产|交付|发布)",
    "(?:拟|计划|预计|有望|或将).{0,12}(?:量产|投产|交付|融资|获批|上市)",
    "(?:何时|时间|价格).{0,12}(?:量产|落地)", "(?:量产|投产|交付).{0,10}(?:时间|计划)",
    "推进.{0,12}(?:客户认证|融资|上市)", "(?:尚未|仍未|不确定).{0,12}(?:认证|量产|获批|融资)",
    "后续.{0,12}(?:取得|获批|量产|交付)",
]
LATE_STAGE = ["(?:C\\+?轮|D轮|E轮|F轮)", "(?:Pre[- ]?IPO|IPO前|上市前融资)"]

# Names that are not companies.
ENTITY_STOPWORDS = ["中国", "我国", "行业", "市场", "政策", "机构", "企业", "公司", "项目", "产业", "科技",
                    "机器人", "半导体", "新材料", "生物医药", "专精特新", "新闻联播", "天津河西"]
GENERIC_ENTITIES = ["(?:全球|国内|国产|我国).{0,8}(?:首条|首个|首款)", "Ultra.{0,12}人形机器人",
                    "(?:第一|第二|第三|第四|新一)代", "产线", "新闻联播", "落地时间", "(?:将|拟|计划|预计)$",
                    "正式$", "20\\d{2}年"]
MATURE_ENTITIES = ["示例成熟企业甲", "示例成熟企业乙", "万孚生物"]
BLOCKED_PUBLISHERS = ["eastmoney.com"]
BAD_ENTITY_ENDINGS = ["项目", "产品", "方案", "技术", "行业", "市场", "创新药"]
PRIVATE_SHAPE = "(?:科技|智能|半导体|机器人|生物|医药|材料|光电|微电子|能源|动力|装备|仪器)$"

CAPITAL_VARIABLE = "资本与产业资源到位"
CUSTOMER_VARIABLE = "客户验证"
SCALE_VARIABLE = "规模化与交付能力"

# Open question and next check per core variable.
VERIFICATION = {
    "客户验证": ("客户名称、订单金额、是否付费及复购尚未由一手材料交叉核验",
             "联系公司并取得合同/中标通知/客户访谈，核验金额、交付与回款"),
    "规模化与交付能力": ("实际产能、良率、在手订单和交付节奏尚未核验",
                 "核验产线、良率、在手订单、交付验收与回款凭证"),
    "监管或临床里程碑": ("批件范围、临床阶段和商业化时间表尚未核验",
                 "取得监管/临床登记原件，并核验适应症、阶段与后续资金需求"),
    "技术去风险": ("技术指标、第三方验证和相对竞品优势尚未核验",
              "取得测试报告、客户验证记录，并访谈技术负责人和外部专家"),
    "资本与产业资源到位": ("融资是否完成交割、估值、投资方及资金用途尚未核验",
                  "核验交割凭证、最新股权结构、估值及本轮资金用途"),
    "退出可见性": ("申报阶段、合规障碍与可实现退出路径尚未核验",
              "核验监管披露、辅导/申报文件和股东可退出条款"),
}
VERIFICATION_DEFAULT = ("事件真实性和对基本面的影响尚未核验",
                        "取得一手材料，并完成公司、客户和行业三方交叉验证")

# Words a follow-up company name may not contain or start with.
FOLLOWUP_REJECTED = ["产品", "系统", "设备", "仪", "证书", "获批", "上市", "IND", "FDA", "NMPA"]
FOLLOWUP_PLACEHOLDERS = ["待归属", "待识别", "公众号待"]
FOLLOWUP_LATE_STAGE = "(?:C\\d*轮|D\\d*轮|E\\d*轮|F\\d*轮|Pre[- ]?IPO)"
FOLLOWUP_EARLY_STAGE = "(?:天使轮|种子轮|Pre[- ]?A|A\\+?轮)"


@dataclass(frozen=True)
class RadarRules:
    """One rule set; the defaults are the standing weekly radar."""

    window_days: int = 7
    max_candidates: int = 5
    core_variables: list = field(default_factory=lambda: list(CORE_VARIABLES))
    sectors: list = field(default_factory=lambda: list(SECTORS))
    principles: list = field(default_factory=lambda: list(PRINCIPLES))
    confirmed_events: dict = field(default_factory=lambda: dict(CONFIRMED_EVENTS))
    non_events: list = field(default_factory=lambda: list(NON_EVENTS))
    late_stage: list = field(default_factory=lambda: list(LATE_STAGE))
    entity_stopwords: list = field(default_factory=lambda: list(ENTITY_STOPWORDS))
    generic_entities: list = field(default_factory=lambda: list(GENERIC_ENTITIES))
    mature_entities: list = field(default_factory=lambda: list(MATURE_ENTITIES))
    blocked_publishers: list = field(default_factory=lambda: list(BLOCKED_PUBLISHERS))
