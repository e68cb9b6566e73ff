"""Source packs, platforms and tiers of web hosts."""

from __future__ import annotations

# Source packs (key, label, tier, domains).
SOURCE_PACKS = [
    ("official", "官方/监管/交易所", "T1",
     ["gov.cn", "ndrc.gov.cn", "miit.gov.cn", "stats.gov.cn", "pbc.gov.cn",
      "csrc.gov.cn", "sse.com.cn", "szse.cn", "cninfo.com.cn"]),
    ("news", "产业媒体/财经媒体", "T2",
     ["36kr.com", "leiphone.com", "ofweek.com", "gg-lab.com", "cls.cn", "eastmoney.com",
      "stcn.com", "cs.com.cn", "cnstock.com", "pedaily.cn", "chinaventure.com.cn", "iyiou.com"]),
    ("wechat", "微信公众号", "T2/T3", ["mp.weixin.qq.com", "weixin.qq.com"]),
    ("xiaohongshu", "小红书", "T3", ["xiaohongshu.com"]),
    ("wechat_ecosystem", "微信生态/视频号", "T2/T3",
     ["channels.weixin.qq.com", "mp.weixin.qq.com", "weixin.qq.com"]),
    ("knowledge_community", "知识星球/知识社区", "T2/T3",
     ["zsxq.com", "doc.zsxq.com", "xiaobot.net", "yuque.com", "flowus.cn", "feishu.cn",
      "notion.site"]),
    ("mini_program", "小程序/开放平台", "T2/T3",
     ["developers.weixin.qq.com", "open.weixin.qq.com", "miniapp.xiaohongshu.com",
      "mp.weixin.qq.com"]),
    ("video_social", "视频/短内容社交", "T3",
     ["channels.weixin.qq.com", "douyin.com", "bilibili.com", "kuaishou.com"]),
    ("a_share", "A股线索站点", "T1/T2/T3",
     ["cls.cn", "eastmoney.com", "cninfo.com.cn", "xueqiu.com", "jiuyangongshe.com"]),
    ("community", "社区/讨论区", "T3",
     ["xueqiu.com", "jiuyangongshe.com", "zhihu.com", "weibo.com", "bilibili.com"]),
    ("recruiting", "招聘信息", "T2/T3", ["zhipin.com", "liepin.com", "51job.com", "lagou.com"]),
    ("bidding", "招投标/采购", "T1/T2",
     ["ccgp.gov.cn", "cebpubservice.com", "chinabidding.cn", "ztb365.cn"]),
    ("pe_vc_db", "PE/VC数据库与融资平台", "T1/T2",
     ["itjuzi.com", "pedata.cn", "zero2ipo.com.cn", "crunchbase.com", "pitchbook.com",
      "pedaily.cn", "chinaventure.com.cn", "tianyancha.com", "qcc.com"]),
    ("patent_ip", "专利/知识产权", "T1/T2",
     ["pss-system.cponline.cnipa.gov.cn", "patents.google.com", "soopat.com", "baiten.cn",
      "zhihuiya.com"]),
    ("industry_report", "产业研究/行研报告", "T2",
     ["forward.com.cn", "leadleo.com", "iimedia.cn", "chyxx.com", "huaon.com", "askci.com",
      "vzkoo.com", "reportrc.com"]),
    ("corp_registry", "企业征信/工商数据", "T1",
     ["tianyancha.com", "qcc.com", "aiqicha.com", "gsxt.gov.cn", "creditchina.gov.cn"]),
    ("supply_chain", "供应链/进出口/海关", "T2/T3",
     ["customs.gov.cn", "importgenius.com", "52wmb.com", "tradesparq.com"]),
    ("academic_std", "学术/标准/技术文献", "T2/T3",
     ["cnki.net", "wanfangdata.com.cn", "scholar.google.com", "std.samr.gov.cn",
      "openstd.samr.gov.cn"]),
    ("developer_signal", "开发者/开源信号", "T2/T3",
     ["github.com", "gitee.com", "modelscope.cn", "huggingface.co"]),
    ("conference_expo", "展会/协会/产业活动", "T2",
     ["gongkong.com", "ca800.com", "ofweek.com", "cimes.org.cn", "cmes.org"]),
]

# Host -> display platform, tested in this order as a host suffix.
PLATFORMS = [
    ("mp.weixin.qq.com", "微信公众号"), ("weixin.qq.com", "微信公众号"),
    ("channels.weixin.qq.com", "微信视频号"), ("developers.weixin.qq.com", "微信开放平台"),
    ("open.weixin.qq.com", "微信开放平台"), ("miniapp.xiaohongshu.com", "小红书小程序"),
    ("xiaohongshu.com", "小红书"), ("zsxq.com", "知识星球"), ("doc.zsxq.com", "知识星球"),
    ("xiaobot.net", "小报童"), ("yuque.com", "语雀"), ("flowus.cn", "FlowUs"),
    ("feishu.cn", "飞书文档"), ("notion.site", "Notion"), ("xueqiu.com", "雪球"),
    ("jiuyangongshe.com", "韭研公社"), ("zhihu.com", "知乎"), ("weibo.com", "微博"),
    ("bilibili.com", "B站"), ("douyin.com", "抖音"), ("kuaishou.com", "快手"),
    ("zhipin.com", "BOSS直聘"), ("liepin.com", "猎聘"), ("51job.com", "前程无忧"),
    ("lagou.com", "拉勾"), ("ccgp.gov.cn", "中国政府采购网"),
    ("cebpubservice.com", "中国招标投标公共服务平台"), ("chinabidding.cn", "中国国际招标网"),
    ("ztb365.cn", "招标网"), ("36kr.com", "36氪"), ("leiphone.com", "雷锋网"),
    ("ofweek.com", "OFweek"), ("gg-lab.com", "机器之心类媒体"), ("cls.cn", "财联社"),
    ("eastmoney.com", "东方财富"), ("stcn.com", "证券时报"), ("cs.com.cn", "中证网"),
    ("cnstock.com", "上海证券报"), ("pedaily.cn", "投资界"), ("chinaventure.com.cn", "投中网"),
    ("iyiou.com", "亿欧"), ("itjuzi.com", "IT桔子"), ("pedata.cn", "清科数据"),
    ("zero2ipo.com.cn", "清科"), ("crunchbase.com", "Crunchbase"),
    ("pitchbook.com", "PitchBook"), ("tianyancha.com", "天眼查"), ("qcc.com", "企查查"),
    ("aiqicha.com", "爱企查"), ("gsxt.gov.cn", "国家企业信用信息公示系统"),
    ("creditchina.gov.cn", "信用中国"),
    ("pss-system.cponline.cnipa.gov.cn", "国家知识产权专利检索"),
    ("patents.google.com", "Google Patents"), ("soopat.com", "SooPAT专利"),
    ("baiten.cn", "佰腾专利"), ("zhihuiya.com", "智慧芽"), ("forward.com.cn", "前瞻产业研究院"),
    ("leadleo.com", "头豹研究院"), ("iimedia.cn", "艾媒咨询"), ("chyxx.com", "智研咨询"),
    ("huaon.com", "华经产业研究院"), ("askci.com", "中商产业研究院"), ("vzkoo.com", "未来智库"),
    ("reportrc.com", "报告查一查"), ("customs.gov.cn", "中国海关"),
    ("importgenius.com", "ImportGenius"), ("52wmb.com", "52外贸邦"),
    ("tradesparq.com", "TradeSparq"), ("cnki.net", "中国知网"),
    ("wanfangdata.com.cn", "万方数据"), ("scholar.google.com", "Google Scholar"),
    ("std.samr.gov.cn", "国家标准信息平台"), ("openstd.samr.gov.cn", "国家标准公开系统"),
    ("github.com", "GitHub"), ("gitee.com", "Gitee"), ("modelscope.cn", "魔搭社区"),
    ("huggingface.co", "Hugging Face"), ("gongkong.com", "工控网"), ("ca800.com", "中国自动化网"),
    ("cimes.org.cn", "机床展会"), ("cmes.org", "机械工程学会"), ("gov.cn", "政府网站"),
    ("ndrc.gov.cn", "国家发改委"), ("miit.gov.cn", "工信部"), ("stats.gov.cn", "国家统计局"),
    ("pbc.gov.cn", "中国人民银行"), ("csrc.gov.cn", "证监会"), ("sse.com.cn", "上交所"),
    ("szse.cn", "深交所"), ("cninfo.com.cn", "巨潮资讯"),
]

# Host -> display platform while scoring, tested in this order as a substring.
SCORE_PLATFORMS = [
    ("mp.weixin.qq.com", "微信公众号"), ("weixin.qq.com", "微信公众号"),
    ("channels.weixin.qq.com", "微信视频号"), ("developers.weixin.qq.com", "微信开放平台"),
    ("open.weixin.qq.com", "微信开放平台"), ("xiaohongshu.com", "小红书"),
    ("miniapp.xiaohongshu.com", "小红书小程序"), ("zsxq.com", "知识星球"),
    ("doc.zsxq.com", "知识星球"), ("xiaobot.net", "小报童"), ("yuque.com", "语雀"),
    ("flowus.cn", "FlowUs"), ("feishu.cn", "飞书文档"), ("notion.site", "Notion"),
    ("xueqiu.com", "雪球"), ("jiuyangongshe.com", "韭研公社"), ("cls.cn", "财联社"),
    ("eastmoney.com", "东方财富"), ("cninfo.com.cn", "巨潮资讯"), ("36kr.com", "36氪"),
    ("leiphone.com", "雷锋网"), ("ofweek.com", "OFweek"), ("pedaily.cn", "投资界"),
    ("chinaventure.com.cn", "投中网"), ("iyiou.com", "亿欧"), ("itjuzi.com", "IT桔子"),
    ("pedata.cn", "清科数据"), ("zero2ipo.com.cn", "清科"), ("tianyancha.com", "天眼查"),
    ("qcc.com", "企查查"), ("aiqicha.com", "爱企查"), ("zhipin.com", "BOSS直聘"),
    ("liepin.com", "猎聘"), ("lagou.com", "拉勾"), ("ccgp.gov.cn", "中国政府采购网"),
    ("soopat.com", "SooPAT专利"), ("zhihu.com", "知乎"), ("weibo.com", "微博"),
    ("bilibili.com", "B站"), ("douyin.com", "抖音"), ("kuaishou.com", "快手"),
    ("github.com", "GitHub"), ("gitee.com", "Gitee"), ("gongkong.com", "工控网"),
    ("ca800.com", "中国自动化网"),
]

# Host -> tier hints while scoring, first suffix match wins.
DOMAIN_TIERS = [
    ("gov.cn", "T1"), ("miit.gov.cn", "T1"), ("ndrc.gov.cn", "T1"), ("stats.gov.cn", "T1"),
    ("cninfo.com.cn", "T1"), ("sse.com.cn", "T1"), ("szse.cn", "T1"), ("36kr.com", "T2"),
    ("leiphone.com", "T2"), ("ofweek.com", "T2"), ("pedaily.cn", "T2"),
    ("chinaventure.com.cn", "T2"), ("iyiou.com", "T2"), ("itjuzi.com", "T1/T2"),
    ("pedata.cn", "T1/T2"), ("tianyancha.com", "T1/T2"), ("qcc.com", "T1/T2"),
    ("mp.weixin.qq.com", "T2/T3"), ("weixin.qq.com", "T2/T3"),
    ("channels.weixin.qq.com", "T2/T3"), ("xiaohongshu.com", "T3"), ("zhihu.com", "T3"),
    ("weibo.com", "T3"), ("bilibili.com", "T3"), ("douyin.com", "T3"), ("kuaishou.com", "T3"),
]

# Tier vocabulary, scores per profile, aliases, credibility labels.
TIER_ALIASES = {
    "primary_official": "T1", "platform_official": "T1/T2", "industry_db": "T1/T2",
    "mainstream_media": "T2", "social_post": "T3", "aggregator": "T2/T3", "unknown": "T3",
}
TIER_SCORES = {
    "score": {"T1": 100, "T1/T2": 90, "T2": 78, "T2/T3": 62, "T3": 45},
    "search": {"T1": 100, "T1/T2": 85, "T2": 70, "T2/T3": 55, "T3": 40},
    "view": {"primary_official": 100, "platform_official": 92, "industry_db": 85,
             "mainstream_media": 78, "social_post": 52, "aggregator": 40, "unknown": 35,
             "T1": 100, "T1/T2": 90, "T2": 78, "T2/T3": 62, "T3": 45},
}
TIER_SCORE_DEFAULTS = {"score": 40, "search": 40, "view": 35}
CREDIBILITY = {"T1": "high", "T1/T2": "medium_high", "T2": "medium", "T2/T3": "medium_low"}
TRACEABILITY_RANK = {"verified": 4, "matched": 3, "declared": 2, "unverified": 1, "missing": 0}
SOCIAL_PLATFORMS = ["微信公众号", "微信视频号", "小红书", "知识星球", "小报童", "知乎", "微博", "B站",
                    "抖音", "快手", "雪球", "韭研公社"]

# Ordered host rules for the evidence tier of an observed source.
EVIDENCE_TIER_HOSTS = [
    ("aggregator", ["weixin.sogou.com", "sogou.com", "bing.com", "google.com"]),
    ("primary_official",
     ["gov.cn", "ndrc.gov.cn", "miit.gov.cn", "stats.gov.cn", "pbc.gov.cn", "csrc.gov.cn",
      "sse.com.cn", "szse.cn", "cninfo.com.cn", "ccgp.gov.cn", "cebpubservice.com",
      "gsxt.gov.cn", "creditchina.gov.cn", "std.samr.gov.cn", "openstd.samr.gov.cn",
      "customs.gov.cn", "pss-system.cponline.cnipa.gov.cn"]),
    ("platform_official",
     ["developers.weixin.qq.com", "open.weixin.qq.com", "miniapp.xiaohongshu.com", "zsxq.com",
      "doc.zsxq.com", "xiaobot.net", "yuque.com", "flowus.cn", "feishu.cn", "notion.site",
      "github.com", "gitee.com", "modelscope.cn", "huggingface.co"]),
    ("industry_db",
     ["tianyancha.com", "qcc.com", "aiqicha.com", "itjuzi.com", "pedata.cn", "zero2ipo.com.cn",
      "crunchbase.com", "pitchbook.com", "patents.google.com", "soopat.com", "baiten.cn",
      "zhihuiya.com", "importgenius.com", "52wmb.com", "tradesparq.com", "cnki.net",
      "wanfangdata.com.cn", "scholar.google.com"]),
    ("social_post",
     ["mp.weixin.qq.com", "weixin.qq.com", "channels.weixin.qq.com", "xiaohongshu.com",
      "xueqiu.com", "jiuyangongshe.com", "zhihu.com", "weibo.com", "bilibili.com", "douyin.com",
      "kuaishou.com"]),
]
EVIDENCE_TIER_PACKS = [
    ("primary_official", ["official", "bidding"]),
    ("industry_db", ["pe_vc_db", "patent_ip", "corp_registry", "supply_chain", "academic_std"]),
    ("mainstream_media", ["news", "industry_report", "conference_expo"]),
    ("social_post", ["wechat", "xiaohongshu", "video_social", "community", "a_share"]),
    ("platform_official",
     ["wechat_ecosystem", "knowledge_community", "mini_program", "developer_signal",
      "recruiting"]),
]

# Ordered host rules for a page whose pack is unknown.
CAPTURE_TIER_HOSTS = [
    ("primary_official",
     ["gov.cn", "open.tencent.com", "sse.com.cn", "szse.cn", "cninfo.com.cn"]),
    ("industry_db", ["tianyancha.com", "qcc.com", "itjuzi.com", "pedata.cn", "crunchbase.com"]),
    ("mainstream_media",
     ["36kr.com", "cls.cn", "eastmoney.com", "stcn.com", "pedaily.cn", "leiphone.com"]),
    ("social_post",
     ["xiaohongshu.com", "mp.weixin.qq.com", "zhihu.com", "weibo.com", "xueqiu.com", "zsxq.com"]),
    ("aggregator", ["sogou.com", "bing.com", "baidu.com"]),
]

# Ordered host rules for the capture platform.
CAPTURE_PLATFORM_HOSTS = [
    ("xiaohongshu", ["xiaohongshu.com"]),
    ("zsxq", ["zsxq.com"]),
    ("wechat_open", ["open.weixin.qq.com", "developers.weixin.qq.com"]),
    ("yuque", ["yuque.com"]),
    ("feishu", ["feishu.cn"]),
    ("weixin", ["weixin.qq.com", "weixin.sogou.com"]),
]
