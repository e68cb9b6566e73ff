import html
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import entity as E
from factloom.functions import html as H
from factloom.functions import labels as L
from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.functions import url as U
from factloom.rules import text as T
from factloom.rules.radar import RadarRules

X_SPACE = re.compile(r"\s+")


def test_clean_text(evaluate):
    got = evaluate(X.clean, [" a　 b\n&amp;&#20013;&#x56fd; ", None, "&zzz; x&y"])
    assert got == ["a b &中国", "", "&zzz; x&y"]


@pytest.mark.parametrize("decode", [X.unescape, X.clean], ids=["unescape", "clean"])
def test_every_character_reference(evaluate, decode):
    """All names of the HTML list, and numbers at all borders, against Python's table."""
    texts = [f"&{n}" for n in html5] + [f"a&{n}b &{n.rstrip(';')}{n.rstrip(';')}; &{n[:-1]}=1" for n in html5]
    borders = [0, 1, 8, 9, 10, 11, 13, 14, 31, 32, 65, 126, 127, 128, 129, 150, 159, 160, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000]
    texts += [form % n + tail for n in [*borders, 10**6, 10**8, 10**30] for form in ("&#%d", "&#x%X", "&#X000%x", "&#0000%d") for tail in ("", ";", ";;", "z", "&")]
    texts += ["&", "&&", "&;", "&#;", "&#x;", "&#xg;", "& amp;", "&amp;lt;", "&ampé", "&notit;", "&" + "n" * 40 + ";", "x&T y&lt", "&\U0001f600;", "&amp\u3000;", "&#12&#13;"]
    want = [html.unescape(t) for t in texts]
    if decode is X.clean:
        want = [X_SPACE.sub(" ", t).strip(" ") for t in want]
    assert evaluate(decode, texts) == want


def test_title_key(evaluate):
    assert evaluate(X.title_key, ["起点 Photonics：量产-2!"]) == ["起点photonics量产2"]


def test_optional_metadata_and_allow_list(evaluate):
    assert evaluate(lambda c: X.optional_metadata(c, 20), ["N/A", "未知", " 张三 "]) == ["", "", "张三"]
    assert evaluate(lambda c: X.allow_listed(c, T.CREDENTIAL_STATUSES, "not_stored"),
                    ["Not Required", "other", None]) == ["not_required", "not_stored", "not_stored"]


def test_redaction(evaluate):
    got = evaluate(X.redact, ["x token = abc123, ok", "Authorization: Bearer z", "tokens are fine"])
    assert got == ["x token=[redacted], ok", "Authorization=[redacted] z", "tokens are fine"]
    assert evaluate(X.redact_quoted, ['{"token": "a b"} and key=1;']) == [
        '{token=[REDACTED]} and key=[REDACTED];']


def test_keywords(evaluate):
    assert evaluate(X.focus_terms, ["芯片, 光电、芯片/AI\nai"]) == [["芯片", "光电", "AI"]]
    assert evaluate(X.brief_keywords, ["寻找早期半导体，优先关注订单。a；中国；量产 公司"]) == [
        ["寻找早期半导体", "量产 公司"]]
    assert evaluate(X.site_terms, ["site:A.com x site:b.cn site:a.com"]) == [["a.com", "b.cn"]]
    assert evaluate(lambda c: X.research_terms(c), ["  "]) == [[""]]


def test_claim_and_sector(evaluate):
    assert evaluate(X.claim_type, ["公司融资并签约", "CEO 发言", "无"]) == [
        "partnership_signal", "founder_signal", "product_signal"]
    assert evaluate(X.sector_type, ["FPGA 云", "SaaS 数据", "x"]) == ["semiconductor", "software", "default"]


def test_suffixes_go_until_none_is_left(evaluate):
    names = {"北辰光电有限公司": "北辰光电", "北辰光电集团有限公司": "北辰光电", "北辰集团股份有限公司": "北辰", "北辰公司公司": "北辰",
             "北公司": "北公司", "公司": "公司", "有限公司": "有限",  # two characters stay at least
              "orionincltd": "orion", "xinc": "xinc", "北辰公司科技": "北辰公司科技"}
    assert evaluate(E.entity_key, list(names)) == list(names.values())
    names = {"南岳控股集团": "南岳", "南岳股份公司": "南岳", "南岳控股": "南岳", "岳控股": "岳控股", "南岳inc": "南岳inc"}
    assert evaluate(E.radar_key, list(names)) == list(names.values())


def test_entity_keys(evaluate):
    assert evaluate(E.entity_key, ["视觉智能科技（上海）有限公司", "Acme Co.,Ltd", None]) == [
        "视觉智能科技", "acme", ""]
    assert evaluate(E.account_key.__wrapped__ if hasattr(E.account_key, "__wrapped__") else
                    (lambda c: E.account_key(F.col(c), F.lit(""))), ["硬 科技 A"]) == ["name:硬科技a"]


def test_company_from_headline(evaluate):
    rules = RadarRules(entity_stopwords=["中国", "行业", "公司", "项目"])
    got = evaluate(lambda c: E.company_in_title(c, rules), [
        "“智元系”发力具身智能数据平台基建，觅蜂科技半年完成三轮融资",
        "「甲芯半导体」完成A轮融资", "星河动力：新品上线", "行业完成融资", "独家｜乙光电宣布完成融资 - 新闻网"])
    assert got == ["觅蜂科技", "甲芯半导体", "星河动力", None, "乙光电"]


PAGE = "https://mp.weixin.qq.com/s"


def test_article_url(evaluate):
    rows = [  # what is given, what is left of it, why it is refused
        (PAGE + "?chksm=9f&sn=e4d1&mid=2650&__biz=Mjk0%3D%3D&idx=3&scene=21#rd", PAGE + "?__biz=Mjk0%3D%3D&mid=2650&idx=3&sn=e4d1", None),
        ("http" + PAGE[5:] + "?idx=3&amp;sn=e4d1&amp;__biz=Mjk0%3D%3D&amp;mid=2650&amp;version=4", PAGE + "?__biz=Mjk0%3D%3D&mid=2650&idx=3&sn=e4d1", None),
        (PAGE + "/Ab_9-z?poc_token=q1", PAGE + "/Ab_9-z", None), (PAGE + "?sn=", None, "identity"), (PAGE.replace(".com", ".com.cn") + "/Ab", None, "host"),
        (PAGE.replace("//", "//reader:pw@") + "/Ab", None, "user_info"), (PAGE.replace(".com", ".com:444") + "/Ab", None, "port"), (PAGE + "/${slug}", None, "placeholder"),
        (PAGE + "?new=1&signature=x%2By&ver=2&timestamp=1699999999&src=3", PAGE + "?src=3&timestamp=1699999999&ver=2&signature=x%2By&new=1", None),
        (PAGE + "?mid=5&__biz=first&idx=&__biz=last+one", PAGE + "?__biz=last+one&mid=5", None)]
    got = evaluate(U.article_url, [r[0] for r in rows])
    assert [(r["url"], r["reason"]) for r in got] == [r[1:] for r in rows]


def test_discovered_url(evaluate):
    kept = PAGE + "?__biz=Mjk0&mid=2650&idx=3&sn=e4d1"
    good = {kept + "&from=groupmessage": kept, "http" + PAGE[5:] + "/Ab_9-z?k=v#top": PAGE + "/Ab_9-z",
            "https://out.example.net/jump?id=4&target=https%3A%2F%2Fmp.weixin.qq.com%2Fs%2FAb_9-z%3Fk%3Dv": PAGE + "/Ab_9-z"}
    refused = [PAGE.replace("mp.", "mp-") + "/Ab", PAGE.replace(".com", ".com@10.1.2.3") + "/Ab", "https://10.1.2.3/s/Ab", PAGE[:-1] + "mp/profile_ext?action=home", PAGE, PAGE + "/{{id}}",
               PAGE + "/Ab%0aX-Header:1", "https://out.example.net/jump?target=http%3A%2F%2F10.1.2.3%2Fs%2FAb"]
    assert evaluate(U.discovered_article_url, [*good, *refused]) == [*good.values(), *[None] * len(refused)]


def test_safety(evaluate):
    values = ["http://127.0.0.1/admin", "http://10.0.0.5/data", "http://172.16.0.1/data",
              "http://192.168.1.5/data", "http://169.254.169.254/latest/meta-data", "http://[::1]/",
              "http://localhost/", "https://8.8.8.8/x", "https://a.example.com/", "ftp://x", "https:///x",
              "https://u:p@a.com/", "http://[2001:4860:4860::8888]/", "http://1.2.3.4.5/"]
    assert evaluate(U.safety_class, values) == ["private_ip"] * 6 + [
        "localhost", "public", "public", "scheme", "host", "user_info", "public", "public"]


def test_host_rules(evaluate):
    got = evaluate(lambda c: U.source_pack(F.col(c)), ["www.gov.cn", "qcc.com", "cninfo.com.cn", "a.b"])
    assert [(r["pack"], r["tier"]) for r in got] == [
        ("official", "T1"), ("corp_registry", "T1"), ("official", "T1"), ("", "T3")]
    assert evaluate(lambda c: U.platform(F.col(c)), ["channels.weixin.qq.com", "x.zhihu.com", "q.org", ""]) == [
        "微信公众号", "知乎", "q.org", "未知来源"]
    assert evaluate(lambda c: U.normal_tier(F.col(c), F.lit("36kr.com")), ["T1", "Aggregator", "", None]) == [
        "T1", "T2/T3", "T2", "T2"]
    assert evaluate(lambda c: U.capture_platform(F.col(c)), ["open.weixin.qq.com", "mp.weixin.qq.com", "z"]) == [
        "wechat_open", "weixin", "general"]
    assert evaluate(lambda c: U.host_suffixes(F.col(c)), ["a.b.cn"]) == [["a.b.cn", "b.cn", "cn"]]


def test_strict_and_listed_urls(evaluate):
    got = evaluate(lambda c: U.strict_url(c, [T.ARTICLE_HOST]), [
        "https://mp.weixin.qq.com/s/a?x=1#f", "http://mp.weixin.qq.com/s/a", "https://mp.weixin.qq.com/s?Token=1",
        "https://mp.weixin.qq.com/"])
    assert [r["url"] for r in got] == ["https://mp.weixin.qq.com/s/a?x=1", None, None, None]
    assert evaluate(lambda c: U.listed_url(c, [T.ARTICLE_HOST], "^(?:/s|/mp/)"), [
        "http://mp.weixin.qq.com/s/a?x=1#f", "https://mp.weixin.qq.com/q"]) == [
        "https://mp.weixin.qq.com/s/a?x=1", None]
    assert evaluate(U.reportable_url, ["https://a.b/c?token=1", "https://a.b/c?x=1"]) == [
        "[REDACTED_INVALID_URL]", "https://a.b/c?x=1"]
    assert evaluate(U.url_hint, ["https://a.b/c?token=1", "x"]) == ["https://a.b/c", "invalid-url"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai", "America/New_York"])
def test_dates_do_not_depend_on_the_session_zone(spark, evaluate, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        values = ["1787184000", "1787184000000", "2026-08-20", "2026-08-20T23:30:00Z", "2026-08-20 02:00:00+08:00",
                  "Thu, 20 Aug 2026 02:00:00 GMT", "发布于2026年8月20日", "2026-02-30", "", "soon"]
        days = [str(d) if d else None for d in evaluate(D.any_local_date, values)]
        assert days == ["2026-08-20", "2026-08-20", "2026-08-20", "2026-08-21", "2026-08-20", "2026-08-20",
                        "2026-08-20", None, None, None]
        assert evaluate(D.iso_text, ["2026-08-21T03:00:00Z", "2026-08-21", "2026-08-21 later", "x"]) == [
            "2026-08-21T03:00:00+00:00", "2026-08-20T16:00:00+00:00", "2026-08-21 later", ""]
        assert evaluate(D.fact_epoch, ["2026年8月", "2026.8.20", "2026-08-20T01:00:00.5"]) == [
            D.to_epoch("2026-08-01"), D.to_epoch("2026-08-20"), D.to_epoch("2026-08-20T01:00:00")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_age_and_future(spark):
    now = D.to_epoch("2026-08-21")
    frame = spark.createDataFrame([("2026-08-20", None), ("2026-09-01", "2026-08-01"), (None, "2025-08-21")],
                                  "event string, published string")
    out = frame.select(D.age_days(D.scoreable_epoch(F.col("event"), F.col("published"), now), now)).collect()
    assert [r[0] for r in out] == [1, None, 365]


def test_html(evaluate):
    page = ("<html><head><title>T &amp; x</title><script>var a='</p>';</script></head><body><nav>menu</nav>"
            "<article><h1>H</h1><p>one<b>two</b></p><!-- no --></article><footer>f</footer></body></html>")
    assert evaluate(H.page_title, [page, "<meta property='og:title' content='OG'>" + page, ""]) == ["T & x", "OG", ""]
    assert evaluate(H.page_text, [page]) == ["H one two"]
    assert evaluate(H.page_published, ["<script>var ct = \"1787184000\"</script>", "'publish_time':'never'"]) == [
        "1787184000", None]
    article = "<strong class=\"profile_nickname\">号 主</strong><div id='js_content'><p>正文</p></div>"
    assert evaluate(H.page_publisher, [article, ""]) == ["号 主", "微信公众号"]
    assert evaluate(H.article_text, [article]) == ["正文"]


def test_title_cut_inside_a_reference(evaluate):
    page = "<title>a &amp;&lt;b&hellip; &notit; x &amp</title>"
    assert evaluate(H.page_title, [page]) == ["a &<b… ¬it; x &"]
    assert evaluate(lambda c: H.page_title(c, terminated=True), [page]) == ["a &<b… &notit; x &amp"]


def test_text_cut_inside_a_reference(evaluate):
    page = "<body><article><p>a &gt; b &am</p><p>c &amp</p></article></body>"
    assert evaluate(H.page_text, [page]) == ["a > b &am c &"]
    assert evaluate(lambda c: H.page_text(c, terminated=True), [page]) == ["a > b &am c &amp"]


def test_references_of_some_names_only(evaluate):
    names = ("quot;", "amp;", "amp", "dollar;", "bsol;")
    assert evaluate(lambda c: X.clean(c, names=names), ["a &quot; &quot &lt; &#39;", "&amp;quot; &ampquot; &amp;amp &ampamp;", "&dollar;1 &bsol;0", None]) == ["a \" &quot &lt; &#39;", "&quot; &quot; &amp &amp;", "$1 \\0", ""]


def test_numbers(evaluate):
    assert evaluate(N.lenient_long, ["1,234", "3.9", "x", "", None, "-2"]) == [1234, 3, None, None, None, -2]
    assert evaluate(N.lenient_bool, ["1", "Yes", "deleted", "0", None]) == [True, True, True, False, False]
    assert evaluate(N.stage_fit, ["天使轮", "A+轮", "B轮", "C轮", "Pre-IPO", "", "成长"]) == [5, 4, 3, 2, 1, 2, 3]
    assert evaluate(N.percentage, ["毛利率达 45.5 %", "x"]) == [45.5, None]

    assert [r for r in evaluate(lambda c: N.score_bucket(F.col(c)), [78.0, 44.9], "x double")] == ["最终推荐", "低优先级"]


def test_labels(evaluate):
    assert evaluate(lambda c: L.claim_label(F.col(c)), ["risk_signal", "zz", ""]) == ["风险信号", "zz", "未分类"]
    assert evaluate(lambda c: L.platform_label(F.lit("general"), F.col(c)), ["https://www.gov.cn/a", "https://q.z/1"]) == [
        "政府/监管", "q.z"]
