"""Company names: keys, clean-up, validity and extraction from headlines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import SPACE, as_column, bind, clean, literal_pattern, matches_any, strip
from factloom.rules import radar as R
from factloom.rules import text as T

_NOT_NAME = "[^0-9a-z\\u4e00-\\u9fff]+"
# Headline noise around a company name.
_EDGE = "《》【】「」『』“”‘’'\"：:，,；;｜|—\\- "
_NOISE = ("^(?:重磅|独家|快讯|消息|首发|聚焦|最新|官宣|融资快报|投融资观察|国产|国内|中国|一家|机器人企业|半导体企业|"
          "创新企业|科技企业)+[：:｜|\\s]*")
_LABEL = "^(?:融资|项目|快讯)[丨｜|：:\\s]+"
_LEAD_IN = "^(?:由|据悉|日前|近日)"
_DURATION = ("(?:不到|不足|超过|逾|仅用|用时|历时|在)?(?:近|过去|短短)?(?:半|一|两|二|三|四|五|六|七|八|九|十|\\d+)"
             "(?:年|个月|月|周|天)(?:内|间|来)?$")
_TAIL_VERB = "(?:宣布|完成|获得|获|通过|签署|中标|实现|启动|发布)$"
_QUOTED = ("[「『【“‘]([^」』】”’]{2,30})[」』】”’](?=.{0,18}(?:融资|量产|投产|中标|获批|发布|交付|认证|签署|递表|挂牌))",
           "《([^》]{2,30})》(?=.{0,18}(?:融资|量产|投产|中标|获批|发布|交付|认证|签署|递表|挂牌))")
_BEFORE_VERB = ("([A-Za-z][A-Za-z0-9 .·&_-]{1,28}|[\\u4e00-\\u9fffA-Za-z0-9·（）()]{2,30}?)(?:宣布)?"
                "(?:完成|获得|获|斩获|通过|签署|中标|实现|启动|发布|交付|投产|量产|递表|挂牌)")


def _strip_suffixes(key: Column, suffixes: list[str], repeat: bool) -> Column:
    # The lazy prefix keeps at least two characters and leaves the longest run of suffixes to the end.
    many = "+" if repeat else ""
    return F.regexp_replace(key, f"^(.{{2,}}?)(?:{'|'.join(suffixes)}){many}$", "$1")


def entity_key(value: Column | str) -> Column:
    """Key of a company in the deep report: no bracketed part, no punctuation, no legal suffixes."""
    text = F.lower(strip(F.coalesce(as_column(value), F.lit(""))))
    text = F.regexp_replace(F.regexp_replace(text, "[（(][^）)]{0,60}[）)]", ""), _NOT_NAME, "")
    return _strip_suffixes(text, T.LEGAL_SUFFIXES, repeat=True)


def radar_key(value: Column | str) -> Column:
    """Key of a company in the weekly radar."""
    text = F.regexp_replace(F.lower(clean(value)), "[（(][^）)]{0,40}[）)]", "")
    return _strip_suffixes(F.regexp_replace(text, _NOT_NAME, ""), T.RADAR_SUFFIXES, repeat=True)


def _word_key(word: str) -> str:
    """Radar key of a rule word, so that rule lists are plain values in the plan."""
    text = re.sub("[^0-9a-z\u4e00-\u9fff]+", "", re.sub("[（(][^）)]{0,40}[）)]", "", word.lower()))
    return re.sub(f"^(.{{2,}}?)(?:{'|'.join(T.RADAR_SUFFIXES)})+$", r"\1", text)


def grounding_key(value: Column | str) -> Column:
    """Token of a company (or of a whole page) for the test whether the page names it."""
    text = F.regexp_replace(F.lower(F.coalesce(as_column(value), F.lit(""))), SPACE + "+", "")
    text = F.regexp_replace(F.regexp_replace(text, "[（(][^）)]{0,60}[）)]", ""), _NOT_NAME, "")
    return _strip_suffixes(text, T.GROUNDING_SUFFIXES, repeat=False)


def is_grounded(entity: Column, page_text: Column) -> Column:
    """Whether a page names the company."""
    token = grounding_key(entity)
    return (F.length(token) >= 2) & F.contains(grounding_key(page_text), token)


def same_alias(left_key: Column, right_key: Column) -> Column:
    """Whether two radar keys name one company: equal, or one starts or ends with the other."""
    shorter = F.when(F.length(left_key) <= F.length(right_key), left_key).otherwise(right_key)
    longer = F.when(F.length(left_key) <= F.length(right_key), right_key).otherwise(left_key)
    near = ((F.length(shorter) >= 4) & (F.length(longer) - F.length(shorter) <= 4)
            & (F.startswith(longer, shorter) | F.endswith(longer, shorter)))
    return (left_key != "") & (right_key != "") & ((left_key == right_key) | near)


def tidy_company(value: Column | str) -> Column:
    """Clean a company name taken from a headline; at most 40 characters."""
    name = F.regexp_replace(clean(value), f"^[{_EDGE}]+|[{_EDGE}]+$", "")
    name = F.regexp_replace(F.regexp_replace(name, _NOISE, ""), _LABEL, "")
    name = strip(F.regexp_replace(name, _LEAD_IN, ""))
    name = strip(F.regexp_replace(name, _DURATION, ""))
    return F.substring(strip(F.regexp_replace(name, _TAIL_VERB, "")), 1, 40)


def is_company(name: Column, rules: R.RadarRules) -> Column:
    """Whether a cleaned name can be a company."""
    banned = sorted({_word_key(w) for w in rules.entity_stopwords + rules.mature_entities} - {""})
    good_key = bind(radar_key(name), lambda key: F.length(key).between(2, 30) & ~key.isin(banned) & ~key.rlike("^\\d+(?:\\.\\d+)?(?:亿|万|元)?$"))
    return good_key & ~matches_any(name, rules.generic_entities) & ~name.rlike(f"(?:{'|'.join(R.BAD_ENTITY_ENDINGS)})$")


def company_in_title(value: Column | str, rules: R.RadarRules) -> Column:
    """Company named by a headline: quoted, else before an event verb, else before a colon."""
    def named(title: Column) -> Column:
        quoted = [F.slice(F.regexp_extract_all(title, F.lit("(?i)" + p), F.lit(1)), 1, 1) for p in _QUOTED]
        verbs = F.regexp_extract_all(title, F.lit("(?i)" + _BEFORE_VERB), F.lit(1))
        verbs = F.transform(verbs, lambda m: F.element_at(F.split(m, "[：:｜|！!?，,；;]"), -1))
        colon = F.filter(F.array(F.regexp_extract(title, "^([^：:｜|]{2,30})[：:｜|]", 1)), lambda x: x != "")
        names = F.transform(F.concat(*quoted, verbs, colon), tidy_company)
        return F.try_element_at(F.filter(names, lambda n: is_company(n, rules)), F.lit(1))

    return bind(F.regexp_replace(clean(value), "\\s+-\\s+[^-]{1,40}$", ""), named)


def guess_entity(given: Column, query: Column, title: Column, host: Column) -> Column:
    """Entity of a source: the given name, a quoted query term, the head of the title, the host."""
    quoted = F.filter(F.transform(F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1)), strip),
                      lambda x: x != "")
    head = strip(F.element_at(F.split(title, "[-|｜_]"), 1))
    site = F.replace(F.when(host != "", host).otherwise("未识别实体"), F.lit("www."), F.lit(""))
    return F.coalesce(F.when(strip(given) != "", strip(given)),
                      F.substring(F.try_element_at(quoted, F.lit(1)), 1, 80),
                      F.when(title != "", F.substring(head, 1, 80)), site)


def account_key(name: Column, account_id: Column) -> Column:
    """Key of an account: its id, else its name without blanks and case."""
    return F.when(account_id != "", F.concat(F.lit("fakeid:"), F.lower(account_id))).otherwise(
        F.concat(F.lit("name:"), F.lower(F.regexp_replace(name, SPACE + "+", ""))))


def usable_followup(name: Column) -> Column:
    """Whether a name can seed a follow-up: 2 to 24 characters, two Han, no product words."""
    han = F.regexp_count(name, F.lit("[\\u4e00-\\u9fff]"))
    rejected = literal_pattern([w.lower() for w in R.FOLLOWUP_REJECTED])
    return F.coalesce(F.length(name).between(2, 24) & (han >= 2) & ~F.lower(name).rlike(rejected)
                      & ~name.rlike(f"^(?:{'|'.join(R.FOLLOWUP_PLACEHOLDERS)})"), F.lit(False))


def followup_company(title: Column, account: Column, rules: R.RadarRules) -> Column:
    """Company of a lead: from its title, else its account name; '' when neither can be used."""
    usable = lambda name: F.when(usable_followup(name), name)
    return F.coalesce(bind(company_in_title(title, rules), usable), bind(clean(account), usable), F.lit(""))



