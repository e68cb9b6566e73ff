"""URLs: parts, canonical forms, nested targets, safety classes and host rules."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import (as_column, bind, constant_map, constant_rules, literal_pattern,
                                    redact_quoted, strip, unescape)
from factloom.rules import sources as S
from factloom.rules import text as T

_URL = "(?i)^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"
_FIND = "(?i)https?://[^\\s<>\"']+"
_TRAILING = "[\\t\\r\\n .,;:!?，。；：！？、)\\]}〉》」』]+$"
_CONTROL = "[\\x00-\\x1f\\x7f]"


def web_url(value: Column | str) -> Column:
    """The trimmed text when it is an http(s) URL, else ''."""
    text = strip(F.coalesce(as_column(value), F.lit("")))
    return F.when(text.rlike("(?i)^https?://"), text).otherwise("")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 4), F.lit(""))


def host(url: Column | str) -> Column:
    """Lowercase host name of an http(s) URL, without user-info, port and final dots."""
    raw = F.lower(F.regexp_extract(as_column(url), "(?i)^https?://(?:[^/?#]*@)?(\\[[^\\]]*\\]|[^/?#:]*)", 1))
    return F.regexp_replace(F.regexp_replace(raw, "^\\[|\\]$", ""), "\\.+$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), ":(\\d+)$", 1)


def host_matches(name: Column, target: Column | str) -> Column:
    """Whether a host is the target or below it."""
    goal = F.lit(target) if isinstance(target, str) else target
    return (name == goal) | F.endswith(name, F.concat(F.lit("."), goal))


def host_in(name: Column, targets: list[str]) -> Column:
    """Whether a host is one of the targets or below one."""
    return F.coalesce(name.rlike(f"(?:^|\\.)(?:{literal_pattern(targets)})$"), F.lit(False))


def host_suffixes(name: Column) -> Column:
    """All suffixes of a host at label borders, longest first."""
    labels = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def by_host(name: Column, rules: list[tuple[str, list[str]]], default: str | Column) -> Column:
    """Label of the first host rule that matches a suffix of the host."""
    first: dict[str, str] = {}
    for order, (label, hosts) in enumerate(rules):
        for target in hosts:
            first.setdefault(target, f"{order:04d}{label}")
    hits = F.transform(host_suffixes(name), lambda s: F.try_element_at(constant_map(first), s))
    best = F.array_min(F.filter(hits, lambda h: h.isNotNull()))
    return F.coalesce(F.substring(best, 5, 200), F.lit(default) if isinstance(default, str) else default)


def percent_decode(value: Column | str) -> Column:
    """Percent-decode; '+' and broken escapes stay as they are."""
    safe = F.regexp_replace(F.replace(as_column(value), F.lit("+"), F.lit("%2B")),
                            "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), as_column(value))


def form_decode(value: Column) -> Column:
    """Decode one form value: '+' is a blank."""
    return percent_decode(F.replace(value, F.lit("+"), F.lit(" ")))


def form_encode(value: Column) -> Column:
    """Encode one form value."""
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(text: Column) -> Column:
    """Decoded (k, v) pairs of a query string that have a value, in order."""
    parts = F.filter(F.split(text, "&"), lambda p: F.length(F.regexp_extract(p, "^[^=]*=(.*)$", 1)) > 0)
    return F.transform(parts, lambda p: F.struct(
        form_decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"),
        form_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))


def _kept_query(pairs: Column, keys: list[str]) -> Column:
    """Query string of the wanted keys in their given order, each with its last value."""
    if not keys:
        return F.lit("")

    def part(key: Column) -> Column:
        last = F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]
        return F.concat(key, F.lit("="), form_encode(last))

    parts = F.filter(F.transform(F.array(*map(F.lit, keys)), part), lambda x: x.isNotNull())
    return F.array_join(parts, "&")


def link_text(value: Column | str) -> Column:
    """The text of a link without quotes around it, with plain slashes and ampersands, and with a scheme."""
    raw = F.replace(F.regexp_replace(strip(F.coalesce(as_column(value), F.lit(""))), "^['\"]+|['\"]+$", ""),
                    F.lit("\\/"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(raw, "(?i)&amp;|&#(?:38|x26);", "&"), "^//", "https://")


def canonical_url(value: Column | str, hosts: list[str] | None = None,
                  path_pattern: str | None = None, identity_keys: list[str] | None = None,
                  temporary_keys: list[str] | None = None,
                  bare_path: str | None = None) -> Column:
    """Struct (url, reason): the canonical https form of an article URL, or why it is rejected.

    Kept are the identity keys in their fixed order, else the temporary-link keys.  ``hosts=None``
    takes any host; ``bare_path`` is the path that is no article without a query.
    """
    identity_keys, temporary_keys = identity_keys or [], temporary_keys or []
    raw = link_text(value)

    def parts(r: Column) -> Column:
        pairs = query_pairs(query(r))
        return F.struct(
            r.alias("raw"), host(r).alias("name"), authority(r).alias("place"),
            F.regexp_replace(F.when(path(r) == "", "/").otherwise(path(r)), "/{2,}", "/").alias("where"),
            bind(pairs, lambda p: F.struct(_kept_query(p, identity_keys).alias("i"),
                                           _kept_query(p, temporary_keys).alias("t"))).alias("kept"))

    def judge(x: Column) -> Column:
        kept = F.when(x["kept"]["i"] != "", x["kept"]["i"]).otherwise(x["kept"]["t"])
        reason = F.when(x["raw"].rlike("\\$\\{|\\{\\{"), "placeholder")
        reason = reason.when(~x["raw"].rlike("(?i)^https?://"), "scheme")
        reason = reason.when((x["name"] == "") if hosts is None else ~x["name"].isin(hosts), "host")
        reason = reason.when(F.contains(x["place"], F.lit("@")), "user_info")
        if path_pattern:
            reason = reason.when(~x["where"].rlike(path_pattern), "path")
        if bare_path:
            reason = reason.when((x["where"] == bare_path) & (kept == ""), "identity")
        reason = reason.when(~F.regexp_extract(x["place"], ":([^:\\]]*)$", 1).isin("", "80", "443"), "port")
        tail = F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")
        url = F.concat(F.lit("https://"), x["name"], x["where"], tail)
        return bind(reason, lambda why: F.struct(F.when(why.isNull(), url).alias("url"), why.alias("reason")))

    return bind(bind(raw, parts), judge)


def article_url(value: Column | str) -> Column:
    """Struct (url, reason) for public-account articles."""
    return canonical_url(value, [T.ARTICLE_HOST], "^(?:/s$|/s/|/mp/)", T.IDENTITY_QUERY_KEYS,
                         T.TEMPORARY_QUERY_KEYS, bare_path="/s")


# A link of an article in which nothing is encoded or to be encoded (but '=' in a value).
_PLAIN_ARTICLE = f"^https?://{T.ARTICLE_HOST.replace('.', '[.]')}/s(?:/[A-Za-z0-9_-]+)?[?][A-Za-z0-9_.=&-]*(?:#[A-Za-z0-9_.=&-]*)?\\z"


def query_of_plain_article(text: Column) -> Column:
    """Query of a :func:`link_text` between '&', if it is a plain link of an article with every identity key it has filled; else NULL."""
    asked = F.concat(F.lit("&"), F.substring_index(F.substring_index(text, "#", 1), "?", -1), F.lit("&"))
    return F.when(text.rlike(_PLAIN_ARTICLE) & ~asked.rlike(f"&(?:{'|'.join(T.IDENTITY_QUERY_KEYS)})=&"), asked)


def plain_article(text: Column, asked: Column) -> Column:
    """The form that :func:`article_url` gives a plain link, read without lambdas; NULL if it is none or has no identity key."""
    def part(key: str) -> Column:
        value = F.substring_index(F.substring_index(asked, f"&{key}=", -1), "&", 1)
        return F.when(F.contains(asked, F.lit(f"&{key}=")), F.concat(F.lit(f"{key}="), F.replace(value, F.lit("="), F.lit("%3D"))))

    keys = T.IDENTITY_QUERY_KEYS
    some = functools.reduce(lambda x, y: x | y, [F.contains(asked, F.lit(f"&{k}=")) for k in keys])
    place = F.substring_index(F.substring_index(text, "?", 1), "://", -1)
    return F.when(some, F.concat(F.lit("https://"), place, F.lit("?"), F.concat_ws("&", *map(part, keys))))


def strict_url(value: Column | str, hosts: list[str], secret_keys: list[str] | None = None) -> Column:
    """Struct (url, reason): https only, exact host, an article path, no secrets in the query."""
    text = strip(F.coalesce(as_column(value), F.lit("")))
    keys = F.transform(F.split(query(text), "&"), lambda p: F.lower(form_decode(F.regexp_extract(p, "^([^=]*)", 1))))
    secret = F.exists(keys, lambda k: k.isin(secret_keys or T.SENSITIVE_QUERY_KEYS))
    reason = (F.when((text == "") | text.rlike("[\\x00-\\x1f]"), "empty or control-character URL")
              .when(scheme(text) != "https", "only https URLs are allowed")
              .when(~F.lower(authority(text)).isin(hosts), "host is not allowed")
              .when(path(text).isin("", "/"), "article path is required")
              .when(secret, "credential-like query parameters are not allowed"))
    url = F.concat(F.lit("https://"), F.lower(authority(text)), path(text),
                   F.when(query(text) != "", F.concat(F.lit("?"), query(text))).otherwise(""))
    return F.struct(F.when(reason.isNull(), url).alias("url"), reason.alias("reason"))


def listed_url(value: Column | str, hosts: list[str], path_pattern: str) -> Column:
    """https form of a URL with an allowed host and path; the query stays; NULL otherwise."""
    text = strip(F.coalesce(as_column(value), F.lit("")))
    extra = F.when(port(text).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port(text)))
    url = F.concat(F.lit("https://"), host(text), extra, F.when(path(text) == "", "/").otherwise(path(text)),
                   F.when(query(text) != "", F.concat(F.lit("?"), query(text))).otherwise(""))
    return F.when(host(text).isin(hosts) & path(text).rlike(path_pattern), url)


def _variants(value: Column) -> Column:
    """A text and up to two further percent-decodings of it, ordered distinct."""
    raw = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), "^['\"]+|['\"]+$", "")
    bad = ((raw == "") | (F.length(raw) > 50_000) | raw.rlike("[\\x00\\r\\n]")
           | raw.rlike("(?i)%(?:0[0-9a-f]|1[0-9a-f]|7f)"))
    start = F.array(F.replace(unescape(raw), F.lit("\\/"), F.lit("/")))
    # Each round decodes the last entry; a decoded text with control characters ends the list.
    def grow(found: Column, _round: Column) -> Column:
        step = percent_decode(F.element_at(found, -1))
        return F.when((step == F.element_at(found, -1)) | step.rlike(_CONTROL), found).otherwise(
            F.concat(found, F.array(step)))

    clean = F.filter(start, lambda x: ~x.rlike(_CONTROL))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(2)), clean, grow)
    return F.when(bad | (F.size(clean) == 0), F.array().cast("array<string>")).otherwise(F.array_distinct(rounds))


def url_candidates(value: Column | str) -> Column:
    """URLs inside a text, ordered distinct: itself, found ones, and targets of redirect wrappers."""

    def of_variant(variant: Column) -> Column:
        whole = variant.rlike("(?i)^https?://[^\\s<>\"']+$") & (host(variant) != "")
        found = F.regexp_extract_all(variant, F.lit(_FIND), F.lit(0))
        targets = F.filter(query_pairs(query(variant)), lambda p: F.lower(p["k"]).isin(T.REDIRECT_QUERY_KEYS))
        nested = F.flatten(F.transform(targets, lambda p: _variants(p["v"])))
        return F.when(whole, F.concat(F.array(variant), found, nested)).otherwise(found)

    raw = F.flatten(F.transform(_variants(as_column(value)), of_variant))
    cleaned = F.transform(raw, lambda u: F.regexp_replace(strip(u), _TRAILING, ""))
    return F.array_distinct(F.filter(cleaned, lambda u: u != ""))


def discovered_article_url(value: Column | str) -> Column:
    """First canonical article URL found in a text or redirect wrapper; NULL when there is none."""
    hits = F.transform(url_candidates(value), lambda u: F.when(
        ~F.contains(authority(u), F.lit("@")), article_url(u)["url"]))
    good = F.filter(hits, lambda u: u.isNotNull() & (path(u).rlike("^/s(?:$|/)")))
    return F.try_element_at(good, F.lit(1))


def looks_like_article(value: Column | str) -> Column:
    """Whether a text names the article host, plain or escaped."""
    return F.coalesce(as_column(value).rlike("(?i)mp(?:\\.|%2e)weixin(?:\\.|%2e)qq(?:\\.|%2e)com"), F.lit(False))


def safety_class(value: Column | str) -> Column:
    """'public', or why a URL must not be fetched: scheme, host, user_info, localhost, private_ip."""
    url = web_url(value)
    name = host(url)
    octets = F.transform(F.split(name, "\\."), lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int")))
    is_v4 = name.rlike("^(?:(?:0|[1-9]\\d{0,2})\\.){3}(?:0|[1-9]\\d{0,2})$") & (F.array_max(octets) <= 255)
    a, b, c = (F.try_element_at(octets, F.lit(i)) for i in (1, 2, 3))
    d = F.try_element_at(octets, F.lit(4))
    private4 = (a.isin(0, 10, 127) | (a >= 240) | ((a == 100) & b.between(64, 127))
                | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
                | ((a == 192) & (b == 0) & (c == 0) & ~d.isin(9, 10)) | ((a == 192) & (b == 0) & (c == 2))
                | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100))
                | ((a == 203) & (b == 0) & (c == 113)))
    # Literal IPv6: only the global unicast block without its special parts is public.
    is_v6 = F.contains(name, F.lit(":"))
    public6 = name.rlike("^[23][0-9a-f]{3}:") & ~name.rlike("^(?:2001:0?db8:|2001:0{0,4}:|2001:0?0?0?[0-9a-f]{1,2}:|"
                                                          "2001:0?1[0-9a-f]{2}:|2002:|3fff:)")
    place = F.regexp_replace(authority(url), "^.*@", "")
    digits = F.regexp_extract(place, ":([^:\\]]*)$", 1)
    bad_port = digits.rlike("[^0-9]") | (F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0)) > 65535)
    return (F.when(url == "", "scheme").when((name == "") | bad_port, "host")
            .when(F.contains(authority(url), F.lit("@")), "user_info")
            .when((name == "localhost") | F.endswith(name, F.lit(".localhost")), "localhost")
            .when(F.coalesce(is_v4 & private4, F.lit(False)) | (is_v6 & ~public6), "private_ip")
            .otherwise("public"))


def has_secret_query(value: Column | str) -> Column:
    """Whether a query string has a credential-like key."""
    keys = F.transform(F.split(query(as_column(value)), "&"),
                       lambda p: F.lower(form_decode(F.regexp_extract(p, "^([^=]*)", 1))))
    return F.coalesce(F.exists(keys, lambda k: k.isin(T.SENSITIVE_QUERY_KEYS)), F.lit(False))


def reportable_url(value: Column | str) -> Column:
    """A URL that may be shown in a report, else a mark."""
    text = strip(F.coalesce(as_column(value), F.lit("")))
    hidden = has_secret_query(text) | (redact_quoted(text) != text)
    return F.when(hidden, "[REDACTED_INVALID_URL]").otherwise(F.substring(text, 1, 1000))


def url_hint(value: Column | str) -> Column:
    """Scheme, host and path only."""
    text = strip(F.coalesce(as_column(value), F.lit("")))
    return F.when(host(text) != "", F.concat(scheme(text), F.lit("://"), host(text),
                                             F.substring(path(text), 1, 160))).otherwise("invalid-url")


def source_pack(name: Column) -> Column:
    """Struct (pack, label, tier) of a host: best tier first, then the pack key."""
    score = S.TIER_SCORES["search"]
    ranked = sorted(S.SOURCE_PACKS, key=lambda p: (-score.get(p[2], 40), p[0]))
    pack = by_host(name, [(key, hosts) for key, _, _, hosts in ranked], "")
    labels, tiers = {p[0]: p[1] for p in S.SOURCE_PACKS}, {p[0]: p[2] for p in S.SOURCE_PACKS}
    return F.struct(pack.alias("pack"),
                    F.coalesce(F.try_element_at(constant_map(labels), pack), F.lit("未知来源")).alias("label"),
                    F.coalesce(F.try_element_at(constant_map(tiers), pack), F.lit("T3")).alias("tier"))


def platform(name: Column) -> Column:
    """Display platform of a host (suffix rules); the host itself when no rule matches."""
    return by_host(name, [(label, [h]) for h, label in S.PLATFORMS],
                   F.when(name != "", name).otherwise("未知来源"))


def score_platform(name: Column) -> Column:
    """Display platform of a host while scoring (substring rules)."""
    hits = F.filter(constant_rules(S.SCORE_PLATFORMS), lambda r: F.contains(name, r["key"]))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["label"], F.when(name != "", name), F.lit("未知来源"))


def capture_platform(name: Column) -> Column:
    """Platform key of a captured page."""
    return by_host(name, S.CAPTURE_PLATFORM_HOSTS, "general")


def evidence_tier(name: Column, pack: Column, tier: Column) -> Column:
    """Evidence tier of an observed source: host rules, then its pack, then its tier."""
    packs: Column = F.when(F.lit(False), "")
    for label, keys in S.EVIDENCE_TIER_PACKS:
        packs = packs.when(pack.isin(keys), label)
    rest = packs.when(tier.isin("T1", "T1/T2", "T2"), "mainstream_media").otherwise("unknown")
    return by_host(name, S.EVIDENCE_TIER_HOSTS, rest)


def capture_tier(name: Column) -> Column:
    """Evidence tier of a page when only its host is known."""
    return by_host(name, S.CAPTURE_TIER_HOSTS, "unknown")


def domain_tier(name: Column) -> Column:
    """Tier hint of a host while scoring; NULL when there is none."""
    return by_host(name, [(tier, [h]) for h, tier in S.DOMAIN_TIERS], F.lit(None).cast("string"))


def normal_tier(tier: Column, name: Column) -> Column:
    """Tier in the T alphabet: as given, by alias, by host, else T3."""
    raw = strip(F.coalesce(tier, F.lit("")))
    alias = constant_map(S.TIER_ALIASES)
    return (F.when(raw.isin(list(S.TIER_SCORES["score"])), raw)
            .otherwise(F.coalesce(F.try_element_at(alias, F.lower(raw)), domain_tier(name), F.lit("T3"))))


def tier_score(tier: Column, profile: str = "score") -> Column:
    """Score of a tier in a profile: ``score``, ``search`` or ``view``."""
    table = constant_map(S.TIER_SCORES[profile])
    known = F.try_element_at(table, F.when(tier != "", tier).otherwise("T3"))
    return F.coalesce(known, F.lit(S.TIER_SCORE_DEFAULTS[profile]))


def credibility(tier: Column) -> Column:
    """Credibility label of a tier."""
    table = constant_map(S.CREDIBILITY)
    return F.coalesce(F.try_element_at(table, tier), F.lit("low"))


def classify(value: Column | str) -> Column:
    """Struct of what a URL itself says: domain, pack, label, tier, credibility, platform."""
    url = web_url(value)
    name = host(url)
    pack = source_pack(name)
    return F.struct(url.alias("source_url"), name.alias("domain"), pack["pack"].alias("source_pack"),
                    pack["label"].alias("source_pack_label"), pack["tier"].alias("source_tier"),
                    credibility(pack["tier"]).alias("credibility"), platform(name).alias("platform"))
