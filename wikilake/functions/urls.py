"""URL columns.  All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters, rules of share links, hosts of site modules in order of priority, shapes of URLs of apps.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_src")
PARTS = r"^(?i)(https?)://([^/?#]*)([^?#]*)\??([^#]*)"
SHARE_RULES = ((r"^share\.google$", "link"),)
# (site, rule on the host without www., rule on the path), in order of priority.
SITE_RULES = (
    ("xhs", r"^xhslink\.com$|(^|\.)xiaohongshu\.com$", ""),
    ("github", r"^(gist\.)?github\.com$", ""),
    ("zhihu", r"^zhuanlan\.zhihu\.com$", ""),
    ("zhihu", r"^zhihu\.com$", r"^/question/\d+/answer/\d+/?$"),
    ("weixin", r"^mp\.weixin\.qq\.com$", ""),
    ("deepwiki-litenext", r"^wiki\.litenext\.digital$", ""),
    ("deepwiki-com", r"^deepwiki\.com$", ""),
    ("linux-do", r"^linux\.do$", ""),
    ("nvidianews", r"^nvidianews\.nvidia\.com$", ""),
    ("epoch-ai", r"^epoch\.ai$", ""),
    ("sebastianraschka-gallery", r"^sebastianraschka\.com$", r"^/llm-architecture-gallery"),
    ("substack", r"(^|\.)substack\.com$|^magazine\.sebastianraschka\.com$|^newsletter\.semianalysis\.com$", ""),
    ("arxiv", r"^arxiv\.org$", ""),
    ("intuitionlabs", r"^intuitionlabs\.ai$", ""),
    ("sspai", r"^sspai\.com$", ""),
    ("aleksagordic", r"^aleksagordic\.com$", ""),
    ("blog-google", r"^blog\.google$", ""),
    ("01-me", r"^01\.me$", ""),
    ("blog-csdn", r"^blog\.csdn\.net$", ""),
    ("developer-nvidia", r"^developer\.nvidia\.com$", ""),
    ("docs-nvidia", r"^docs\.nvidia\.com$", ""),
    ("lmsys", r"^lmsys\.org$", ""),
    ("sohu", r"^sohu\.com$", ""),
    ("huggingface", r"^huggingface\.co$", ""),
    ("qwenlm-github-io", r"^qwenlm\.github\.io$", ""),
    ("anthropic", r"^anthropic\.com$", ""),
    ("readthedocs", r"\.readthedocs\.(io|org)$", ""),
    ("feishu", r"\.feishu\.cn$", ""),
    ("reddit", r"^(old\.)?reddit\.com$", ""),
    ("sebastianraschka-blog", r"^sebastianraschka\.com$", ""),
    ("x-twitter", r"^(x|twitter)\.com$", ""),
    ("qwen-ai", r"^qwen\.ai$", ""),
    ("v2ex", r"^v2ex\.com$", r"/t/\d+"),
)
APP_SHAPES = (
    r"(?i)/(login|signin|signup|register|dashboard|console|admin)\b",
    r"(?i)/(tools?|calculator|search|vram-calculator)\b",
    r"(?i)\.eth\.limo\b",
    r"(?i)^https?://[a-f0-9]{8,}\.",
    r"(?i)^https?://[^/?#]+/?([?#].*)?$",
    r"(?i)^https?://[^/?#]+/index\.[a-z]+([?#].*)?$",
    r"(?i)[?&](search|q|query|keyword|kw|term)=",
)
DEFAULT_SITE = "_default"


def part(url: Column, n: int) -> Column:
    """1: scheme, 2: authority, 3: path, 4: query; empty if the URL isn't http."""
    return F.regexp_extract(F.trim(url), PARTS, n)


def hostname_of(url: Column) -> Column:
    """Host in lower case, without the port; empty if there is none."""
    return F.regexp_replace(F.lower(part(url, 2)), r":\d+$", "")


def host_of(url: Column) -> Column:
    """hostname_of without a leading www."""
    return F.regexp_replace(hostname_of(url), r"^www\.", "")


def params(url: Column) -> Column:
    """Query parameters, without those that only track, by key and place."""
    key = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    kept = F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~key(p).isin(*TRACKING))
    placed = F.transform(kept, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(placed), lambda s: s.p)


def normalize_url(url: Column) -> Column:
    """One spelling of a URL: host in lower case, no tracking parameters, fragment or last slash, parameters sorted.
    Other schemes get a scheme in lower case; what is no URL stays."""
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    query = F.array_join(params(url), "&")
    web = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    text = F.trim(url)
    scheme = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    other = F.concat(F.lower(scheme), F.substring(text, F.length(scheme) + 1, F.length(text)))
    return F.when(part(url, 2) != "", web).when(scheme != "", other).otherwise(text)


def unwrap_share_url(url: Column) -> Column:
    """The target of a share link whose host has a rule; else the URL."""
    out = url
    for rule, name in reversed(SHARE_RULES):
        target = F.url_decode(F.regexp_extract(part(url, 4), rf"(?:^|&){name}=([^&]*)", 1))
        out = F.when(host_of(url).rlike(rule) & target.rlike("(?i)^https?://"), target).otherwise(out)
    return out


def route_site(url: Column) -> Column:
    """The first site module, by priority, whose rules fit host and path; one takes all the rest."""
    out = F.lit(DEFAULT_SITE)
    for name, rule, path in reversed(SITE_RULES):
        fits = host_of(url).rlike(rule)
        out = F.when(fits & part(url, 3).rlike(path) if path else fits, name).otherwise(out)
    return out


def host_matches(host: Column, suffix: Column) -> Column:
    """Equal hosts, or a subdomain."""
    return (host == suffix) | host.endswith(F.concat(F.lit("."), suffix))


def slugify(title: Column, most: int = 40) -> Column:
    """Lower case, word characters, hyphens and CJK only, spaces to hyphens."""
    s = F.lower(F.trim(title))
    s = F.regexp_replace(s, r"[^0-9a-z_\-\s一-鿿]", "")
    s = F.regexp_replace(s, r"[\s]+", "-")
    s = F.regexp_replace(s, r"-+", "-")
    return F.regexp_replace(F.substring(s, 1, most), r"^-|-$", "")


def derive_slug(title: Column, created: Column, key: Column) -> Column:
    """Date and slug; a title without any character to keep gives a name from the key."""
    s = slugify(title)
    return F.when(s == "", F.concat(F.lit("raindrop-"), key.cast("string"))).otherwise(F.concat(F.date_format(created, "yyyy-MM-dd"), F.lit("-"), s))


def year_for_slug(slug: Column, otherwise: int) -> Column:
    year = F.regexp_extract(slug, r"^(\d{4})-\d{2}-\d{2}-", 1)
    return F.when(year == "", F.lit(otherwise)).otherwise(year.cast("int"))


def is_lan(url: Column) -> Column:
    """A private address, or a port in the authority."""
    return hostname_of(url).rlike(r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)|^localhost$") | part(url, 2).rlike(r":\d{4,5}$")


def looks_like_app(url: Column) -> Column:
    """A URL that is no article's: a login, a tool, a bare host, a search."""
    out = F.lit(False)
    for shape in APP_SHAPES:
        out = out | F.trim(url).rlike(shape)
    return out


def looks_like_article(url: Column) -> Column:
    return F.lower(part(url, 3)).rlike(r"/(blog|post|posts|article|articles|p|news|[0-9]{4})/.+|\.html?$")


def local_image_name(prefix: Column, n: Column, url: Column) -> Column:
    """<prefix>-img-NNN with the URL's extension; jpg if it has none."""
    ext = F.regexp_extract(F.lower(part(url, 3)), r"\.(png|jpe?g|gif|webp|svg|bmp|tiff?)$", 1)
    return F.format_string("%s-img-%03d.%s", prefix, n, F.when(ext == "", "jpg").otherwise(ext))


def without_dots(path: Column) -> Column:
    """A path from the root without . and .. segments; what leads above the root goes."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))


def resolve_against(base: Column, ref: Column) -> Column:
    """A reference made absolute: one with a scheme stays, // takes the scheme, / the host, ? the path, # all of the base; the rest takes the
    base's folder.  Dot segments are resolved."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    path = F.when(part(base, 3) == "", "/").otherwise(part(base, 3))
    query = F.when(part(base, 4) == "", "").otherwise(F.concat(F.lit("?"), part(base, 4)))
    own, tail = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    whole = F.when(ref.startswith("/"), own).otherwise(F.concat(F.regexp_replace(path, r"[^/]*$", ""), own))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(part(base, 1), F.lit(":"), ref))
        .when((ref == "") | ref.startswith("#"), F.concat(root, path, query, ref))
        .when(ref.startswith("?"), F.concat(root, path, ref))
        .otherwise(F.concat(root, without_dots(whole), tail))
    )


def common_host_suffix(hosts: Column) -> Column:
    """The longest common suffix, by labels, of an array of hosts; empty if they share none."""
    labels = lambda h: F.reverse(F.split(h, r"\."))
    first = labels(F.element_at(hosts, 1))
    same = lambda a, b: F.slice(a, 1, F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda k: F.slice(a, 1, k) == F.slice(b, 1, k))))
    return F.array_join(F.reverse(F.aggregate(hosts, first, lambda acc, h: same(acc, labels(h)))), ".")
