"""URL filters with redirect equivalence.

Rules (host, path) judge the urls they fit. Urls that answer for one another share their fate: a url and its normal form (no `www.` or
`m.`, default port, index page, `.html`, closing slash or tracking parameters) are one node, canonical links and refresh redirects of a page are edges
to other nodes, and the connected components of those edges are the aliases. A page without a rule of its own is blocked if an
alias is blocked by a rule and none is explicitly allowed.

Links are resolved against the page's url: full ones (with a scheme), on its scheme, on its host, relative to its path, and queries alone; dot
segments go. All canonical links and refreshes of a page count. A link without a target of its own (a fragment, `mailto:` and the like) has none.

Defined results: null urls and those without `://` have empty host and path, fit no rule, have no aliases and are allowed; rows are kept
one to one; null html has no links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.llm.common import ascii_lower
from tilewater.llm.components import connected

#: fixed values: verdict, host, path
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: fixed values: patterns, the same in both engines
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
ALIAS_HOST = r"^(www|m)\.|:(80|443)$"
ALIAS_PATH = r"(/index)?(\.html?)?/*$"
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def normal(url: Column) -> Column:
    """Normal form of a url that has `://`, else null."""
    host = F.regexp_replace(host_of(url), ALIAS_HOST, "")
    path = F.regexp_replace(path_of(url), ALIAS_PATH, "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, QUERY, 1), TRACKING, ""), "^&", "")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def undotted(path: Column) -> Column:
    """A path that starts with a slash, without its `.` and `..` segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)

    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(x == "..", up).when(x == ".", acc).otherwise(F.array_append(acc, x))

    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")).cast("array<string>"), step)
    joined = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") | (F.size(kept) == 1), "/").otherwise(""))
    return F.when(F.rlike(path, F.lit(r"(^|/)\.\.?(/|$)")), joined).otherwise(path)


def absolute(link: Column, url: Column) -> Column:
    """A link as a full url, resolved against the page's url; null if it names no page (a fragment, another scheme)."""
    scheme, host = F.regexp_extract(url, r"^([^:/?#]+)://", 1), F.regexp_extract(url, PARTS, 1)
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    base = F.concat(scheme, F.lit("://"), host)
    here = F.regexp_extract(url, PARTS, 2)
    folder = F.when(F.contains(here, F.lit("/")), F.regexp_extract(here, r"(?s)^(.*/)", 1)).otherwise("/")
    full = F.when(F.rlike(link, F.lit(SCHEME)), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
    cut = r"(?s)^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$"
    tidy = F.concat(F.regexp_extract(full, cut, 1), undotted(F.regexp_extract(full, cut, 2)), F.regexp_extract(full, cut, 3))
    return (F.when(full.isNotNull(), tidy)
            .when(link.startswith("/"), F.concat(base, undotted(path), rest))
            .when(F.rlike(link, F.lit(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|$)")), F.lit(None).cast("string"))
            .when(link.startswith("?"), F.concat(base, here, link))
            .otherwise(F.concat(base, undotted(F.concat(folder, path)), rest)))


def links(pages: DataFrame) -> DataFrame:
    """a, b: normal forms of a page and of what its canonical links and refreshes name."""
    html, url = F.col("html"), F.col("url")
    tags = lambda tag, target: F.transform(
        F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, target, 1))
    named = F.concat(tags(CANONICAL, HREF), tags(REFRESH, TARGET))
    some = pages.where(F.contains(F.lower("html"), F.lit("canonical")) | F.contains(F.lower("html"), F.lit("refresh")))
    found = some.select(normal(url).alias("a"), "url", F.explode(named).alias("link")).where("link <> ''")
    return found.select("a", normal(absolute(F.col("link"), url)).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def own_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if there is none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, and `alias`, the smallest url of its component (null without `://`)."""
    pages = pages.select("page_id", "url", "html")
    roots = connected(links(pages))
    known = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), normal(F.col("url")).alias("node"))
    rule, verdict = own_rule(F.col("host"), F.col("path"), rules)
    known = known.withColumn("rule", rule).withColumn("own", verdict).join(roots, "node", "left")
    known = known.withColumn("alias", F.coalesce("root", "node"))
    decided = known.where("own is not null and alias is not null").groupBy("alias").agg(
        F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    spread = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return known.join(decided, "alias", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", spread).alias("verdict"), "alias")


def allowed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The page ids that stay."""
    return judge(pages, rules).where("verdict = 'allow'").select("page_id")


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judge(pages).drop("alias")
