"""URL rules with redirect equivalence.

Native DataFrame operator. Rules are (action, "host/path") strings; a rule fits its host and all
subdomains where the URL's path starts with the rule's; the longest fitting rule decides. URLs without a rule
take the decision of their aliases: connected components over redirect and canonical-link edges, where one explicit
allow in a component overrides every block in it. URLs are one where they differ in no more than scheme, case of the host, fragment or an empty path for ``/``;
``spellings`` also takes a leading www or m, tracking parameters and last slashes for nothing, which the query does not.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and no alias, and is
allowed; null or malformed HTML has no links; repeated rows and repeated URLs are judged alike; an
empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctaria.operators.components import connected_components

from .common import discard, lower_ascii, materialise

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Rules become one expression of the plan; longer lists belong in a table.
MAX_RULES = 2000

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK, _META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_IS_CANONICAL = r"""(?is)\brel\s*=\s*["']?\s*canonical"""
_IS_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_CONTENT_URL = r"""(?is)\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)"""
#: Query parameters that name no other page.
_TRACKING = r"(^|&)(utm_[a-z]+|gclid|fbclid|ref)=[^&]*"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits, null without one; of equally long ones an allow."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = None
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0])):
        own_host, _, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def alias_key(url: Column, spellings: bool = False) -> Column:
    """One name for a URL: host, path and query; null without a host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    if spellings:
        host, path = F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", "")
        query = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(host != "", F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def _absolute(link: Column, url: Column) -> Column:
    """A link of a page as an absolute URL."""
    base = F.concat(F.lit("http://"), host_of(url))
    return (
        F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .otherwise(F.concat(base, F.regexp_replace(path_of(url), "[^/]*$", ""), F.when(path_of(url) == "", F.lit("/")).otherwise(F.lit("")), link))
    )


def link_edges(pages: DataFrame, spellings: bool = False) -> DataFrame:
    """(src, dst, dst_url) for each canonical link and refresh redirect in the pages' HTML."""
    html = F.col("html")

    def found(word: str, tag: str, wanted: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), 0), lambda t: t.rlike(wanted))
        return F.when(html.contains(word) | html.rlike(f"(?i){word}"), F.transform(tags, lambda t: F.regexp_extract(t, target, 1))).otherwise(F.array().cast("array<string>"))

    links = F.concat(found("canonical", _LINK, _IS_CANONICAL, _HREF), found("refresh", _META, _IS_REFRESH, _CONTENT_URL))
    links = pages.select("url", F.explode(F.filter(links, lambda x: x != "")).alias("link"))
    target = links.select(alias_key(F.col("url"), spellings).alias("src"), _absolute(F.col("link"), F.col("url")).alias("dst_url"))
    return target.select("src", alias_key(F.col("dst_url"), spellings).alias("dst"), "dst_url").filter("src is not null and dst is not null").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None, spellings: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; ``redirects`` (src, dst URLs) adds edges from a crawl log."""
    url = F.col("url")
    edges = link_edges(pages, spellings)
    if redirects is not None:
        log = redirects.select(alias_key(F.col("src"), spellings).alias("src"), alias_key(F.col("dst"), spellings).alias("dst"), F.col("dst").alias("dst_url"))
        edges = edges.unionByName(log.filter("src is not null and dst is not null")).distinct()
    edges = materialise(edges, "alias-edges")
    members = connected_components(edges, "src", "dst")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url, spellings).alias("key"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    # One row a name, with the decisions taken on it; targets outside the table count too.
    decided = rows.filter("key is not null and r is not null").select("key", F.col("r.action").alias("action"))
    outside = edges.select(F.col("dst").alias("key"), rule_of(host_of(F.col("dst_url")), path_of(F.col("dst_url")), rules)["action"].alias("action")).filter("action is not null")
    by_name = decided.unionByName(outside).groupBy("key").agg(F.bool_or(F.col("action") == "block").alias("block"), F.bool_or(F.col("action") == "allow").alias("allow"))
    names = by_name.join(members.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    blocked = names.groupBy("component").agg(F.bool_or("block").alias("block"), F.bool_or("allow").alias("allow")).filter("block and not allow").select("component")
    # Back to names, then to the pages without a rule of their own. Written, so that the last join is one of two plain exchanges.
    blocked_names = names.select("key", "component").unionByName(members.select(F.col("id").alias("key"), "component")).join(blocked, "component", "left_semi").select("key", F.lit(True).alias("blocked")).distinct()
    blocked_names = materialise(blocked_names, "blocked-names")
    discard(edges, members)
    ruled = rows.filter("r is not null").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.action").alias("verdict"))
    free = rows.filter("r is null")
    nameless = free.filter("key is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    free = free.filter("key is not null").join(blocked_names, "key", "left")
    free = free.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return ruled.unionByName(free).unionByName(nameless)


def query(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html"))
