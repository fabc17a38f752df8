"""URL filters with rules by host and path, whose block decisions spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.graph import components

#: Rules of the registered query: verdict and host/path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    found = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(found(1), _UPPER, _LOWER), found(2)


def matching_rule(host: Column, path: Column, rules) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with its path.  Rules are a literal map from host to its rules, looked
    up for as many trailing labels as rule hosts have; the list is a parameter and meant for thousands, not millions, of rules.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        by_host.setdefault(own, []).append(("/" + rest, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    entry = lambda x: F.struct(F.lit(x[0]).alias("path"), F.lit(len(x[1])).alias("length"), F.lit(x[1]).alias("rule"), F.lit(x[2]).alias("verdict"))
    table = F.create_map(*(y for own, found in by_host.items() for y in (F.lit(own), F.array(*map(entry, found)))))
    tails = F.array_distinct(F.array(*(F.substring_index(host, ".", -n) for n in sorted({own.count(".") + 1 for own in by_host}))))
    found = F.flatten(F.transform(tails, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<struct<path:string,length:int,rule:string,verdict:string>>"))))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def url_node(url: Column) -> Column:
    """The name of a URL in the link graph: scheme and host lower-cased, without fragment, ``/`` for an empty path; null without ``://``."""
    part = lambda group: F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^?#]*)(\?[^#]*)?", group)
    path = F.regexp_replace(part(2), "^$", "/")
    return F.when(F.locate("://", url) > 0, F.concat(F.translate(part(1), _UPPER, _LOWER), path, part(3)))


def resolve(link: Column, base: Column) -> Column:
    """An absolute URL for a link found on the page ``base``; null if the page's own URL is no base for it."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    scheme = F.substring_index(base, "://", 1)
    root = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*((?:/[^?#]*)?/)", 1)
    relative = F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.coalesce(root, F.lit("")) == "", F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link != "", relative)
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v) nodes: a page and the target of its canonical link or of its meta refresh."""
    return linked_urls(pages, url, html).select(url_node(F.col("source")).alias("u"), url_node(F.col("target")).alias("v"))


def linked_urls(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) URLs as they are written: a page and what its canonical link or meta refresh names."""
    attribute = lambda tag, name: F.regexp_replace(
        F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), r"""^["']|["']$""", "",
    )
    canonical = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: F.lower(attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"),
    )
    refresh = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh",
    )
    targets = F.concat(
        F.transform(canonical, lambda t: attribute(t, "href")),
        F.transform(refresh, lambda t: F.regexp_extract(attribute(t, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)),
    )
    linked = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv"))
    each = linked.select(F.col(url).alias("base"), F.explode(targets).alias("link"))
    return each.select(F.col("base").alias("source"), resolve(F.col("link"), F.col("base")).alias("target"))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule and verdict of every page.

    The longest fitting rule decides.  A page without one takes the decision of its component over redirects (``redirects``: rows of
    ``source`` and ``target`` URLs) and the canonical and refresh links of all pages: allow if a rule allows any URL in it, else block if a
    rule blocks any, else allow.  URLs need not be pages to carry a decision.  Rules are judged on URLs as written; that an empty path and
    ``/`` name one resource only tells which URLs belong together.

    Null URLs or such without ``://`` have an empty host and path and no links; null html has none; pages are kept row by row, so
    repeated rows repeat; an empty table gives no rows; other columns stay out.
    """
    host, path = split_url(F.col("_url"))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    judged = rows.select("_key", url_node(F.col("_url")).alias("node"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    links = linked_urls(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    ends = links.select(F.explode(F.array("source", "target")).alias("url"))
    verdicts = ends.select(url_node(F.col("url")).alias("node"), matching_rule(*split_url(F.col("url")), rules)["verdict"].alias("verdict"))
    verdicts = verdicts.unionByName(judged.select("node", F.col("own.verdict").alias("verdict"))).where("verdict is not null").distinct()
    nodes = components(links.select(url_node(F.col("source")).alias("u"), url_node(F.col("target")).alias("v")))
    seen = nodes.join(verdicts, "node").select("component", "verdict")
    spread = seen.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    decided = nodes.join(spread, "component", "left").select(
        "node", F.when(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")).alias("spread"),
    )
    return judged.join(decided, "node", "left").select(
        F.col("_key").alias(key), "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict"),
    )
