"""URL rules, and block decisions that follow redirects and canonical links.

A rule `host/path` fits urls of that host and its subdomains whose path starts with the rule's path; the
longest fitting rule decides. Urls that redirect to each other or name each other canonical are aliases:
connected components over those links, found by rounds of joins. A url without a rule of its own is
blocked if an alias of it is blocked by a rule, unless an alias is explicitly allowed: an explicit allow
goes before any block that arrives over links. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumite.llm._common import components, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rule list is configuration; beyond this length it is refused, as every rule is an expression.
MOST_RULES = 1000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(known, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule (ties: the greater text), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; the most is {MOST_RULES}")
    found = []
    for rule, verdict in rules:
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not found:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*found))


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` steps; `..` takes the step before it away, none leads above the root."""
    steps = F.split(path, "/", -1)
    last = F.element_at(steps, -1)
    fold = lambda out, x: F.when(x == ".", out).when(x == "..", F.regexp_replace(out, r"/[^/]*\z", "")).otherwise(F.concat(out, F.lit("/"), x))
    folded = F.concat(F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.lit(""), fold), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.when(folded == "", "/").otherwise(folded)).otherwise(path)


def address(url: Column) -> Column:
    """What aliases are linked by: the url without fragment and dot steps, host lower-cased; null if it has no host."""
    host, path = host_path(url)
    bare = F.regexp_extract(url, r"\A[^#]*", 0)
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    query = F.substring(bare, F.instr(bare, "://") + 3 + F.length(host) + F.length(path), F.length(bare))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, without_dots(path), query))


def _resolved(base: Column, href: Column, host: Column, path: Column) -> Column:
    """An href against its page: absolute, `//host`, `/path`, `?query` or relative to the page's folder."""
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), host)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"\A.*/", 0))
    out = F.when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
    return out.when(href.startswith("/"), F.concat(site, href)).when(href.startswith("?"), F.concat(site, path, href)).otherwise(F.concat(site, folder, href))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses of a page and of the targets of all its canonical links and meta refreshes; null where an end has no host, no row where there is no link."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?is)\Ahref\s*=\s*", ""), "[\"']", "")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b[^>]*>"), F.lit(0))
    canonical = F.transform(tags, lambda t: bare(F.regexp_extract(t, r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"), F.lit(0))
    refresh = F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)", 1))
    has = F.col(html).rlike(r"(?i)canonical|refresh")
    found = pages.where(has).select(F.col(url).alias("u"), F.explode(F.concat(canonical, refresh)).alias("href")).where("href <> ''")
    host, path = host_path(F.col("u"))
    parts = found.select("u", F.regexp_replace(F.btrim("href"), "&amp;", "&").alias("href"), host.alias("host"), path.alias("path"))
    target = parts.select("u", _resolved(F.col("u"), F.col("href"), F.col("host"), F.col("path")).alias("to"))
    return written(target, "targets").select(address(F.col("u")).alias("a"), address(F.col("to")).alias("b"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], links: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", default: str = "allow") -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, via (rule, link or default).

    `links` may add (a, b) urls of redirects, such as a crawl log. Null or broken urls have empty host and
    path, no rule and no alias, and get `default`; repeated rows are judged alike; empty tables give none.
    Without links between pages nothing is shuffled.
    """
    host, path = host_path(F.col(url))
    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"), host.alias("host"), path.alias("path")).withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    edges = page_links(pages, url, html)
    if links is not None:
        edges = edges.unionByName(links.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")))
    edges = written(edges.distinct(), "links").where("a is not null and b is not null and a <> b")
    if edges.isEmpty():
        linked = out.withColumn("_via", F.lit(None).cast("string"))
    else:
        nodes = written(components(edges), "aliases")
        h, p = host_path(F.col("node"))
        own = fitting_rule(h, p, rules)["verdict"]
        decided = nodes.groupBy("component").agg(F.max((F.coalesce(own, F.lit("")) == "block").cast("int")).alias("blocked"), F.max((F.coalesce(own, F.lit("")) == "allow").cast("int")).alias("allowed"))
        passed = nodes.join(decided, "component").select(F.col("node").alias("_node"), F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("_via"))
        linked = out.withColumn("_address", address(F.col("_url"))).join(passed, F.col("_address") == F.col("_node"), "left")
    verdict = F.coalesce(F.col("_fit")["verdict"], F.col("_via"), F.lit(default))
    via = F.when(F.col("_fit").isNotNull(), "rule").when(F.col("_via").isNotNull(), "link").otherwise("default")
    return linked.select("page_id", "host", "path", F.col("_fit")["rule"].alias("rule"), verdict.alias("verdict"), via.alias("via"))
