"""URL rules, carried over redirects and canonical links.

A rule (host, path) fits its host and every subdomain of it when the URL's path starts with the rule's; the longest
fitting rule decides. A page that no rule fits asks its aliases: URLs tied by redirects and by the canonical link or refresh
target that pages name are components of a graph, found by distributed connected components. A component is blocked if a rule
blocks one of its URLs and no rule allows another: an explicit allow takes precedence. Everything else is allowed.

A URL without ``://``, or null, has an empty host and path, fits no rule and is nobody's alias. Nodes are host, path and query, so
scheme and fragment do not tell aliases apart. Null html names no links. Every page row gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.llm.components import components
from cohortlab.llm.store import measured, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What tells URLs apart, or null where there is no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null. ``rules``: (verdict, host, path), a list small enough to be an expression."""
    fitting = [
        F.when(
            ((host == F.lit(h)) | host.endswith(F.lit("." + h))) & path.startswith(F.lit(p)),
            F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def resolved(target: Column, url: Column) -> Column:
    """``target`` as an absolute URL, seen from the page ``url``."""
    scheme = F.regexp_extract(url, r"^([^:/?#]+):", 1)
    base = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(base, target))
        .when(target.rlike(r"^([?#]|$)"), F.concat(base, path_of(url), target)).otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def named_links(pages: DataFrame) -> DataFrame:
    """(source, target) URLs: each page's canonical link and refresh target, where the html names them."""
    html = F.col("html")
    tag = F.regexp_extract(html, r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>)""", 1)
    canonical = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    meta = F.regexp_extract(html, r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>)""", 1)
    refresh = F.regexp_extract(meta, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    # most pages have neither tag: a plain substring test spares them the patterns
    likely = F.lower(html).contains("canonical") | F.lower(html).contains("http-equiv")
    found = pages.select("url", "html").filter("url IS NOT NULL AND html IS NOT NULL").filter(likely)
    each = found.select("url", F.explode(F.array(canonical, refresh)).alias("to")).filter("to <> ''")
    return each.select(F.col("url").alias("source"), resolved(F.col("to"), F.col("url")).alias("target"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` (page_id, url, html, others but html are kept) with host, path, rule and verdict.

    ``redirects`` has source and target URLs that a crawl followed.
    """
    links = named_links(pages)
    links = links if redirects is None else links.unionByName(redirects.select("source", "target"))
    edges, _ = written(links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).filter("a <> b"), "aliases")
    groups, _ = written(components(edges), "groups")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruling = groups.select("component", ruled(host_of(as_url), path_of(as_url), rules)["verdict"].alias("v"))
    blocked = ruling.groupBy("component").agg(F.max(F.col("v") == "block").alias("block"), F.max(F.col("v") == "allow").alias("allow")).filter("block AND NOT coalesce(allow, false)")
    aliases = groups.join(blocked.select("component"), "component").select(F.col("node").alias("_node"), F.lit(True).alias("_blocked"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "html")]
    best = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("_n")).withColumn("_best", best)
    joined = rows.join(measured(written(aliases, "blocked")[0], "_node"), F.col("_n") == F.col("_node"), "left")
    verdict = F.coalesce(F.col("_best.verdict"), F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return joined.select(*kept, "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"))
