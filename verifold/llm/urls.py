"""URL filters: host and path rules, and redirect equivalence. DataFrame functions only.

A rule holds for its host and all subdomains where the path starts with the rule's; the longest rule wins. Pages that no
rule judges take the verdict of their aliases: redirects and canonical links are edges between URLs, a component with an
explicitly allowed URL is allowed, else one with a blocked URL is blocked. An explicit rule always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, frozen, private, shuffle_width

# Fixed rules of the contract: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. Rules of one length are tried in the order given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def absolute(link: Column, base: Column) -> Column:
    """A link as a full URL: as it is, or on its page's scheme, host or folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    return (
        F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(url, other) for each page whose html names a canonical URL or refreshes to another."""
    html = F.col("html")
    canonical = F.transform(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0)), lambda t: F.regexp_extract(t, REFRESH, 1))
    some = pages.where(F.col("url").isNotNull() & html.isNotNull()).where(html.rlike(r"(?i)canonical|http-equiv"))
    links = some.select("url", F.explode(F.concat(canonical, refresh)).alias("link")).where("link <> ''")
    return links.select("url", absolute(F.col("link"), F.col("url")).alias("other")).where("url <> other")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """pages (without html) with host, path, rule and verdict.

    redirects may give more edges as (url, other). A null url, or one without ://, has an empty host and path, fits no
    rule, has no aliases and gets the default. Repeated rows and many pages of one URL are judged alike; URLs are joined
    by their whole text. Columns of pages with one of the four names are replaced, all others kept, whatever they
    are called; an empty table stays empty.
    """
    name = private(pages)
    found, own, node, alias = (name + c for c in ("found", "rule", "node", "alias"))
    host, path = host_and_path(F.col("url"))
    ruled = pages.withColumn("host", host).withColumn("path", path).withColumn(found, rule_for(F.col("host"), F.col("path"), rules)).drop("html")
    plain = ruled.withColumn("rule", F.col(found)["rule"]).withColumn(own, F.col(found)["verdict"]).drop(found)
    edges = link_edges(pages) if "html" in pages.columns else None
    if redirects is not None:
        more = redirects.select("url", "other").where("url is not null and other is not null and url <> other")
        edges = more if edges is None else edges.unionByName(more)
    if edges is None:
        return plain.withColumn("verdict", F.coalesce(own, F.lit(default))).drop(own)
    edges = frozen(edges.select(F.col("url").alias("a"), F.col("other").alias("b")).distinct(), "links")
    parts = connected_components(edges)
    members = parts.unionByName(parts.select(F.col("root").alias("node"), "root").distinct())
    # only URLs on an edge have aliases; each carries its own explicit verdict into its component
    h, p = host_and_path(F.col("node"))
    marks = members.withColumn("v", rule_for(h, p, rules)["verdict"])
    said = marks.groupBy("root").agg(F.max(F.when(F.col("v") == "allow", 2).when(F.col("v") == "block", 1).otherwise(0)).alias("said")).where("said > 0")
    verdicts = members.join(said, "root").select(F.col("node").alias(node), F.when(F.col("said") == 2, "allow").otherwise("block").alias(alias))
    verdicts = frozen(verdicts, "aliases").repartition(shuffle_width(pages.sparkSession))
    # most pages have an explicit verdict or no alias at all; with no alias anywhere there is nothing to join
    if verdicts.isEmpty():
        return plain.withColumn("verdict", F.coalesce(own, F.lit(default))).drop(own)
    joined = plain.join(verdicts, F.col("url") == F.col(node), "left")
    return joined.withColumn("verdict", F.coalesce(own, alias, F.lit(default))).drop(own, alias, node)
