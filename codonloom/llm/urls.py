"""URL verdicts: host and path rules, passed on to the aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.llm import graph
from codonloom.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[0-9.]*\s*;\s*url\s*=\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next slash, question mark, hash or end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What two spellings of one address share: host, path and query, without scheme and fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), query))


def absolute(link: Column, url: Column) -> Column:
    """A link with the scheme or the host of the page it stands on, where it lacks them."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*(?=/))?)", 1)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), link))
            .when(link.startswith("/"), F.concat(site, link))
            .otherwise(F.concat(folder, F.lit("/"), link)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict); null where none fits.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts
    with the rule's. The list is checked in full, longest first, allow before block.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def aliases(pages: DataFrame) -> DataFrame:
    """Edges (`a`, `b`, `url_b`) from pages to the targets of their canonical links and redirects."""
    found = pages.select("url", F.explode(F.array(
        F.regexp_extract("html", CANONICAL, 1), F.regexp_extract("html", REFRESH, 1))).alias("link"))
    target = F.regexp_replace(F.regexp_replace(absolute(F.col("link"), F.col("url")), "&amp;", "&"), "#.*$", "")
    full = found.filter("link <> ''").withColumn("url_b", target)
    return full.select(node_of(F.col("url")).alias("a"), node_of(F.col("url_b")).alias("b"), "url_b").filter(
        "a is not null and b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`page_id`, `url`, `host`, `path`, `rule` and `verdict` of every row.

    A page's own rule decides. Without one, the page follows its aliases, that is
    everything connected with it through redirects and canonical links in either direction,
    crawled or only linked to: one explicit allow among them wins, otherwise one block is
    enough, otherwise the page is allowed. A url that is null or lacks ``://`` has an empty
    host and path, no rule and no aliases. Repeated rows are judged alike.
    """
    edges = stage(aliases(pages.select("url", "html")), "aliases")
    members = graph.components(edges)
    # Only addresses with an alias matter from here on, each once.
    ends = edges.select(F.col("b").alias("node"), F.col("url_b").alias("url")).unionByName(
        pages.select(node_of(F.col("url")).alias("node"), "url").join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_semi"))
    voices = ends.select("node", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("vote"))
    voices = voices.filter("vote is not null").distinct()
    votes = voices.join(members, "node").groupBy("component").agg(F.min("vote").alias("passed_on"))  # allow < block
    told = stage(members.join(stage(votes, "votes"), "component").select(F.col("node").alias("_node"), "passed_on"), "told")
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       node_of(F.col("url")).alias("node"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return own.join(told, F.col("node") == F.col("_node"), "left").select(
        "page_id", "url", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "passed_on", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNull(), F.col("passed_on")).alias("passed_on"))
