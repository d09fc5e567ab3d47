"""URL filters with redirect equivalence.

A rule is a host and a path: it fits that host and all its subdomains where the URL's path starts with the rule's; the
longest fitting rule wins, allow before block among equals. URLs that no rule fits get the verdict of their aliases:
URLs with their queries, without fragments, are nodes of a graph whose edges are redirects (meta refresh, or a table of
them) and canonical links, its connected components come from distributed star rounds, and a component with an allowed
member is allowed, one with blocked members only is blocked, any other is allowed.

Rules meet hosts by an equi-join on the host's suffixes (as many as it has labels).

Defined cases: a null URL or one without `://` has empty host and path, fits no rule and has no alias; null html has no
links; a link that isn't absolute is resolved against its page's scheme and host (`//host`, `/path`) or folder, its dot
segments worked off; loops
and links to pages that aren't in the table are fine; repeated rows are rows of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.llm.components import components
from shardwright.llm.shared import written

#: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^\s"'>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'>]+)["']"""


_REFRESH_BARE = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*[^\s"'>]*?url=([^\s"'>]+)"""


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """From the `?` to the fragment; empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1), F.lit(""))


def _node(url: Column) -> Column:
    return F.struct(host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("query"))


def undotted(path: Column) -> Column:
    """A path, with or without a query, whose `.` segments are left out and whose `..` take the one before."""
    own, rest = F.regexp_extract(path, r"^([^?#]*)", 1), F.regexp_extract(path, r"^[^?#]*(.*)$", 1)

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))

    folded = F.array_join(F.aggregate(F.split(own, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(own.rlike(r"/\.\.?(?:/|\z)"), F.concat(folded, F.when(own.rlike(r"/\.\.?\z"), "/").otherwise(""), rest)).otherwise(path)


def resolved(link: Column, url: Column) -> Column:
    """An absolute URL from a link on a page."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.concat(scheme, F.lit("://"), F.regexp_extract(url, r"://([^/?#]*)", 1))
    folder = F.regexp_replace(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), r"[^/]*\z", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(host, undotted(link)))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("#") | (link == ""), None)
        .otherwise(F.concat(host, undotted(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), link))))
    )


def links_of(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of the canonical links and meta refreshes in pages' html."""
    html = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    link = F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in (_CANONICAL, _REFRESH, _REFRESH_BARE)))
    return html.select("url", F.explode(link).alias("link")).select(F.col("url").alias("from_url"), resolved(F.trim("link"), F.col("url")).alias("to_url")).where("to_url is not null")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) of urls with the rule that fits and its verdict; those without are left out."""
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = pairs.where("host <> ''").withColumn("rule_host", F.explode(suffix)).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), F.col("verdict").alias("verdict")))
    return hit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. redirects: (from_url, to_url) beside those in the html."""
    links = links_of(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    edges = links.select(_node(F.col("from_url")).alias("a"), _node(F.col("to_url")).alias("b")).where("a.host <> '' and b.host <> ''")
    groups = components(written(edges.distinct(), "links"))
    mine = pages.select("page_id", _node(F.col("url")).alias("node")).select("page_id", "node.*")
    nodes = groups.select("node.*", "root")
    fits = fitting(mine.select("host", "path").unionByName(nodes.select("host", "path")), rules)
    told = nodes.join(fits, ["host", "path"]).groupBy("root").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allow"))
    passed = nodes.join(told, "root").select("host", "path", "query", F.when(F.col("allow") == 1, "allow").otherwise("block").alias("alias"))
    judged = mine.join(fits, ["host", "path"], "left").join(passed, ["host", "path", "query"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"))
