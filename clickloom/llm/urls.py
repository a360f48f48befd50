"""URL filters: host-and-path rules, carried over to a page's aliases.

An alias of a URL is another spelling of it (scheme, fragment), the target of
its redirect, or what its page names as canonical. Connected components over
those edges are found with DataFrame joins; a URL without a rule of its own is
blocked if its component holds a blocked URL and no allowed one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import settled
from clickloom.llm.graph import components


class Rule(NamedTuple):
    verdict: str  # block or allow
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; '' without a ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The name of the longest rule that fits; null if none does. Rules are a short list: they become one CASE."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What spellings of one URL share: host, path and query. Null for what has no host."""
    rest = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def _resolved() -> Column:
    """The column target as an absolute URL, seen from the page whose URL's parts are scheme, folder and root."""
    target, folder, root = F.col("target"), F.col("folder"), F.col("root")
    base = F.when(folder.endswith("/") & (F.length(folder) > F.length(root)), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat("scheme", F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when((target != "") & ~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(base, target))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): URLs that pages name as canonical or redirect to."""
    link = F.regexp_extract_all(html_col, F.lit(r"(?i)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), F.lit(1))
    meta = F.regexp_extract_all(html_col, F.lit(r"(?i)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), F.lit(1))
    tags = pages.select(F.col(url_col).alias("source"), F.explode(F.concat(link, meta)).alias("tag"))
    href = F.regexp_extract("tag", r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    moved = F.regexp_extract("tag", r"(?i)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*['\"]?([^\"'>]+)", 1)
    bare = F.regexp_replace(href, "(?i)^href\\s*=\\s*[\"']?|[\"']$", "")
    target = F.when(F.lower("tag").startswith("<link"), bare).otherwise(moved)
    tags = tags.withColumn("target", F.replace(F.btrim(target), F.lit("&amp;"), F.lit("&")))
    for name, part in (("scheme", "^[^:/?#]*"), ("folder", "^[^:]*://[^/?#]*(?:[^?#]*/)?"), ("root", "^[^:]*://[^/?#]*")):
        tags = tags.withColumn(name, F.regexp_extract("source", part, 0))
    return tags.select("source", _resolved().alias("target")).filter("source is not null and target is not null")


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, via): a row for each row of pages.

    edges: (source, target) URLs, of redirects and canonical links. verdict: the
    rule's; without a rule, block if an alias is blocked by a rule and none is
    allowed by one, else allow. An own rule always wins. via: own, alias or
    default. Null and malformed URLs have no host and no alias: allow.
    """
    verdicts = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.verdict))]) if rules else F.create_map().cast("map<string,string>")
    links = edges.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v"))
    roots = settled(components(links))
    # a node has one host and path, so its rule follows from itself
    as_url = F.concat(F.lit("x://"), F.col("node"))
    parts_of_node = F.struct(host_of(as_url).alias("host"), path_of(as_url).alias("path"))
    ruled = roots.select("*", F.explode(F.array(parts_of_node)).alias("x")).select("node", "root", "x.host", "x.path").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("own", F.try_element_at(verdicts, F.col("rule")))
    said = ruled.groupBy("root").agg(F.bool_or(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"), F.bool_or(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allowed"))
    aliased = roots.join(said, "root").filter("blocked and not allowed").select(F.col("node").alias("alias"))
    url = F.col(url_col).cast("string")
    # a generator keeps the parts from being worked out anew in each branch of each rule
    parts = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.explode(F.array(parts)).alias("x")).select("page_id", "x.host", "x.path", "x.node")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.join(aliased, F.col("node") == F.col("alias"), "left")
    own = F.try_element_at(verdicts, F.col("rule"))
    verdict = F.coalesce(own, F.when(F.col("alias").isNotNull(), F.lit("block")), F.lit("allow"))
    via = F.when(F.col("rule").isNotNull(), "own").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), via.alias("via"))
