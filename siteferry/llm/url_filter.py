"""Verdicts on urls: host and path rules, and redirect equivalence for urls that no rule names.

A page that redirects, or that names another url as its canonical one, is the same resource as that url. Connected
components over these edges give the classes of equal resources; a block rule on any member blocks all members
that no rule names. A url that an allow rule names stays allowed, whatever its aliases are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteferry.functions.scale import BROADCAST_ROWS, keyed_lookup
from siteferry.llm.components import connected_components
from siteferry.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Parts of a page in which markup is only text.
_INERT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_REFRESH = (
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)"""
    r"""[^>]*?\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?\s*([^"'\s>]+)"""
)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without one."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def resource_of(url: Column) -> Column:
    """The url without scheme and fragment, which name no other resource; null without `://`."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(host_of(url), path_of(url), query))


def resolved(base: Column, target: Column) -> Column:
    """A link target as a full url: absolute, without scheme, from the root, or beside the page."""
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    beside = F.concat(root, F.regexp_extract(F.concat(F.lit("/"), F.ltrim(path_of(base), F.lit("/"))), r"^(.*/)", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(beside, target))
    )


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct edges (a, b) between the resource of a page and the targets of its canonical link and its redirect."""
    url, live = F.col(url_col), F.regexp_replace(F.col(html_col), _INERT, " ")
    named = pages.filter(F.col(html_col).rlike(r"(?i)canonical|http-equiv")).select(
        url.alias("_url"), F.inline(F.array(F.struct(live.alias("_live"))))
    )
    targets = F.array(F.regexp_extract("_live", _CANONICAL, 1), F.regexp_extract("_live", _REFRESH, 1))
    linked = named.select("_url", F.explode(targets).alias("_target")).filter("_target <> ''")
    target = F.replace(F.col("_target"), F.lit("&amp;"), F.lit("&"))
    ends = linked.select(
        resource_of(F.col("_url")).alias("a"), resource_of(resolved(F.col("_url"), target)).alias("b")
    )
    return ends.filter("a <> b").distinct()


def rule_verdicts(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) of `places` that a rule fits, with `rule` and `rule_verdict` of the longest that fits.

    A rule fits its host and every subdomain where the path starts with the rule's. Of rules of one length, allow
    goes before block, then the rule later in the alphabet. The rules may be a list of millions: they are joined
    on the host and its parents, broadcast when few, else with salted keys.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    asked = places.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("rule_host"))
    listed = rules.filter("rule_host is not null and rule_path is not null and rule_verdict in ('allow', 'block')")
    listed = cut_lineage(listed.select("rule_host", "rule_path", "rule_verdict").distinct())
    if listed.count() <= BROADCAST_ROWS:
        found = asked.join(F.broadcast(listed), "rule_host")
    else:
        found = keyed_lookup(asked, listed, ["rule_host"], ["host", "path"], how="inner")
    fitting = found.filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(
        F.length(rule).alias("n"), (F.col("rule_verdict") == "allow").alias("allow"), rule.alias("rule")
    )
    best = fitting.groupBy("host", "path").agg(F.max(order).alias("_best"))
    return best.select(
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.when(F.col("_best.allow"), "allow").otherwise("block").alias("rule_verdict"),
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """The rows of `pages` without the html, and host, path, rule, verdict.

    verdict is that of the longest fitting rule; without one it is `block` where an alias, through any number of
    redirects and canonical links, is blocked by a rule, and else `allow`. A null url, or one without `://`, has an
    empty host and path, fits no rule, has no alias and is allowed. `edges` (a, b), as resources, come on top of
    those in the pages. Columns of the input named like a result are replaced; repeated rows stay. An empty table
    gives no rows.
    """
    url = F.col(url_col)
    found = alias_edges(pages, url_col, html_col)
    found = cut_lineage(found if edges is None else found.unionByName(edges.select("a", "b")).distinct())
    kept = [c for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict", "rule_verdict", "_resource", "_spread")]
    rows = pages.select(
        *kept, host_of(url).alias("host"), path_of(url).alias("path"), resource_of(url).alias("_resource")
    )
    linked = not found.isEmpty()
    places = rows.select("host", "path")
    if linked:
        classes = connected_components(found)
        place = F.concat(F.lit("x://"), F.col("node"))
        members = cut_lineage(classes.select("node", "component", host_of(place).alias("host"), path_of(place).alias("path")))
        places = places.unionByName(members.select("host", "path"))
    ruled = cut_lineage(rule_verdicts(places, rules))
    judged = rows.join(ruled, ["host", "path"], "left")
    verdict = F.col("rule_verdict")
    if linked:
        blocked = members.join(ruled.filter("rule_verdict = 'block'"), ["host", "path"], "left_semi")
        aliases = members.join(blocked.select("component").distinct(), "component", "left_semi")
        spread = aliases.select(F.col("node").alias("_resource"), F.lit("block").alias("_spread"))
        judged = judged.join(spread, "_resource", "left")
        verdict = F.coalesce(verdict, F.col("_spread"))
    return judged.select(*kept, "host", "path", "rule", F.coalesce(verdict, F.lit("allow")).alias("verdict"))
