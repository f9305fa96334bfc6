"""URL filters whose block decisions reach the aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillcast.llm.common import ascii_lower
from fillcast.llm.components import connected_components
from fillcast.operators.ordered import stored

#: Query parameters that never change a page (fixed values).
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid|igshid|sessionid|phpsessid"

_LINK_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?i)\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def page_key(url: Column) -> Column:
    """A url without what never changes the page: scheme, `www.`, fragment, tracking parameters, last slash."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    useful = F.array_join(F.array_sort(F.filter(
        F.split(query, "&"), lambda p: (F.length(p) > 0) & ~p.rlike(f"(?i)^({TRACKING})(=|$)"))), "&")
    place = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(F.length(host_of(url)) > 0, F.concat_ws("?", place, F.when(F.length(useful) > 0, useful)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path prefix) that fits, as a struct; NULL if none does.

    A rule fits its host and all subdomains. Equally long rules: allow comes first.
    """
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, on, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(on + prefix).alias("rule"))).otherwise(found)
    return found


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between page keys: from each page to the targets of its canonical and refresh tags."""
    tags = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(_LINK_TAG), F.lit(0)), lambda x: F.regexp_extract(x, _HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(_REFRESH_TAG), F.lit(0)), lambda x: F.regexp_extract(x, _TARGET, 1)))
    links = pages.select(url, F.explode(tags).alias("to"))
    scheme = F.regexp_extract(url, r"(?s)^(.*?):", 1)
    target = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), "to"))
        .when(F.col("to").startswith("/"), F.concat(scheme, F.lit("://"), host_of(F.col(url)), "to"))
        .when(F.length("to") > 0, F.concat(
            scheme, F.lit("://"), host_of(F.col(url)), F.regexp_extract(F.concat(F.lit("/"), F.ltrim(path_of(F.col(url)), F.lit("/"))), r"(?s)^(.*/)", 1), F.col("to"))))
    return links.withColumn("__target", target).select(page_key(F.col(url)).alias("a"), page_key(F.col("__target")).alias("b")).filter(
        "a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None,
    url: str = "url", html: str | None = "html",
) -> DataFrame:
    """Pages with `host`, `path`, `rule` and `verdict` (allow or block).

    A page's own rule decides. Pages without one take the decision of their aliases: pages are aliases if
    their urls name the same page (`page_key`) or are connected by canonical links, refresh tags or rows
    (from_url, to_url) of `redirects`. An alias that a rule allows comes before any that a rule blocks;
    the target of a link counts as an alias though it is no row. Nothing known means allow. NULL urls and
    urls without `://` have empty host and path and no aliases. Input columns named like a result are replaced.
    """
    u = F.col(url)
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(u), "path": path_of(u)})
    rows = rows.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("__page", page_key(u))
    edges = alias_edges(pages.select(url, html), url, html) if html is not None else None
    if redirects is not None:
        more = redirects.select(page_key(F.col("from_url")).alias("a"), page_key(F.col("to_url")).alias("b"))
        edges = more if edges is None else edges.unionByName(more)
    own = rows.select(F.col("__page").alias("node"), F.col("__rule.verdict").alias("v"))
    if edges is not None:
        edges = stored(edges.filter("a IS NOT NULL AND b IS NOT NULL"))
        roots = stored(connected_components(edges))
        as_url = F.concat(F.lit("x://"), "node")
        ends = roots.select("node", rule_of(host_of(as_url), path_of(as_url), rules)["verdict"].alias("v"))
        own = own.unionByName(ends)
    known = own.filter("node IS NOT NULL AND v IS NOT NULL").groupBy("node").agg(
        F.bool_or(F.col("v") == "allow").alias("allowed"), F.bool_or(F.col("v") == "block").alias("blocked"))
    if edges is not None:
        placed = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        decided = placed.groupBy("root").agg(F.bool_or("allowed").alias("allowed"), F.bool_or("blocked").alias("blocked"))
        known = roots.join(decided, "root").select("node", "allowed", "blocked").unionByName(
            placed.join(roots, "node", "left_anti").select("node", "allowed", "blocked"))
    blocked = known.filter("blocked AND NOT allowed").select(F.col("node").alias("__page"), F.lit(True).alias("__blocked"))
    return rows.join(blocked, "__page", "left").withColumns({
        "rule": F.col("__rule.rule"),
        "verdict": F.coalesce("__rule.verdict", F.when(F.col("__blocked"), "block").otherwise("allow"))}).drop("__rule", "__page", "__blocked")
