"""URL filters over redirect and canonical-link equivalence, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import cut
from cinefold.llm.components import connected_components

#: The production rules, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """A struct (size, allow, rule, verdict) of the longest rule that fits, allow first among equals; null if none does."""
    fits = [
        F.when(
            ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(r_path)),
            F.struct(F.lit(len(r_host + r_path)).alias("size"), F.lit(int(verdict == "allow")).alias("allow"), F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, r_host, r_path in rules
    ]
    return F.greatest(*fits, F.lit(None).cast("struct<size:int,allow:int,rule:string,verdict:string>"))


def alias_key(url: Column) -> Column:
    """The form in which URLs count as one: without fragment, A-Z of scheme and host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*", 0)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.substr(bare, F.length(head) + 1))


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL for a link: absolute, scheme-relative, root-relative, else under the base's folder."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*((?:[^?#]*/)?)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .when(href != "", F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def links_of(html: Column) -> Column:
    """Targets of a page's canonical links and refresh redirects; comments, scripts and styles don't count.

    Unclosed comments, scripts and styles go on to the end of the page, and an unclosed tag is none, so each character
    is looked at a few times at most.
    """
    shown = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", "")
    tags = lambda name: F.filter(F.regexp_extract_all(shown, F.lit(rf"(?is)(<{name}\b[^>]*(?:>|\z))"), F.lit(1)), lambda t: F.endswith(t, F.lit(">")))
    said = lambda word: rf"""\s*=\s*(?:"[^"]*\b{word}\b|'[^']*\b{word}\b|[^\s"'>]*\b{word}\b)"""
    tags = F.concat(
        F.filter(tags("link"), lambda t: t.rlike(r"(?is)\brel" + said("canonical"))),
        F.filter(tags("meta"), lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b")),
    )
    target = lambda t: F.trim(F.coalesce(
        F.nullif(F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1), F.lit("")),
    ))
    return F.filter(F.transform(tags, lambda t: F.replace(target(t), F.lit("&amp;"), F.lit("&"))), lambda t: t.isNotNull() & (t != ""))


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Pages with host, path, rule and verdict.

    A page that a rule fits has its verdict. The others take part in alias groups: connected components over canonical
    links, refresh redirects and, if given, rows (from_url, to_url) of ``redirects``; each URL that stands on a page or
    an edge brings the verdict of its own rule. A group with a blocked URL blocks its pages, unless some URL of the
    group is explicitly allowed; everything else is allowed. Null, empty and malformed URLs have an empty host and
    path, no rule, no aliases and the verdict allow. Repeated rows are judged alike; other columns are carried, though
    columns named as the four added ones are replaced. An empty table gives no rows.
    """
    pairs = pages.select(F.col(url).alias("from_url"), F.explode(links_of(F.col(html))).alias("href")).select("from_url", resolve(F.col("from_url"), F.col("href")).alias("to_url"))
    if redirects is not None:
        pairs = pairs.unionByName(redirects.select("from_url", "to_url"))
    pairs = cut(
        pairs.where((host_of(F.col("from_url")) != "") & (host_of(F.col("to_url")) != ""))
        .select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")).distinct()
    )
    added = {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    judged = pages.withColumns(added).withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    own = {"rule": F.col("_fit.rule"), "verdict": F.coalesce("_fit.verdict", F.lit("allow"))}
    if pairs.isEmpty():
        return judged.withColumns(own).drop("_fit")
    member = connected_components(pairs, native=True)
    fit = fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = (
        member.withColumn("fit", fit).groupBy("component")
        .agg(F.max(F.col("fit.verdict") == "block").alias("block"), F.max(F.col("fit.verdict") == "allow").alias("allow"))
        .where("block AND NOT coalesce(allow, false)")
    )
    aliases = member.join(blocked, "component").select(F.col("node").alias("_alias"), F.lit("block").alias("_group"))
    judged = judged.withColumn("_alias", F.when(F.col("host") != "", alias_key(F.col(url)))).join(aliases, "_alias", "left")
    own["verdict"] = F.coalesce("_fit.verdict", "_group", F.lit("allow"))
    return judged.withColumns(own).drop("_fit", "_alias", "_group")


SQL = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (
    SELECT url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS shown FROM pages),
hrefs AS (
    SELECT url, unnest(list_concat(
        list_transform(list_filter(regexp_extract_all(shown, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
        list_transform(list_filter(regexp_extract_all(shown, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b')), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))) AS link
    FROM tags),
bases AS (
    SELECT url, replace(link, '&amp;', '&') AS link, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^.*?://[^/?#]*') AS site,
           regexp_extract(url, '(?s)^.*?://[^/?#]*((?:[^?#]*/)?)', 1) AS folder FROM hrefs WHERE link <> ''),
targets AS (
    SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN site || link
                     ELSE site || CASE WHEN folder = '' THEN '/' ELSE folder END || link END AS link FROM bases),
keyed AS (
    SELECT regexp_replace(x, '(?s)#.*$', '') AS x, regexp_replace(y, '(?s)#.*$', '') AS y FROM (SELECT url AS x, link AS y FROM targets)
    WHERE regexp_extract(x, '(?s)^.*?://([^/?#]*)', 1) <> '' AND regexp_extract(y, '(?s)^.*?://([^/?#]*)', 1) <> ''),
ends AS (
    SELECT translate(regexp_extract(x, '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(x, length(regexp_extract(x, '(?s)^.*?://[^/?#]*')) + 1) AS a,
           translate(regexp_extract(y, '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(y, length(regexp_extract(y, '(?s)^.*?://[^/?#]*')) + 1) AS b FROM keyed),
edges AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
alias_fit AS (
    SELECT r.node, arg_max(u.verdict, length(u.h || u.p)) AS verdict FROM (SELECT node, seen, regexp_extract(seen, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(seen, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM reach) r
    JOIN rules u ON (r.host = u.h OR ends_with(r.host, '.' || u.h)) AND starts_with(r.path, u.p) GROUP BY r.node, r.seen),
aliases AS (SELECT node FROM alias_fit GROUP BY node HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')),
split AS (
    SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
fit AS (
    SELECT s.n, arg_max({'rule': u.h || u.p, 'verdict': u.verdict}, length(u.h || u.p)) AS f FROM split s JOIN rules u ON (s.host = u.h OR ends_with(s.host, '.' || u.h)) AND starts_with(s.path, u.p) GROUP BY s.n),
own AS (
    SELECT s.*, translate(regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           || substr(regexp_replace(url, '(?s)#.*$', ''), length(regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^.*?://[^/?#]*')) + 1) AS alias FROM split s)
SELECT o.page_id, o.host, o.path, f.f.rule AS rule, coalesce(f.f.verdict, CASE WHEN a.node IS NOT NULL AND o.host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM own o LEFT JOIN fit f ON f.n = o.n LEFT JOIN aliases a ON a.node = o.alias
"""
