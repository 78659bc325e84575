"""URL filters with redirect equivalence.

Rules (host, path prefix, verdict) fit a host and its subdomains; the longest that fits decides. A URL that
no rule fits takes the decision of its aliases: URLs joined by redirects (a page's refresh target, and
the rewriting that servers redirect to: scheme, default port, ``www.``, trailing slash, index file,
tracking parameters, fragment) or by canonical links are one component, found by distributed connected
components. Precedence: own rule; then an explicit allow of any alias; then a block of any alias; then
allow.

Defined results: null URLs and those without ``://`` have empty host and path, no rule and verdict allow, and
are nobody's alias; null html has no links; repeated rows are judged alike; of equally long rules allow wins;
an empty table gives an empty table; other columns are not read; URLs and pages of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch
from .components import connected_components

#: (host and path as one string, allowed)
RULES = [("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False)]
PARTS = r"^([^/?#]*)([^?#]*)"
TRACKING = r"(?i)^(?:utm_[a-z_]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid|sessionid|sid)(?:=|$)"
FEW_RULES, BROADCAST_RULES = 256, 1 << 18  # more are joined instead of written out, and joined by shuffle


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), PARTS, 2)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def redirect_target(url: Column) -> Column:
    """Where a server sends ``url``: the form all trivial variants share, without its scheme; null if it has no host."""
    tail = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(tail, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.(?:html?|php)$", "/"), r"/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def absolute(link: Column, base: Column) -> Column:
    """``link`` as found on the page ``base``."""
    link = F.trim(F.regexp_replace(link, "(?i)&amp;", "&"))
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    return F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link)).when(link != "", F.concat(F.regexp_replace(folder, r"([^/])$", "$1/"), link))


def page_links(html: Column, url: Column) -> Column:
    """URLs a page declares itself to be: canonical links and refresh targets outside comments and scripts."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", "")
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))"""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^<>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    hrefs = F.transform(links, lambda t: F.concat(*[F.regexp_extract(t, r"(?is)\bhref" + value, k) for k in (1, 2, 3)]))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^<>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    jumps = F.transform(metas, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'>]*)""", 1))
    return F.filter(F.transform(F.concat(hrefs, jumps), lambda x: absolute(x, url)), lambda x: x.isNotNull())


def _fits(host: Column, path: Column, rule: str) -> Column:
    domain, _, rest = rule.partition("/")
    return ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)


def with_rules(pages: DataFrame, rules: list[tuple[str, bool]] = RULES) -> DataFrame:
    """``pages`` (host, path) with ``rule`` and ``allowed``: the longest rule that fits, null if none does."""
    best = sorted(rules, key=lambda r: (-len(r[0]), not r[1]))
    if len(best) <= FEW_RULES:
        out = F.lit(None).cast("struct<rule string, allowed boolean>")
        for rule, allowed in reversed(best):
            out = F.when(_fits(F.col("host"), F.col("path"), rule), F.struct(F.lit(rule).alias("rule"), F.lit(allowed).alias("allowed"))).otherwise(out)
        return pages.withColumn("found", out).select("*", "found.rule", "found.allowed").drop("found")
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, a) for r, a in best], "domain string, prefix string, rule string, allowed boolean")
    # The rules are a list that the caller holds, so their number is known.
    table = F.broadcast(table) if len(best) <= BROADCAST_RULES else table
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = pages.select("host", "path").distinct()
    fits = hosts.select("host", "path", F.explode(domains).alias("domain")).join(table, "domain").where(F.col("path").startswith(F.col("prefix")))
    chosen = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "allowed"), F.struct(F.length("rule"), F.col("allowed"))).alias("found"))
    return pages.join(chosen, ["host", "path"], "left").select(*[pages[c] for c in pages.columns], "found.rule", "found.allowed")


def judge(pages: DataFrame, rules: list[tuple[str, bool]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, alias) for every row of ``pages`` (page_id, url[, html]).

    ``redirects``: more edges (a, b) of URLs, such as a crawler's log. alias is the least URL form of
    the row's component.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    has_html = "html" in pages.columns
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), redirect_target(F.col("url")).alias("form"), (page_links(F.col("html"), F.col("url")) if has_html else F.array().cast("array<string>")).alias("links"))
    own = scratch.keep(with_rules(own, rules), "pages")
    declared = own.select(F.col("form").alias("a"), F.explode("links").alias("link")).select("a", redirect_target(F.col("link")).alias("b"))
    if redirects is not None:
        declared = declared.union(redirects.select(redirect_target(F.col("a")), redirect_target(F.col("b"))))
    # A URL's own redirects to its form are edges too; only their ends that are forms are kept as nodes, the form standing for all its variants.
    component = scratch.keep(connected_components(declared, scratch), "components")
    named = own.drop("links").join(component, own["form"] == component["node"], "left").withColumn("alias", F.coalesce("component", "form"))
    explicit = named.where("alias is not null and allowed is not null").groupBy("alias").agg(F.bool_or("allowed").alias("alias_allowed"))
    out = named.join(explicit, "alias", "left").withColumn("decision", F.coalesce("allowed", "alias_allowed", F.lit(True)))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("decision"), "allow").otherwise("block").alias("verdict"), "alias")


def _rule_sql(rules: list[tuple[str, bool]]) -> str:
    cases = []
    for rule, allowed in sorted(rules, key=lambda r: (-len(r[0]), not r[1])):
        domain, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{rest}') THEN {{rule: '{rule}', allowed: {str(allowed).lower()}}}")
    return f"CASE {' '.join(cases)} END"


_TARGET_SQL = r"""CASE WHEN h <> '' THEN h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END END FROM (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www[.]', '') AS h,
 regexp_replace(regexp_replace(path, '/index[.](html?|php)$', '/'), '/+$', '') AS p, array_to_string(list_sort(list_filter(string_split(tail, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z_]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid|sessionid|sid)(=|$)'))), '&') AS q"""
_PARTS_SQL = rf"""SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS tail
 FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM"""
#: The same as DuckDB SQL, for whole-URL canonical links; components by repeated least ends.
ORACLE = rf"""
WITH RECURSIVE own AS (SELECT page_id, host, path, html, {_rule_sql(RULES)} AS found, "form" FROM (SELECT *, {_TARGET_SQL.replace("END FROM", 'END AS "form" FROM', 1)} FROM ({_PARTS_SQL} pages))))),
 links AS (SELECT own."form" AS a, unnest(list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<link[^<>]*>'), lambda t: regexp_matches(t, '(?i)rel\s*=\s*["'']?[^"''>]*canonical')), lambda t: regexp_extract(t, '(?is)href\s*=\s*["'']?([^"''\s>]*)', 1))) AS url FROM own),
 edges AS (SELECT a, b FROM (SELECT a, {_TARGET_SQL.replace("END FROM", "END AS b FROM", 1)} FROM ({_PARTS_SQL} links)))) WHERE a <> b),
 ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
 reach(a, b) AS (SELECT a, a FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
 named AS (SELECT own.*, coalesce(c.alias, own."form") AS alias FROM own LEFT JOIN (SELECT a, min(b) AS alias FROM reach GROUP BY a) c ON own."form" = c.a),
 said AS (SELECT alias, bool_or(found.allowed) AS allowed FROM named WHERE alias IS NOT NULL AND found IS NOT NULL GROUP BY alias)
SELECT page_id, host, path, found.rule AS rule, CASE WHEN coalesce(found.allowed, said.allowed, true) THEN 'allow' ELSE 'block' END AS verdict, named.alias AS alias FROM named LEFT JOIN said USING (alias)
"""
