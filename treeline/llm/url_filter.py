"""URL rules with redirect equivalence, in DataFrame operations only.

Redirects (meta refresh) and canonical links of pages are edges between URLs. Connected components of these edges are
aliases of one another; a block decision of any alias holds for all aliases that no rule judges. A rule that fits a page
itself always decides, so an explicit allow is never overruled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import staged, table
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: (host, path, verdict): the rules of op7.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def url_host(url):
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url):
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def without_dots(path):
    """An absolute path without its `.` and `..` segments (RFC 3986, 5.2.4); `..` at the top is dropped."""
    parts = F.split(path, "/")
    up = lambda at: F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(1)))
    step = lambda at, c: F.when(c == ".", at).when(c == "..", up(at)).otherwise(F.concat(at, F.array(c)))
    left = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    joined = F.concat(F.array_join(left, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), joined).otherwise(path)


def url_node(url):
    """One name for a URL whatever its scheme, host's case, dot segments and fragment; null without `://`."""
    path = url_path(url)
    name = F.concat(url_host(url), F.when(path == "", "/").otherwise(without_dots(path)), F.regexp_extract(url, _URL, 3))
    return F.when(url.contains("://"), name)


def url_resolved(base, reference):
    """The URL that a link `reference` on the page `base` leads to, without scheme (`//host/path?query`) unless it has its own (RFC 3986, 5.2.2).

    Null for schemes without an authority (mailto: and the like), for a link to the page itself (empty or a fragment), and
    for a base without `://`. `&amp;` is read as `&`; <base> elements aren't looked at.
    """
    to = F.regexp_replace(F.replace(F.trim(reference), F.lit("&amp;"), F.lit("&")), r"(?s)#.*", "")
    path = F.when(url_path(base) == "", "/").otherwise(url_path(base))
    here = F.concat(F.lit("x://"), url_host(base))
    full = F.when(to == "", None).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
    full = full.when(to.startswith("//"), F.concat(F.lit("x:"), to)).when(to.startswith("/"), F.concat(here, to))
    full = full.when(to.startswith("?"), F.concat(here, path, to)).otherwise(F.concat(here, F.regexp_extract(path, r"(?s)^(.*/)", 1), to))
    return F.when(base.contains("://"), full)


def rule_of(host, path, rules):
    """(rule, verdict) of the longest rule that fits; of equal rules, allow. Null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Fixed forms of HTML: a link or meta tag, and what makes it a canonical link or a refresh.
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TARGET = r"""(?is)\burl\s*=\s*["']?([^"'>]*)"""


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): nodes of pages (url, html) and of their canonical links' and meta refreshes' targets."""
    tag = F.col("tag")
    href = F.concat(*(F.regexp_extract(tag, _HREF, i) for i in (1, 2, 3)))
    to = F.when(tag.rlike(_CANONICAL), href).when(tag.rlike(_REFRESH), F.regexp_extract(tag, _TARGET, 1))
    some = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://"))
    found = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag")).select("url", to.alias("to"))
    url = F.col("url")
    return found.select(url_node(url).alias("u"), url_node(url_resolved(url, F.col("to"))).alias("v"))


def url_verdicts(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict.

    rules: (host, path, allow or block), held in the plan. redirects: more edges (from_url, to_url). Null url or one
    without `://`: empty host and path, no aliases; null html: no links. A page that neither a rule nor an alias blocks is
    allowed. Of equally long rules allow wins. Rows are independent: repeated pages and ids stay as they are.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(url_node(F.col("from_url")), url_node(F.col("to_url"))))
    roots = connected_components(edges)
    host, path = F.regexp_extract("node", r"(?s)^([^/]*)", 1), F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1)
    blocked = roots.where(rule_of(host, path, rules)["verdict"] == "block").select("root").distinct()
    aliases = staged(roots.join(blocked, "root", "left_semi").select(F.col("node").alias("alias")), "aliases")
    judged = pages.select("page_id", url_node(F.col("url")).alias("node"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(aliases, F.col("node") == F.col("alias"), "left")
    method = F.when(F.col("alias").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def _dots(path: str) -> str:
    parts = f"list_reduce(list_transform(string_split({path}, '/')[2:], lambda c: [c]), lambda a, c: CASE c[1] WHEN '.' THEN a WHEN '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, c) END, [''])"
    return f"CASE WHEN regexp_matches({path}, '/[.][.]?(/|$)') THEN array_to_string({parts}, '/') || CASE WHEN split_part({path}, '/', -1) IN ('.', '..') THEN '/' ELSE '' END ELSE {path} END"


def _node(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN {_HOST.format(url=url)} || CASE WHEN {_PATH.format(url=url)} = '' THEN '/' ELSE {_dots(_PATH.format(url=url))} END || regexp_extract({url}, '{_URL}', 3) END"


_HOST = f"translate(regexp_extract({{url}}, '{_URL}', 1), '{_UPPER}', '{_LOWER}')"
_PATH = f"regexp_extract({{url}}, '{_URL}', 2)"
_SQL_TAGS = {k: v.replace("'", "''") for k, v in {"tag": _TAG, "canonical": _CANONICAL, "refresh": _REFRESH, "href": _HREF, "target": _TARGET}.items()}
OP7_SQL = f"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, coalesce({_HOST.format(url="url")}, '') AS host, coalesce({_PATH.format(url="url")}, '') AS path, {_node("url")} AS node FROM pages),
rules(h, p, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
tags AS (SELECT host, CASE path WHEN '' THEN '/' ELSE path END AS path, node, unnest(regexp_extract_all(html, '{_SQL_TAGS["tag"]}')) AS tag FROM parts WHERE node IS NOT NULL),
refs AS (
  SELECT host, path, node, regexp_replace(replace(trim(CASE
    WHEN regexp_matches(tag, '{_SQL_TAGS["canonical"]}') THEN regexp_extract(tag, '{_SQL_TAGS["href"]}', 1) || regexp_extract(tag, '{_SQL_TAGS["href"]}', 2) || regexp_extract(tag, '{_SQL_TAGS["href"]}', 3)
    WHEN regexp_matches(tag, '{_SQL_TAGS["refresh"]}') THEN regexp_extract(tag, '{_SQL_TAGS["target"]}', 1) END), '&amp;', '&'), '(?s)#.*', '') AS r FROM tags),
targets AS (
  SELECT node AS u, CASE WHEN r = '' THEN NULL WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN r WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(r, '//') THEN 'x:' || r WHEN starts_with(r, '/') THEN 'x://' || host || r WHEN starts_with(r, '?') THEN 'x://' || host || path || r
    ELSE 'x://' || host || regexp_extract(path, '(?s)^(.*/)', 1) || r END AS t FROM refs),
links AS (SELECT u, {_node("t")} AS v FROM targets WHERE t IS NOT NULL),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
bad AS (
  SELECT u AS node FROM both_ways JOIN rules ON (split_part(u, '/', 1) = h OR split_part(u, '/', 1) LIKE '%.' || h) AND starts_with(split_part(substr(u, length(split_part(u, '/', 1)) + 1), '?', 1), p)
  GROUP BY u HAVING max_by(verdict, length(h || p)) = 'block'
  UNION SELECT both_ways.v FROM bad JOIN both_ways ON bad.node = both_ways.u),
ruled AS (
  SELECT page_id, host, path, node, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM (SELECT *, row_number() OVER () AS n FROM parts) LEFT JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
  GROUP BY n, page_id, host, path, node)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
