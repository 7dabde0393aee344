"""Verdicts on urls by rules, carried over to what redirects and canonical links make one.

A rule fits its host and all subdomains where the url's path starts with its own; the longest that fits decides. Every
url stands at an address: standing redirects take away the scheme, a default port, `www.` or `m.`, slashes at the end of
the path, `utm_` parameters and the fragment. Addresses are nodes; canonical links and refreshes of the pages' HTML and
redirects of a given table are edges. Connected components are found by rounds of least labels. A url that no rule fits
is blocked where a rule blocks one of its component's urls and none allows one; else it is allowed.

Cases: a url that is null or has no `://` has an empty host and path, no address, and is allowed; an empty path starts
with no `/`; a null or very long HTML has the links that it has, all of it read; of rules equally long for a url allow
counts before block, then the first by its text; repeated rows are judged each; an empty table gives no rows; other columns
are kept by `judge`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join, unused
from .neardup import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule: action, host, path.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """Where standing redirects lead; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)\z", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    return F.when(host_of(url) != "", F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty where there is none."""
    got = F.regexp_extract_all(tag, F.lit(rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.regexp_replace(F.coalesce(F.try_element_at(got, F.lit(1)), F.lit("")), r"""^["']|["']\z""", "")


def absolute(href: Column, url: Column) -> Column:
    """`href` as seen from `url`; dot segments stay as written; null where it names no other page."""
    href = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract(url, r"^(?s)(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*\z", "")
    return (
        F.when((href == "") | href.startswith("#"), F.lit(None))
        .when(href.contains("://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and refreshes in the HTML of `pages` (url, html), outside comments and scripts."""
    # most pages name neither, and are not searched further
    some = pages.filter(F.col("url").contains("://") & F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    seen = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    tags = some.select("url", F.explode(F.regexp_extract_all(seen, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(tag.rlike(r"(?i)^<link") & attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|\z)"), attribute(tag, "href"))
    refresh = F.when(
        tag.rlike(r"(?i)^<meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh"),
        F.regexp_extract(attribute(tag, "content"), r"""(?i);\s*url\s*=\s*["']?([^"']*)""", 1),
    )
    named = tags.select("url", F.explode(F.array_compact(F.array(canonical, refresh))).alias("href"))
    return named.select("url", F.explode(F.array_compact(F.array(absolute(F.col("href"), F.col("url"))))).alias("target"))


def matched(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, action): the longest rule that fits each of `urls` (key, host, path) that any fits.

    A url meets the hosts that its own ends with, then the prefixes of its path as long as these hosts' rules; so rows
    grow with labels and lengths, not with the number of rules. `rules`: action, host, path.
    """
    known = rules.groupBy("host", "path").agg(F.min("action").alias("action"))
    lengths = known.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    ends = urls.filter("host <> ''").select(key, F.col("path").alias("_path"), F.explode(suffixes).alias("host"))
    sized = salted_join(ends, lengths, ["host"], [key, "_path"])
    prefix = sized.select(key, "host", "_path", F.explode("lengths").alias("_l")).filter(F.col("_l") <= F.length("_path"))
    fits = salted_join(prefix.select(key, "host", F.expr("substring(_path, 1, _l)").alias("path")), known, ["host", "path"], [key])
    rule = F.concat("host", "path")
    best = F.min(F.struct((-F.length(rule)).alias("less"), F.col("action").alias("action"), rule.alias("rule"))).alias("best")
    return fits.groupBy(key).agg(best).select(key, "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame | Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """`pages` (url, html) with host, path, rule and verdict; columns of these names are replaced.

    `redirects`: further edges (source, target), both urls.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("source").alias("url"), "target"))

    def node(url: str) -> Column:
        return F.md5(address_of(F.col(url)))

    links = cut(links.select("url", "target", node("url").alias("a"), node("target").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    urls = pages.select("url").union(links.select("url")).union(links.select("target")).filter(F.col("url").contains("://")).distinct()
    urls = cut(urls.select("url", node("url").alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    ruled = matched(urls, rules, "url")
    known = urls.select("url", "node").join(ruled, "url", "left")
    edges = links.filter("a <> b").select("a", "b").distinct()
    if not edges.isEmpty():
        known = known.join(components(edges), "node", "left")
    else:
        known = known.withColumn("label", F.lit(None).cast("string"))
    known = cut(known.select("url", F.coalesce("label", "node").alias("label"), "rule", "action"))
    blocked = known.groupBy("label").agg(F.count_if(F.col("action") == "allow").alias("allow"), F.count_if(F.col("action") == "block").alias("block"))
    blocked = blocked.filter("block > 0 AND allow = 0").select("label", F.lit("block").alias("alias"))
    verdicts = salted_join(known, blocked, ["label"], ["url"], "left")
    r, v, u = (unused(c, [*pages.columns, "host", "path"]) for c in ("_rule", "_verdict", "_url"))
    verdicts = verdicts.select(F.col("url").alias(u), F.col("rule").alias(r), F.coalesce("action", "alias", F.lit("allow")).alias(v))
    kept = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")), F.col("url").alias(u))
    # rows of one hot url differ in other columns
    h = unused("_hash", [*kept.columns, r, v])
    plain = [f"`{c}`" for c, kind in kept.dtypes if "map<" not in kind and "variant" not in kind]
    joined = salted_join(kept.withColumn(h, F.xxhash64(*plain)), verdicts, [u], [h], "left").drop(u, h)
    return joined.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "rule": F.col(r), "verdict": F.coalesce(v, F.lit("allow"))}).drop(r, v)


#: Fixed values of the contract.
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: From the contract, with every rule tried on every url and components by a recursive walk.
OP11_SQL = r"""
WITH RECURSIVE rules(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', ' ', 'g'), '(?i)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE contains(url, '://') AND regexp_matches(html, '(?i)\bcanonical\b|\brefresh\b')
), hrefs AS (
  SELECT url, replace(trim(CASE
      WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)[\s"'']rel\s*=\s*["'']?(?:[^"''>]*\s)?canonical(?:["''\s/>])')
      THEN regexp_replace(regexp_extract(tag, '(?i)[\s"'']href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']\z', '', 'g')
      WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)[\s"'']http-equiv\s*=\s*["'']?refresh["''\s/>]')
      THEN regexp_extract(regexp_replace(regexp_extract(tag, '(?i)[\s"'']content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']\z', '', 'g'), '(?i);\s*url\s*=\s*["'']?([^"'']*)', 1)
    END), '&amp;', '&') AS href FROM tags
), links AS (
  SELECT DISTINCT url, CASE
      WHEN contains(href, '://') THEN href
      WHEN href[1:2] = '//' THEN 'http:' || href
      WHEN href[1] = '/' THEN split_part(url, '://', 1) || '://' || regexp_extract(substring(url, strpos(url, '://') + 3), '^[^/?#]*') || href
      ELSE split_part(url, '://', 1) || '://' || regexp_extract(substring(url, strpos(url, '://') + 3), '^[^/?#]*')
        || coalesce(nullif(regexp_replace(regexp_extract(substring(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1), '[^/]*\z', ''), ''), '/') || href
    END AS target
  FROM hrefs WHERE href <> '' AND href[1] <> '#'
), urls AS (
  SELECT url, substring(url, strpos(url, '://') + 3) AS rest
  FROM (SELECT url FROM pages UNION SELECT url FROM links UNION SELECT target FROM links) WHERE contains(url, '://')
), parts AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM urls
), known AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)\z', '') || regexp_replace(path, '/+\z', '')
    || coalesce('?' || nullif(regexp_replace(regexp_replace(query, '(^|&)utm_[^&]*', '', 'g'), '^&', ''), ''), '') END AS address FROM parts
), tried AS (
  SELECT url, address, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM known LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
), edges AS (
  SELECT x.address AS a, y.address AS b FROM links AS l JOIN known AS x ON x.url = l.url JOIN known AS y ON y.url = l.target
), walk(a, b) AS (
  SELECT DISTINCT address, address FROM known WHERE address IS NOT NULL
  UNION SELECT w.a, e.b FROM walk AS w JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) AS e ON e.a = w.b
), spread AS (
  SELECT w.a AS address, count(*) FILTER (t.action = 'allow') AS allow, count(*) FILTER (t.action = 'block') AS block FROM walk AS w JOIN tried AS t ON t.address = w.b GROUP BY 1
)
SELECT p.page_id, coalesce(k.host, '') AS host, coalesce(k.path, '') AS path, t.rule,
  coalesce(t.action, CASE WHEN s.block > 0 AND s.allow = 0 THEN 'block' END, 'allow') AS verdict
FROM pages AS p LEFT JOIN known AS k ON k.url = p.url LEFT JOIN tried AS t ON t.url = p.url LEFT JOIN spread AS s ON s.address = t.address
"""
