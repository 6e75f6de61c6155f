"""Operator 1: host and path rules, and decisions that follow redirect and canonical-link aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ascii_lower, connected_components, table

#: (action, host, path) of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Query parameters that never change what a page is.
TRACKING = r"(^|&)(utm_[^=&]*|ref|fbclid|gclid)=[^&]*"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)"


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds host, path and key of the column ``url``; all empty without ``://``.

    The key is one spelling for a page: no scheme, ``www.``, fragment,
    tracking parameters or closing slashes.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*[^?#]*\?([^#]*)", 1), TRACKING, ""), r"^&+", "")
    parts = F.struct(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), query.alias("query__"))
    df = df.select(*df.columns, F.inline(F.array(parts)))  # a generator, so that filters are not copied through it
    key = F.concat(F.regexp_replace("host", r"^www\.", ""), F.regexp_replace("path", r"/+$", ""), F.when(F.col("query__") != "", F.concat(F.lit("?"), "query__")).otherwise(""))
    return df.withColumn("key", F.coalesce(F.when(F.col("host") != "", key), F.lit(""))).drop("query__")


def rule_number(rules) -> tuple[Column, list]:
    """The place, from 1, in the returned order of the longest rule that fits host and path (0: none); at one length allow goes first."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))
    out = F.lit(0)
    for k, (_, host, path) in reversed(list(enumerate(order, 1))):
        out = F.when(((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path)), F.lit(k)).otherwise(out)
    return out, order


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) of alias keys: a page and what its canonical link or refresh names.

    A link without a scheme or leading slash stays in the page's folder.
    """
    pull = lambda tag, attribute: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, attribute, 1))
    some = pages.select("url", "html").where(F.col("html").rlike("(?i)canonical|http-equiv"))
    links = some.select("url", F.explode(F.concat(pull(CANONICAL, HREF), pull(REFRESH, REFRESH_URL))).alias("link")).where("link <> ''")
    links = with_parts(links, "url").where("key <> ''")
    link, folder = F.col("link"), F.regexp_replace("path", r"[^/]*$", "")
    full = (
        F.when(F.contains(link, F.lit("://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(F.lit("http://"), "host", link))
        .otherwise(F.concat(F.lit("http://"), "host", F.when(folder == "", "/").otherwise(folder), link))
    )
    ends = links.select(F.col("key").alias("a"), F.replace(full, F.lit("&amp;"), F.lit("&")).alias("full__"))
    return with_parts(ends, "full__").select("a", F.col("key").alias("b")).where("b <> '' and a <> b")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Verdict for every row of ``pages(page_id, url, html)``.

    A url that a rule fits takes the rule's action. Any other takes that of
    its alias component (same alias key, or joined by canonical links and
    refreshes): allow if a member is allowed by a rule, else block if a member
    is blocked, else allow. A null url, or one without ``://``, has empty host
    and path, no alias and is allowed; a null html has no links. Repeated rows
    are judged alike and all returned; other columns are ignored. The number
    of rules is the caller's list; pages are only ever joined to one row a key.
    """
    number, order = rule_number(rules)
    of = lambda n, values: F.get(F.array(F.lit(None).cast("string"), *map(F.lit, values)), n)
    judged = with_parts(pages.select("page_id", "url"), "url").select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "key", number.alias("n__"))
    judged = judged.select("page_id", "host", "path", "key", of(F.col("n__"), [r[1] + r[2] for r in order]).alias("rule"), of(F.col("n__"), [r[0] for r in order]).alias("action"))
    said = lambda what: F.max(F.coalesce(F.col("action") == what, F.lit(False))).alias(what)
    keys = judged.groupBy("key").agg(said("allow"), said("block"))
    labels = connected_components(link_edges(pages))
    linked = labels.join(keys, labels.node == keys.key, "left").select("node", "label", F.coalesce("allow", F.lit(False)).alias("allow"), F.coalesce("block", F.lit(False)).alias("block"))
    parts = linked.groupBy("label").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    spread = linked.select("node", "label").join(parts, "label").select(F.col("node").alias("key"), F.col("allow").alias("a2"), F.col("block").alias("b2"))
    known = keys.join(spread, "key", "left").select("key", F.coalesce("a2", "allow").alias("allow"), F.coalesce("b2", "block").alias("block")).where("allow or block")
    told = known.select("key", F.when(F.col("allow"), "allow").otherwise("block").alias("spread"))
    out = judged.join(told, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), hit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM q) u JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY ALL
), form AS (
  SELECT page_id, url, html, 'p' AS kind, url AS u FROM q
  UNION ALL
  SELECT page_id, url, html, 'l', replace(CASE WHEN contains(l, '://') THEN l WHEN starts_with(l, '//') THEN 'http:' || l WHEN starts_with(l, '/') THEN 'http://' || host || l
    ELSE 'http://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || l END, '&amp;', '&')
  FROM (SELECT *, unnest(list_concat(
      list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*[''"]?([^"''\s>]+)', 1)))) AS l FROM q) WHERE l <> ''
), parts AS (
  SELECT page_id, url, kind, translate(regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
    regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS pa,
    regexp_replace(regexp_replace(regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS qu
  FROM form WHERE instr(u, '://') > 0
), k AS (
  SELECT page_id, url, kind, regexp_replace(h, '^www\.', '') || regexp_replace(pa, '/+$', '') || CASE WHEN qu <> '' THEN '?' || qu ELSE '' END AS key FROM parts WHERE h <> ''
), e AS (
  SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b ON a.page_id = b.page_id AND a.url = b.url AND a.kind = 'p' AND b.kind = 'l' AND a.key <> b.key
), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (
  SELECT a, a FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a
), keyed AS (
  SELECT key, bool_or(coalesce(action = 'allow', false)) AS allow, bool_or(coalesce(action = 'block', false)) AS block
  FROM (SELECT DISTINCT k.key, q.host, q.path FROM k JOIN q USING (page_id, url) WHERE k.kind = 'p') x LEFT JOIN hit USING (host, path) GROUP BY key
), spread AS (
  SELECT d.key, bool_or(o.allow) AS allow, bool_or(o.block) AS block
  FROM (SELECT key, key AS other FROM keyed UNION SELECT a, b FROM reach) d JOIN keyed o ON o.key = d.other GROUP BY d.key
)
SELECT q.page_id, coalesce(q.host, '') AS host, coalesce(q.path, '') AS path, hit.rule, coalesce(hit.action, CASE WHEN s.allow THEN 'allow' WHEN s.block THEN 'block' END, 'allow') AS verdict
FROM q LEFT JOIN hit ON hit.host = q.host AND hit.path = q.path
LEFT JOIN (SELECT DISTINCT page_id, url, key FROM k WHERE kind = 'p') kk ON kk.page_id = q.page_id AND kk.url = q.url
LEFT JOIN spread s ON s.key = kk.key
"""
QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE = {"op1_url_filter": SQL}
