"""URL filters with redirect equivalence.

Rules judge a url by host and path. Redirects and canonical links make urls
aliases of one another; in each connected component of aliases, a block of
one url holds for those that no rule names, unless one of them is explicitly
allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import shared_dir, table
from loomgraph.llm.components import components

#: Components up to which their decisions are broadcast; beyond it the join is left to Spark.
BROADCAST_NODES = 100_000


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path: host after the first `://` with A-Z lower-cased, path up to `?` or `#`; both empty without `://` or for null."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def matched(df: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """Adds rule (host and path of the rule that fits, else null) and rule_verdict.

    A rule fits its host and all subdomains if the path starts with the rule's.
    The longest fitting rule wins; of equally long ones an allowing one, then
    the smallest. Rules are compiled into one CASE expression.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow", r.host, r.path))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits: Column = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


#: Patterns that the DataFrame form and its SQL twin share.
UTM = r"([?&])(?:utm_[^&]*(?:&|$))+"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?(?:[^\"'>]*\s)?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
LINKED = r"(?i)<(?:link\b[^>]*canonical|meta\b[^>]*refresh)"
BASE = r"(?is)<base\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
REFRESHED = r"(?is)\burl\s*=\s*[\"']?([^\"'>]+)"


def alias_key(url: Column) -> Column:
    """What a url has in common with its trivial variants: neither scheme, fragment, utm_ parameters nor a lone final slash of the host."""
    plain = F.regexp_replace(F.regexp_replace(url, r"#[\s\S]*$", ""), UTM, "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[?&]+$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(plain, r"^[^/?]*", 0)
    rest = plain.substr(F.length(host) + 1, F.length(plain))
    return F.concat(F.lower(host), F.when(rest.startswith("/"), "").otherwise("/"), rest)


def resolved(target: Column, base: Column) -> Column:
    """The absolute url of a link's target on a page of url `base`; null for other schemes, and for relative targets of a base without `://`.

    Character references of & are decoded and dot segments of relative targets removed.
    """
    t = F.trim(F.regexp_replace(target, "(?i)&(?:amp|#38|#x26);", "&"))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    to_path = F.regexp_extract(t, r"^[^?#]*", 0)
    full = F.when(to_path.startswith("/"), to_path).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), to_path))
    parts = F.split(F.regexp_replace(full, "^/", ""), "/")
    walked = F.aggregate(parts, F.lit(""), lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x)))
    walked = F.concat(walked, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    absolute = F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (t == "") | (root == ""), F.lit(None).cast("string"))
    absolute = absolute.when(t.startswith("//"), F.concat(F.regexp_extract(root, "^[^:]*:", 0), t)).when(to_path == "", F.concat(root, path, t))
    return absolute.otherwise(F.concat(root, walked, t.substr(F.length(to_path) + 1, F.length(t))))


def _href(tag: Column) -> Column:
    return F.concat(*(F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (from_url, to_url) of all canonical links and refresh redirects of the pages.

    Relative targets are resolved against the page's `<base>`, if it has one, else its url.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    targets = F.concat(F.transform(F.regexp_extract_all(h, F.lit(CANONICAL), F.lit(0)), _href), F.transform(F.regexp_extract_all(h, F.lit(REFRESH), F.lit(0)), lambda m: F.regexp_extract(m, REFRESHED, 1)))
    # One pass finds the few pages that may have links; only these are searched in detail.
    linked = pages.where(F.col(url).isNotNull() & h.rlike(LINKED)).select(F.col(url).alias("from_url"), F.col(html).alias("html_"), targets.alias("targets_")).where(F.size("targets_") > 0)
    base = F.coalesce(resolved(_href(F.regexp_extract("html_", BASE, 0)), F.col("from_url")), F.col("from_url"))
    rows = linked.select("from_url", base.alias("base_"), F.explode("targets_").alias("target_"))
    return rows.select("from_url", resolved(F.col("target_"), F.col("base_")).alias("to_url")).where("to_url is not null")


def judged(pages: DataFrame, edges: DataFrame, rules: Sequence[UrlRule], url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict (allow or block).

    A rule that fits the url decides. Else the url is blocked if its component
    of aliases has a blocked url and no explicitly allowed one; else allowed.
    Null urls and null ends of edges have no aliases. Input columns called like
    the outputs are replaced.
    """
    rows = matched(with_parts(pages.drop("host", "path", "rule", "verdict"), url), rules)
    keyed = edges.where("from_url is not null and to_url is not null").select("from_url", "to_url", alias_key(F.col("from_url")).alias("src"), alias_key(F.col("to_url")).alias("dst"))
    shared_dir(pages.sparkSession)
    keyed = keyed.distinct().checkpoint()
    found = components(keyed)
    named = keyed.select(F.col("from_url").alias("u"), F.col("src").alias("node")).unionByName(keyed.select(F.col("to_url").alias("u"), F.col("dst").alias("node")))
    named = named.unionByName(pages.where(F.col(url).isNotNull()).select(F.col(url).alias("u")).withColumn("node", alias_key(F.col("u"))).join(found.select("node"), "node", "left_semi").select("u", "node"))
    verdicts = matched(with_parts(named, "u"), rules).groupBy("node").agg(F.max((F.col("rule_verdict") == "block")).alias("b"), F.max(F.col("rule_verdict") == "allow").alias("a"))
    whole = verdicts.join(found, "node").groupBy("component").agg(F.coalesce(F.max("b"), F.lit(False)).alias("has_block"), F.coalesce(F.max("a"), F.lit(False)).alias("has_allow"))
    decided = found.join(whole, "component").where("has_block and not has_allow").select(F.col("node").alias("blocked_node"))
    if decided.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        decided = F.broadcast(decided)
    rows = rows.join(decided, alias_key(F.col(url)) == F.col("blocked_node"), "left")
    return rows.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("blocked_node").isNotNull(), "block").otherwise("allow"))).drop("rule_verdict", "blocked_node")


def op2_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page, with aliases by canonical links and refreshes in the pages' html.

    An empty table gives an empty result; repeated rows are judged alike.
    """
    pages = table(spark, sf_dir, "pages")
    return judged(pages.select("page_id", "url"), link_edges(pages), RULES).select("page_id", "host", "path", "rule", "verdict")


def _href_sql(tag: str) -> str:
    return "concat(" + ", ".join(f"regexp_extract({tag}, '{_quoted(HREF)}', {k})" for k in (1, 2, 3)) + ")"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _alias_sql(url: str) -> str:
    plain = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({url}, '#[\s\S]*$', ''), '{UTM}', '\1', 'g'), '[?&]+$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    return f"(lower(regexp_extract({plain}, '^[^/?]*')) || regexp_replace(regexp_replace({plain}, '^[^/?]*', ''), '^([?]|$)', '/\\1'))"


def _resolved_sql(rows: str, key: str, target: str, base: str, out: str) -> str:
    """A select over `rows` that adds the resolved url."""
    t, s = rf"trim(regexp_replace({target}, '&(?:amp|#38|#x26);', '&', 'gi'))", "[A-Za-z][A-Za-z0-9+.-]*"
    return rf"""
  SELECT {key}, CASE WHEN regexp_matches(t, '^{s}://') THEN t WHEN regexp_matches(t, '^{s}:') OR t = '' OR root = '' THEN NULL
    WHEN starts_with(t, '//') THEN regexp_extract(root, '^[^:]*:') || t WHEN to_path = '' THEN root || path || t
    ELSE root || list_reduce(list_prepend('', parts), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END)
      || CASE WHEN parts[-1] IN ('.', '..') THEN '/' ELSE '' END || substr(t, length(to_path) + 1) END AS {out}
  FROM (SELECT *, string_split(regexp_replace(CASE WHEN starts_with(to_path, '/') THEN to_path ELSE regexp_replace(path, '[^/]*$', '') || to_path END, '^/', ''), '/') AS parts
    FROM (SELECT *, {t} AS t, regexp_extract({t}, '^[^?#]*') AS to_path, regexp_extract({base}, '^({s}://[^/?#]*)', 1) AS root, regexp_extract({base}, '^{s}://[^/?#]*([^?#]*)', 1) AS path FROM {rows}))"""


_PARTS = r"translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"
_REST = "CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest"
_FITS = "LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)"
ORACLE = rf"""
WITH RECURSIVE r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
based AS ({_resolved_sql("(SELECT DISTINCT url, html FROM pages WHERE url IS NOT NULL)", "url, html", _href_sql(f"regexp_extract(coalesce(html, ''), '{_quoted(BASE)}')"), "url", "based")}
), target AS (
  SELECT url, coalesce(based, url) AS base, {_href_sql("tag")} AS target FROM (SELECT *, unnest(regexp_extract_all(coalesce(html, ''), '{_quoted(CANONICAL)}')) AS tag FROM based)
  UNION ALL SELECT url, coalesce(based, url), regexp_extract(tag, '{_quoted(REFRESHED)}', 1) FROM (SELECT *, unnest(regexp_extract_all(coalesce(html, ''), '{_quoted(REFRESH)}')) AS tag FROM based)
), edge AS (SELECT url, to_url FROM ({_resolved_sql("target", "url", "target", "base", "to_url")}) WHERE to_url IS NOT NULL
), step AS (SELECT DISTINCT {_alias_sql("url")} AS a, {_alias_sql("to_url")} AS b FROM edge
), reach(a, b) AS (
  SELECT a, b FROM (SELECT a, b FROM step UNION SELECT b, a FROM step UNION SELECT a, a FROM step UNION SELECT b, b FROM step)
  UNION SELECT x.a, y.b FROM reach x JOIN (SELECT a, b FROM step UNION SELECT b, a FROM step) y ON x.b = y.a
), ruled AS (
  SELECT url, arg_max(verdict, length(rhost || rpath)) AS verdict FROM (SELECT url, {_PARTS} FROM (SELECT url, {_REST} FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT to_url FROM edge))) {_FITS} GROUP BY url
), node AS (
  SELECT reach.a, bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false) AS blocked
  FROM reach JOIN (SELECT {_alias_sql("url")} AS k, verdict FROM ruled) ON k = reach.b GROUP BY reach.a
), m AS (
  SELECT page_id, url, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT row_number() OVER () AS i, page_id, url, {_PARTS} FROM (SELECT page_id, url, {_REST} FROM pages)) {_FITS} GROUP BY i, page_id, url, host, path
)
SELECT page_id, host, path, rule, coalesce(m.verdict, CASE WHEN node.blocked THEN 'block' ELSE 'allow' END) AS verdict FROM m LEFT JOIN node ON node.a = {_alias_sql("m.url")}
"""
