"""Allow and block rules for urls, with block decisions carried to aliases.

A rule has a host and a path prefix. It fits its host and all subdomains where the url's path starts with the
rule's path; the longest fitting rule wins, and its action is the verdict. Pages that redirect to each other
or name each other as canonical are aliases: their urls, with redirects and canonical links as edges,
form connected components. A page without a rule is blocked if any url of its component is blocked by a rule.
A page that a rule allows stays allowed, whatever its component holds. Everything else is allowed.

Hrefs are resolved as RFC 3986 says: dot segments go, `?x` keeps the page's path, an empty href or `#x` is the page itself and
no edge, other schemes (mailto:) are no edges. Attribute values may be quoted either way or bare; &amp; and the like are decoded.
<base> elements are not read.

Defined results: a url that is null or has no `://` has an empty host and path, fits no rule and is allowed;
null or empty html has no edges; urls and html of any length are read whole; repeated rows are judged alike; an empty table
gives an empty table; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import heavy_join, staged
from sieveline.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: action, host, path prefix
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A link or meta element, an attribute value quoted either way or bare, and character references.
TAG = r"""(?i)<(?:link|meta)\s(?:"[^"]*"|'[^']*'|[^>"'])*>"""
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'>\s]+))"""
REFERENCES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What a url addresses: host, path and query, without scheme and fragment; null if it has no host."""
    key = F.concat(host_of(url), F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^#]*)", 1))
    return F.when(host_of(url) != "", key)


def ruling(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its action; both null without one."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one tested is the outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def without_dots(path: Column) -> Column:
    """A path from `/` without its `.` and `..` segments."""
    closed = F.when(path.rlike(r"/\.\.?\z"), F.concat(path, F.lit("/"))).otherwise(path)
    steps = F.split(F.substring(closed, F.lit(2), F.length(closed)), "/")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(path)


def resolved(base: Column, href: Column) -> Column:
    """An href as a full url, seen from a page's url; null if it is the page itself or has no host."""
    scheme = F.regexp_extract(base, r"(?s)\A(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)\A.*?://[^/?#]*", 0)
    own = F.regexp_extract(base, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(own, r"[^/]*\z", "")
    path, rest = F.regexp_extract(href, r"(?s)\A([^?#]*)", 1), F.regexp_extract(href, r"(?s)\A[^?#]*(.*)", 1)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    return (
        F.when((href == "") | href.startswith("#"), F.lit(None).cast("string"))
        .when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://"), href)
        .when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("?"), F.concat(origin, own, href))
        .otherwise(F.concat(origin, without_dots(rooted), rest))
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of an element's attribute, decoded and without spaces around it; empty if there is none."""
    shape = rf"""(?i)[\s"'/]{name}{VALUE}"""
    found = F.concat(*(F.regexp_extract(tag, shape, i) for i in (1, 2, 3)))
    for name_, letter in REFERENCES:
        found = F.replace(found, F.lit(name_), F.lit(letter))
    return F.regexp_replace(found, r"\A\s+|\s+\z", "")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of pages and of the urls that they redirect to or name as canonical."""
    tag = F.col("tag")
    canonical = F.when(F.lower(attribute(tag, "rel")).rlike(r"(\A|\s)canonical(\s|\z)"), attribute(tag, "href"))
    refresh = F.when(F.lower(attribute(tag, "http-equiv")) == "refresh", F.regexp_extract(attribute(tag, "content"), r"""(?i)\A[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1))
    found = (
        pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv"))
        .select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(F.col(html), F.lit(TAG), 0)).alias("tag"))
        .select("url", F.coalesce(canonical, refresh).alias("href"))
        .where("href <> ''")
    )
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), F.col("href"))).alias("b")).where("a is not null and b is not null")


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) of every page; redirects: more edges, as urls (source, target)."""
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    members = connected_components(edges)
    address = F.concat(F.lit("x://"), F.col("node"))
    judged = members.withColumn("action", ruling(host_of(address), path_of(address), rules)[1])
    blocked = judged.where("action = 'block'").select("component").distinct()
    aliases = judged.join(blocked, "component", "left_semi").where("action is null").select("node", F.lit("block").alias("carried"))
    own = pages.select(key, F.col(url).alias("url")).select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    rule, action = ruling(F.col("host"), F.col("path"), rules)
    ruled = own.withColumns({"rule": rule, "action": action})
    asked = F.col("action").isNull() & F.col("node").isNotNull()
    # one url may hold many rows, so its verdict goes back through heavy_join
    counts = ruled.where(asked).groupBy("node").agg(F.count("*").alias("n"))
    verdicts = staged(counts.join(aliases, "node", "left"), "verdicts")
    plain = ruled.where(~asked).select(key, "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    carried = heavy_join(ruled.where(asked), verdicts, "node").select(key, "host", "path", "rule", F.coalesce("carried", F.lit("allow")).alias("verdict"))
    return plain.unionByName(carried)


def _sql_ruling(what: int) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, act)[what]}'" for act, h, p in ordered) + " END"


_HOST = "translate(regexp_extract({0}, '(?s)\\A.*?://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "')"
_NODE = "nullif(" + _HOST + ", '') || regexp_extract({0}, '(?s)\\A.*?://[^/?#]*([^#]*)', 1)"
def _sql_attribute(name: str) -> str:
    """attribute() for DuckDB."""
    shape = ("(?i)[\\s\"'/]" + name + VALUE).replace("'", "''")
    found = " || ".join(f"regexp_extract(tag, '{shape}', {i})" for i in (1, 2, 3))
    for name_, letter in REFERENCES:
        found = f"replace({found}, '{name_}', '{letter.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({found}, '^\\s+|\\s+$', '', 'g')"


_SCHEME = "[A-Za-z][A-Za-z0-9+.\\-]*:"
SQL = f"""
WITH RECURSIVE own AS (
  SELECT page_id, url, html, coalesce({_HOST.format('url')}, '') AS host,
         coalesce(regexp_extract(url, '(?s)\\A.*?://[^/?#]*([^?#]*)', 1), '') AS path, {_NODE.format('url')} AS node FROM pages),
tags AS (SELECT url, node, path, unnest(regexp_extract_all(html, '{TAG.replace("'", "''")}')) AS tag FROM own),
hrefs AS (SELECT node, path AS own_path, regexp_extract(url, '(?s)\\A.*?://[^/?#]*') AS origin, regexp_extract(url, '(?s)\\A(.*?)://', 1) AS scheme, CASE
    WHEN regexp_matches(lower({_sql_attribute('rel')}), '(^|\\s)canonical(\\s|$)') THEN {_sql_attribute('href')}
    WHEN lower({_sql_attribute('http-equiv')}) = 'refresh' THEN regexp_extract({_sql_attribute('content')}, '(?i)\\A[^;,]*[;,]\\s*url\\s*=\\s*["'']?([^"'']*)', 1) END AS href FROM tags),
parted AS (SELECT *, regexp_extract(href, '(?s)\\A[^?#]*') AS p, regexp_extract(href, '(?s)\\A[^?#]*(.*)', 1) AS rest, regexp_replace(own_path, '[^/]*$', '') AS folder FROM hrefs WHERE href <> ''),
rooted AS (SELECT *, CASE WHEN starts_with(p, '/') THEN p ELSE (CASE WHEN folder = '' THEN '/' ELSE folder END) || p END AS full_path FROM parted),
stepped AS (SELECT *, list_transform(string_split(substr(full_path || CASE WHEN regexp_matches(full_path, '/\\.\\.?$') THEN '/' ELSE '' END, 2), '/'), lambda s: [s]) AS steps FROM rooted),
full_urls AS (SELECT node, CASE
    WHEN starts_with(href, '#') THEN NULL
    WHEN regexp_matches(href, '^{_SCHEME}//') THEN href
    WHEN regexp_matches(href, '^{_SCHEME}') THEN NULL
    WHEN starts_with(href, '//') THEN scheme || ':' || href
    WHEN starts_with(href, '?') THEN origin || own_path || href
    WHEN contains(full_path, '/.') THEN origin || '/' || array_to_string(list_reduce(steps, lambda acc, s: CASE WHEN s[1] = '.' THEN acc WHEN s[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, s) END, CAST([] AS VARCHAR[])), '/') || rest
    ELSE origin || full_path || rest END AS target FROM stepped),
edges AS (SELECT DISTINCT node AS a, {_NODE.format('target')} AS b FROM full_urls),
ends AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a AS node, a AS seen FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON r.seen = e.a),
judged AS (SELECT node, seen, regexp_extract(seen, '\\A[^/?#]*') AS host, regexp_extract(seen, '\\A[^/?#]*([^?#]*)', 1) AS path FROM reach),
blocked AS (SELECT DISTINCT node FROM judged WHERE {_sql_ruling(1)} = 'block')
SELECT page_id, host, path, {_sql_ruling(0)} AS rule,
       coalesce({_sql_ruling(1)}, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM own
"""
