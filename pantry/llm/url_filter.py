"""URL filters with redirect equivalence, by DataFrame operations only.

Every url gets the rule of greatest length that fits it: a rule is (verdict, host, path), and fits
its host and all subdomains where the url's path starts with the rule's path. Of equal rules with
both verdicts, allow counts.

Redirects and canonical links make urls aliases of each other: connected components over those
edges. A url with a rule of its own has that rule's verdict. Any other is blocked if some member
of its component is blocked by a rule and none is allowed by one (explicit allow precedes), and
allowed otherwise. Members that only occur as link targets count too.

Links are every `<link rel=canonical>` of a page and every `<meta http-equiv=refresh>` without delay,
outside of comments; character references in them are decoded (numeric ones, and the named ones that
urls have: amp, lt, gt, quot, apos, nbsp), and relative targets are resolved against the page's url with
`.` and `..` taken out, as browsers do (`<base>` is not looked at).

Up to INLINE_RULES rules are part of the plan; longer lists are joined on the host and its parent
domains, a handful of rows per distinct host and path. Results are the same.

Defined results for odd rows: a null url or one without `://` has empty host and path, fits no
rule with a host, has no aliases and is allowed. A null html has no links. Repeated rows stay
repeated; other columns are not looked at. An empty table gives an empty result. Very long urls and
pages are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table
from .components import connected_components

INLINE_RULES = 200

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"""(?is)<%s(?=\s)(?:[^>"']|"[^"]*"|'[^']*')*+>"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: The named references that occur in urls.
REFERENCES = {"quot": '"', "lt": "<", "gt": ">", "apos": "'", "nbsp": "\u00a0", "amp": "&"}


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a url in the graph: host, path and query; null without `://`."""
    path = path_of(url)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query_of(url)))


def decoded(text: Column) -> Column:
    """Character references replaced. Those of `&` come last, so nothing is decoded twice."""

    def one(done: Column, m: Column) -> Column:
        hex_ = F.regexp_extract(m, "^&#[xX]0*([0-9a-fA-F]{1,6});?$", 1)
        code = F.coalesce(F.conv(F.nullif(hex_, F.lit("")), 16, 10), F.regexp_extract(m, "^&#0*([0-9]{1,7});?$", 1)).try_cast("int")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (code != 38)
        return F.when(valid, F.replace(done, m, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(done)

    numeric = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[xX][0-9a-fA-F]+|[0-9]+);?"), F.lit(0)))
    numeric = F.array_sort(numeric, lambda x, y: F.length(y) - F.length(x))  # one may be the start of another
    out = F.aggregate(numeric, text, one)
    for name, sign in REFERENCES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign)) if name != "amp" else F.regexp_replace(out, "&(?:amp|#0*38|#[xX]0*26);|&#0*38(?![0-9])|&#[xX]0*26(?![0-9a-fA-F])", "&")
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """The raw value of a tag's attribute; empty where it has none."""
    pattern = rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    return F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"""(?s)^["']|["']$|[\t\n\r]""", "")


def without_dots(path: Column) -> Column:
    """`.` and `..` segments taken out of a path that starts with a slash."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))

    def step(done: Column, part: Column) -> Column:
        return F.when(part == ".", done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last, F.lit("/")).otherwise(F.lit("")))
    return F.when(F.regexp_like(path, F.lit(r"/\.\.?(/|$)")), joined).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """The url that a link on a page at `url` leads to; null for other schemes without `//`."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    target = F.regexp_replace(target, "(?s)#.*$", "")
    before, query = F.regexp_extract(target, r"(?s)^([^?]*)", 1), F.regexp_extract(target, r"(?s)^[^?]*(\?.*)?$", 1)
    return (
        F.when(F.regexp_like(target, F.lit(_SCHEME + "//")), target)
        .when(F.regexp_like(target, F.lit(_SCHEME)), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, without_dots(before), query))
        .when(before != "", F.concat(root, without_dots(F.concat(folder, before)), query))
        .when(query != "", F.concat(root, path_of(url), query))
        .otherwise(url)
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (u, v): nodes joined by a canonical link or an immediate redirect."""
    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("url IS NOT NULL AND html IS NOT NULL")
    rows = rows.where(F.col("html").rlike("(?i)canonical|refresh"))
    html = F.regexp_replace("html", _COMMENT, "")
    tags = rows.select("url", F.explode(F.regexp_extract_all(html, F.lit(_TAG % "(?:link|meta)"), F.lit(0))).alias("tag"))
    names = ("rel", "href", "http-equiv", "content")
    tags = tags.select("url", F.regexp_like("tag", F.lit("(?i)^<link")).alias("link"), *[attribute(F.col("tag"), n).alias(n.replace("-", "_")) for n in names])
    canonical = F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    raw = F.when(F.col("link") & canonical, F.col("href")).when(~F.col("link") & (F.lower("http_equiv") == "refresh"), F.col("content"))
    told = tags.select("url", "link", _some(raw, "raw")).select("url", "link", _some(decoded(F.col("raw")), "told"))
    refresh = F.regexp_like("told", F.lit(r"(?i)^\s*0*(\.0*)?\s*[;,\s]\s*url\s*="))
    aim = F.regexp_extract("told", r"""(?is)^[^;,]*?[;,\s]\s*url\s*=\s*["']?\s*([^"']*)""", 1)
    found = told.select("url", _some(F.trim(F.when(F.col("link"), F.col("told")).when(refresh, aim)), "target"))
    found = found.select("url", _some(resolved(F.col("target"), F.col("url")), "full"))
    found = found.select(_some(node_of(F.col("url")), "u"), "full").select("u", _some(node_of(F.col("full")), "v"))
    return found.where("u <> v").distinct()


def _some(value: Column, name: str) -> Column:
    """The value where it is neither null nor empty, else no row; what follows sees a column, not the
    expression, so nothing is computed twice."""
    return F.explode(F.filter(F.array(value), lambda x: x != "")).alias(name)


def _ordered(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[0], r[1], r[2]))


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds `rule` and `said` (the rule's verdict), null where none fits, to df(host, path, ...)."""
    host, path = F.col("host"), F.col("path")
    if len(rules) <= INLINE_RULES:
        hit = F.lit(None).cast("struct<rule:string,said:string>")
        for verdict, rule_host, rule_path in reversed(_ordered(rules)):
            fits = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
            value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("said"))
            hit = F.when(fits & F.startswith(path, F.lit(rule_path)), value).otherwise(hit)
        return df.withColumn("_hit", hit).select(*df.columns, "_hit.rule", "_hit.said")
    listed = df.sparkSession.createDataFrame(list(set(rules)), "said string, rule_host string, rule_path string")
    keys = df.select("host", "path").distinct()
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = (
        keys.withColumn("rule_host", F.explode(parents)).join(listed, "rule_host")
        .where(F.startswith(path, F.col("rule_path")))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), "said", "rule")).alias("best"))
        .select("host", "path", "best.rule", "best.said")
    )
    return df.join(hits, ["host", "path"], "left").select(*df.columns, "rule", "said")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, more_edges: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, host, path, rule, verdict). more_edges(src, dst):
    further pairs of equivalent urls, such as redirects that a crawler has followed."""
    url = F.col("url")
    edges = link_edges(pages)
    if more_edges is not None:
        edges = edges.union(more_edges.select(node_of(F.col("src")), node_of(F.col("dst")))).where("u <> v").distinct()
    groups = connected_components(edges)
    parts = groups.select(
        "node", "root", F.regexp_extract("node", r"(?s)^([^/?#]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path")
    )
    ruled = with_rule(parts, rules)
    verdicts = ruled.groupBy("root").agg(F.max(F.expr("said = 'allow'")).alias("allowed"), F.max(F.expr("said = 'block'")).alias("blocked"))
    blocked = verdicts.where("coalesce(blocked, false) AND NOT coalesce(allowed, false)").select("root")
    aliases = groups.join(blocked, "root", "left_semi").select("node", F.lit(True).alias("by_alias"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.cast("string").alias("url"))
    rows = with_rule(rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")), rules)
    rows = rows.join(aliases, "node", "left")
    verdict = F.coalesce("said", F.when(F.col("by_alias"), F.lit("block")), F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP1_SQL = f"""
WITH RECURSIVE rules(said, rule_host, rule_path) AS (VALUES {_SQL_RULES}),
p AS (SELECT page_id,
        translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*[^?#]*([?][^#]*)', 1), '') AS query, url, html FROM pages),
n AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS node FROM p),
t AS (SELECT node, unnest([
        regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1),
        regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)]) AS target
      FROM n WHERE contains(url, '://')),
e AS (SELECT node AS u, regexp_extract(target, '^(?s:.*?)://([^#]*)', 1) AS v FROM t WHERE contains(target, '://')),
b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach(a, z) AS (SELECT u, u FROM b UNION SELECT reach.a, b.v FROM reach JOIN b ON reach.z = b.u),
fit AS (SELECT x.node, r.said, r.rule_host || r.rule_path AS rule,
          row_number() OVER (PARTITION BY x.node ORDER BY length(r.rule_host || r.rule_path) DESC, r.said) AS k
        FROM (SELECT DISTINCT node, host, path FROM n UNION
              SELECT DISTINCT v, regexp_extract(v, '^([^/?]*)', 1), regexp_extract(v, '^[^/?]*([^?]*)', 1) FROM e) x
        JOIN rules r ON (x.host = r.rule_host OR ends_with(x.host, '.' || r.rule_host)) AND starts_with(x.path, r.rule_path)),
best AS (SELECT node, any_value(said) AS said, any_value(rule) AS rule FROM fit WHERE k = 1 GROUP BY node),
alias AS (SELECT a AS node, bool_or(said = 'block') AND NOT coalesce(bool_or(said = 'allow'), false) AS blocked
          FROM reach LEFT JOIN best ON best.node = reach.z GROUP BY a)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.said, CASE WHEN alias.blocked THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN best USING (node) LEFT JOIN alias USING (node)
"""
