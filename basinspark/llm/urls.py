"""URL filtering with decisions that spread over redirects and canonical links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, null if none does; rules are a short list held in the plan."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def resource(url: Column) -> Column:
    """A URL without scheme and fragment, its host in lower case: what an alias names."""
    return F.when(url.contains("://"), F.concat(url_host(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def plain_path(path: Column) -> Column:
    """A path without `.` and `..` segments; `..` at the root stays there."""
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    done = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.array_join(done, "/")).otherwise(path)


def resolved(df: DataFrame, link: str, url: str, name: str) -> DataFrame:
    """`name`: a link resolved against its page: whole URLs, //host/..., /path, ?query and paths beside the page, with . and .. segments.

    Null for an empty link, one to a place in the page, or no URL."""
    k, u = F.col(link), F.col(url)
    df = df.withColumns({"_host": F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1), "_scheme": F.regexp_extract(u, r"(?s)^(.*?:)//", 1), "_page": F.regexp_extract(u, r"(?s)^(.*?://[^?#]*)", 1), "_folder": F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*/)?", 1)})
    beside = F.concat("_host", F.when(F.col("_folder") == "", "/").otherwise(F.col("_folder")), k)
    whole = F.when(k.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), k).when(k.startswith("//"), F.concat("_scheme", k)).when(k.startswith("/"), F.concat("_host", k)).when(k.startswith("?"), F.concat("_page", k)).when((k != "") & ~k.startswith("#"), beside)
    df = df.withColumn("_whole", whole).withColumns({f"_{i}": F.regexp_extract("_whole", r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3)})
    return df.withColumn(name, F.concat("_1", plain_path(F.col("_2")), "_3")).drop("_host", "_scheme", "_page", "_folder", "_whole", "_1", "_2", "_3")


def html_aliases(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, alias) for canonical links and meta redirects in the pages' markup.

    What is in a comment, script or style does not count; links are resolved against the first <base href>, if there is one, else the page's URL.
    """
    rows = pages.where(F.col(html_col).rlike("(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), F.regexp_replace(html_col, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", "").alias("h"))
    href = r"""[^>]*\bhref\s*=\s*["']?([^"'\s>]*)"""
    canon = F.regexp_extract_all("h", F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)""" + href), F.lit(1))
    fresh = F.regexp_extract_all("h", F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'\s>]*)"""), F.lit(1))
    rows = rows.select("url", F.nullif(F.regexp_extract("h", r"(?is)<base\b" + href, 1), F.lit("")).alias("base"), F.explode(F.concat(canon, fresh)).alias("link"))
    rows = resolved(rows, "base", "url", "from").withColumn("from", F.coalesce("from", "url"))
    return resolved(rows, "link", "from", "alias").select("url", "alias").where("alias IS NOT NULL")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict, via of every row.

    A URL that a rule fits takes the verdict of the longest one. Another takes its aliases': URLs joined by
    canonical links, meta redirects and, if given, the rows of `redirects` (from_url, to_url) form a
    component; an explicit allow in it wins, else a block spreads to all, else the URL is allowed. via says
    which it was: rule, alias or default. A null URL, or one without ://, has an empty host and path and no
    aliases; nor has a page whose html is null. URLs of any length are taken whole. Repeated rows stay; other
    columns are not carried; an empty table gives an empty one.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"), resource(url).alias("res")).withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    parts = [html_aliases(pages, url_col, html_col).select(resource(F.col("url")).alias("x"), resource(F.col("alias")).alias("y"))] if html_col else []
    if redirects is not None:
        parts.append(redirects.select(resource(F.col("from_url")).alias("x"), resource(F.col("to_url")).alias("y")))
    if parts:
        edges = stored(reduce(DataFrame.unionByName, parts).where("x IS NOT NULL AND y IS NOT NULL AND x <> y").distinct())
        names = edges.selectExpr("x AS res").unionByName(edges.selectExpr("y AS res")).distinct().select("res", F.xxhash64("res").alias("node"))
        comps = components(edges.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b")))
        host, path = F.regexp_extract("res", r"(?s)^([^/?#]*)", 1), F.regexp_extract("res", r"(?s)^[^/?#]*([^?#]*)", 1)
        said = names.join(comps, "node").withColumn("v", best_rule(host, path, rules)["verdict"])
        decided = said.groupBy("component").agg(F.max(F.when(F.col("v") == "allow", 2).when(F.col("v") == "block", 1)).alias("d")).where("d IS NOT NULL")
        spread = said.select("res", "component").join(decided, "component").select("res", F.when(F.col("d") == 2, "allow").otherwise("block").alias("spread"))
        rows = rows.join(spread, "res", "left")
    else:
        rows = rows.withColumn("spread", F.lit(None).cast("string"))
    via = F.when(F.col("own").isNotNull(), "rule").when(F.col("spread").isNotNull(), "alias").otherwise("default")
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict"), via.alias("via"))


def op10_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), RULES).drop("via")


_FITS = "WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}'"
_BY = lambda value: "CASE " + " ".join(_FITS.format(h=h, p=p, v=value(v, h, p)) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
# Absolute canonical links and redirects, closed over; the tables hold none at this writing.
ORACLE_SQL = {
    "op10_url_filter": rf"""
WITH RECURSIVE u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, regexp_extract(url, '^.*?://(.*?)(#.*)?$', 1, 's') AS res, html FROM pages),
link AS (SELECT res AS x, regexp_extract(unnest(regexp_extract_all(html, '<link[^>]*canonical[^>]*>', 0, 'i')), '://([^"''\s>#]*)', 1) AS y FROM u),
e AS (SELECT x, y FROM link WHERE y <> '' AND x <> y UNION SELECT y, x FROM link WHERE y <> '' AND x <> y),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
n AS (SELECT x, regexp_extract(y, '^([^/?#]*)', 1) AS host, regexp_extract(y, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
v AS (SELECT x, max(CASE {_BY(lambda v, h, p: v)} WHEN 'allow' THEN 2 WHEN 'block' THEN 1 END) AS d FROM n GROUP BY x)
SELECT page_id, host, path, {_BY(lambda v, h, p: h + p)} AS rule, coalesce({_BY(lambda v, h, p: v)}, CASE d WHEN 1 THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN v ON u.res = v.x
""",
}
QUERIES = {"op10_url_filter": op10_url_filter}
