"""Main text of web pages by differencing each page with the page of the nearest URL on its host."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .urls import url_host, url_path

FREE, MAIN, AROUND = 0, 1, 2
HIDDEN = frozenset("script style noscript template textarea select svg iframe object canvas title".split())
NAME, QUOTED = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)"), re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND_TAGS = frozenset("nav header footer aside form button dialog menu".split())
MAIN_TAGS = frozenset(("article", "main"))
AROUND_NAMES = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments respond disqus pagination pager form search toolbar contentinfo complementary".split())
MAIN_NAMES = frozenset("main article articlebody".split())


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each piece of markup, in time linear in the page.

    Comments and declarations have no name; an element of HIDDEN is one piece with its content, named " ". A tag ends at
    the first > outside quotes. Where a quote is not closed, that tag and all later ones end at the first >; a tag
    without any > takes the rest of the page.
    """
    pos, n, quotes = html.find("<"), len(html), True
    while pos >= 0:
        sign, end = html[pos + 1 : pos + 2], pos + 1
        if html.startswith("<!--", pos):
            end = html.find("-->", pos + 4) + 3
            end = n if end < 3 else end
            yield pos, end, "", False, ""
        elif sign in ("!", "?"):
            end = html.find(">", pos) + 1
            if not end:
                return
            yield pos, end, "", False, ""
        elif m := NAME.match(html, pos + 1):
            name, last = m[2].lower(), -1
            if quotes:
                last = QUOTED.match(html, m.end()).end()
                quotes = html[last : last + 1] == ">"
            if not quotes:
                last = html.find(">", m.end())
            if last < 0:
                yield pos, n, "", False, ""
                return
            end = last + 1
            if name in HIDDEN and not m[1]:
                if not (name == "svg" and html[last - 1] == "/"):
                    close = _closing(name).search(html, end)
                    end = close.end() if close else n
                yield pos, end, " ", False, ""
            else:
                yield pos, end, name, bool(m[1]), html[m.end() : last]
        pos = html.find("<", end)


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I)


def _around(marks: list[str], inside: bool) -> set[str]:
    """Names in class, id and role; outside the main element also the parts of names joined by hyphens and underscores."""
    whole = {w for x in marks for w in x.lower().strip("\"'").split()}
    return whole if inside else whole | {p for w in whole for p in re.split(r"[^a-z0-9]+", w)}


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, white space made one space, each FREE, in the MAIN element or AROUND it.

    Comments, scripts, styles and markup are left out, character references decoded. Elements that are not
    closed, or closed in the wrong order, end with what holds them.
    """
    out, buf, stack, opened = [], [], [], Counter()
    kind = FREE

    def flush():
        if buf:
            t = " ".join(unescape("".join(buf)).split())
            buf.clear()
            if t:
                out.append((t, kind))

    at = 0
    html = html or ""
    for start, end, name, closing, attributes in tags(html):
        if start > at:
            buf.append(html[at:start])
        at = end
        if name in ("", " "):
            buf.append(name)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                buf.append(" ")
            continue
        block = name not in INLINE
        if block:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    flush()
                    kind = stack[i][1]
                    opened.subtract(x for x, _ in stack[i:])
                    del stack[i:]
                    break
                if not block and stack[i][0] not in INLINE:
                    break
            continue
        if block and stack and stack[-1][0] == "p":
            kind = stack.pop()[1]
            opened["p"] -= 1
        marks = MARK.findall(attributes) if attributes else []
        names = _around(marks, kind == MAIN) if marks else ()
        now = kind
        if name in AROUND_TAGS or (names and names & AROUND_NAMES):
            now = kind if name == "header" and kind == MAIN else AROUND
        elif kind != AROUND and (name in MAIN_TAGS or (names and names & MAIN_NAMES)):
            now = MAIN
        if now != kind and not block:
            flush()
        if block or now != kind:
            stack.append((name, kind))
            opened[name] += 1
            kind = now
    if at < len(html):
        buf.append(html[at:])
    flush()
    return out


def line_hashes(lines: list[tuple[str, int]]) -> bytes:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t) for t, _ in lines], np.uint64).tobytes()


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of one longest common subsequence of a and b, by bit-parallel rows.

    Row i keeps, as the zero bits of one number, the positions of b where the length grows when a's first i
    lines are used; going back through the rows finds the lines.
    """
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    length = lambda row, j: j - (row & (1 << j) - 1).bit_count()  # noqa: E731  of the first j lines of b
    out, i, j = [], len(a), len(b)
    while i and j:
        if length(rows[i - 1], j) == (n := length(rows[i], j)):
            i -= 1
        elif length(rows[i], j - 1) == n:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def nearest_urls(urls: DataFrame) -> DataFrame:
    """(host, path, url, partner): for each of the distinct rows (host, path, url, rep) the rep of the URL before or
    after it, in the order of host, path and URL, that is of its host and shares the longer path with it; no row
    if alone. URLs of one path, which differ in the query, are nearest to each other.

    The order is one range-partitioned sort with an index over all rows, so that a host of any size is
    spread; neighbours meet by equal index.
    """
    spark = urls.sparkSession
    order = stored(urls.select("host", "path", "url", "rep").sort("host", "path", "url"))
    rows = order.sort("host", "path", "url").rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    rows = stored(spark.createDataFrame(rows, "i long, host string, path string, url string, rep long"))
    side = lambda d: rows.select((F.col("i") + d).alias("i"), F.col("host").alias("h"), F.col("path").alias("p"), F.col("rep").alias("r"))
    both = side(1).withColumn("after", F.lit(0)).unionByName(side(-1).withColumn("after", F.lit(1)))
    near = rows.join(both, "i").where("host = h")
    shared = F.coalesce(F.aggregate(F.sequence(F.lit(1), F.least(F.length("path"), F.length("p"))), F.lit(0), lambda a, k: F.when((a == k - 1) & (F.substring(F.col("path"), k, F.lit(1)) == F.substring(F.col("p"), k, F.lit(1))), k).otherwise(a)), F.lit(0))
    best = near.withColumn("s", F.when((F.length("path") > 0) & (F.length("p") > 0), shared).otherwise(0)).groupBy("host", "path", "url").agg(F.max(F.struct("s", (-F.col("after")).alias("before"), "r"))["r"].alias("partner"))
    return best


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars, n_lines, n_shared of every row.

    A page's lines are its text blocks. Lines that it shares with the page of the nearest URL on its host, in
    the longest common subsequence of the two, are taken out, unless the page marks them as its article
    (article, main or elements so named) or all its lines are shared (then the other is a copy). Lines
    that the markup calls menus, headers, footers, sidebars, notices, adverts, forms or comments are never
    text; where a page marks an article, nothing outside it is. Pages of one URL are versions of one page, and equal
    texts of one path are one: neither are partners. A page alone on its host, or without a host, has no partner. A null html is empty; repeated rows stay; other columns are not carried.
    """
    key = F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), key.alias("key"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))

    def hashes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "host", "path", "url")), pa.array([line_hashes(page_lines(h)) for h in b.column("html").to_pylist()], pa.binary())], ["key", "host", "path", "url", "lines"])

    lines = stored(rows.where("host <> ''").select("key", "host", "path", "url", "html").mapInArrow(hashes, "key long, host string, path string, url string, lines binary").dropDuplicates(["key"]))
    named = lines.where(F.length("lines") > 0).select("key", "host", "path", "url", F.xxhash64("host", "path", "lines").alias("same"))
    texts = stored(named.groupBy("host", "path", "same").agg(F.min("url").alias("url"), F.min("key").alias("rep")))
    near = nearest_urls(texts.groupBy("host", "path", "url").agg(F.min("rep").alias("rep")))

    def shared(batches):
        for b in batches:
            got = []
            for x, y in zip(b.column("lines").to_pylist(), b.column("other").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64).tolist(), np.frombuffer(y, np.uint64).tolist()
                c = common_lines(x, y)
                got.append([] if len(c) == len(x) else c)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(got, pa.list_(pa.int32()))], ["key", "gone"])

    pairs = texts.join(near, ["host", "path", "url"]).select(F.col("rep").alias("key"), "same", "partner")
    pairs = pairs.join(lines.select("key", "lines"), "key").select(F.col("same").alias("key"), "lines", "partner").join(lines.select(F.col("key").alias("partner"), F.col("lines").alias("other")), "partner")
    gone = pairs.select("key", "lines", "other").mapInArrow(shared, "key long, gone array<int>").where("size(gone) > 0").withColumnRenamed("key", "same")
    gone = named.select("key", "same").join(gone, "same").select("key", "gone")

    def parsed(batches):
        # what a page's text is made of is all that moves: its article, or, where none is marked, the lines that may be shared
        for b in batches:
            main, free, n = [], [], []
            for h in b.column("html").to_pylist():
                ls = page_lines(h)
                marked = any(k == MAIN for _, k in ls)
                main.append("\n".join(t for t, k in ls if k == MAIN) if marked else None)
                free.append([] if marked else [t if k == FREE else None for t, k in ls])
                n.append(len(ls))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "url", "key")), pa.array(main, pa.string()), pa.array(free, pa.list_(pa.string())), pa.array(n, pa.int64())], ["id", "url", "key", "main", "free", "n_lines"])

    def text(batches):
        for b in batches:
            texts, n = [], []
            for main, free, g in zip(*(b.column(c).to_pylist() for c in ("main", "free", "gone")), strict=True):
                g = set(g or ())
                texts.append(main if main is not None else "\n".join(t for i, t in enumerate(free) if t is not None and i not in g))
                n.append(len(g))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column("n_lines"), pa.array(n, pa.int64())], ["id", "url", "text", "n_chars", "n_lines", "n_shared"])

    kind = rows.schema["id"].dataType.simpleString()
    pieces = rows.select("id", "url", "key", "html").mapInArrow(parsed, f"id {kind}, url string, key long, main string, free array<string>, n_lines long")
    joined = pieces.join(gone, "key", "left").select("id", "url", "main", "free", "gone", "n_lines")
    return joined.mapInArrow(text, f"id {kind}, url string, text string, n_chars long, n_lines long, n_shared long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op9_html_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE_SQL = {}
