"""Web pages to documents: visible text, title, publication time, links, table cells."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..functions.text import norm_ws
from ..functions.times import publication_ts
from ..functions.urls import public_url, resolve_href

# Elements that break lines, and elements whose content is never shown.
BLOCKS = ("p|div|section|article|header|footer|main|aside|nav|li|ul|ol|h1|h2|h3|h4|h5|h6|blockquote|pre|"
          "table|caption|tr|br|hr")
HIDDEN = "script|style|noscript|template|svg"
PUBLISHED_NAMES = ["datepublished", "date", "pubdate"]
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def without_hidden(html: Column) -> Column:
    """Comments and hidden elements removed; an unclosed hidden element hides the rest."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(out, rf"(?is)<({HIDDEN})\b[^>]*>(?:.*?</\1\s*>|.*$)", "")


def _body(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>", "")


def attribute(tag: Column, name: str) -> Column:
    """Value of one attribute of a start tag, decoded; null when absent."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])
    return F.when(tag.rlike(pattern), unescape(value))


def unescape(c: Column) -> Column:
    """Character references to characters, numeric ones and the standard named ones."""
    table = F.from_json(F.lit(json.dumps({name: chr(code) for name, code in name2codepoint.items()})), "map<string,string>")

    def decode(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]{1,31});", 1)
        dec, hexa = F.regexp_extract(piece, r"^#(\d{1,7});", 1), F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(dec != "", F.hex(dec.cast("int"))).when(hexa != "", hexa)
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        found = F.when(name != "", table[name]).otherwise(char)
        return F.when(i == 0, piece).otherwise(let(found, lambda x: F.when(
            x.isNotNull(), F.concat(x, F.regexp_replace(piece, r"^[^;]*;", ""))).otherwise(F.concat(F.lit("&"), piece))))

    return let(c, lambda text: F.when(F.contains(text, F.lit("&")), F.array_join(
        F.transform(F.split(text, "&"), decode), "")).otherwise(text))


def _anchors(html: Column) -> Column:
    """Pieces of the page; a piece that starts with a link tag is the text of that link."""
    return F.split(html, r"(?i)</a\s*>|(?=<a[\s>])")


def _link_target(piece: Column, url: Column) -> Column:
    href = attribute(F.regexp_extract(piece, r"(?is)^(<a\b[^>]*>)", 1), "href")
    return let(href, lambda h: F.when(F.length(h) > 0, public_url(resolve_href(url, F.trim(h)))))


def _strip(html: Column) -> Column:
    broken = F.regexp_replace(html, rf"(?is)</?(?:{BLOCKS})\b[^>]*>", "\n")
    return unescape(F.regexp_replace(broken, r"(?s)</?[A-Za-z!][^>]*>", ""))


def _inline(html: Column, url: Column) -> Column:
    """Text of a fragment; each link is followed by its address in brackets."""
    return F.array_join(F.transform(_anchors(html), lambda p: F.concat(_strip(p), F.when(
        p.rlike(r"(?i)^<a[\s>]"), F.coalesce(F.concat(F.lit(" ["), _link_target(p, url), F.lit("]")), F.lit(""))).otherwise(F.lit("")))), "")


def _cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]\b|<t[dh]\b|$)"), 1)


def pipe_row(row: Column, url: Column) -> Column:
    """One table row as pipe-delimited text; literal pipes and backslashes are escaped."""
    cells = F.transform(_cells(row), lambda c: F.regexp_replace(norm_ws(_inline(c, url)), r"([\\|])", r"\\$1"))
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(" "), c, F.lit(" "))), "|"), F.lit("|"))


def visible_text(html: Column, url: Column) -> Column:
    """Visible text, one line per block, blank lines dropped, table rows kept as pipe rows."""
    pieces = F.split(_body(without_hidden(html)), r"(?i)(?=<tr[\s>])|</tr\s*>|(?=</table\b)")
    is_row = lambda p: p.rlike(r"(?i)^<tr[\s>]")
    prose = lambda p: F.filter(F.transform(F.split(_inline(p, url), _LINES), norm_ws), lambda line: line != "")
    lines = F.flatten(F.transform(pieces, lambda p: F.when(is_row(p), F.array(pipe_row(p, url))).otherwise(prose(p))))
    return F.array_join(lines, "\n")


def page_title(html: Column, url: Column) -> Column:
    title = norm_ws(unescape(F.regexp_extract(without_hidden(html), r"(?is)<title\b[^>]*>(.*?)</title", 1)))
    return let(title, lambda t: F.when(t == "", url).otherwise(t))


def published_at(html: Column) -> Column:
    """First stated publication time with a zone; date-only labels stay null."""
    tags = F.regexp_extract_all(without_hidden(html), F.lit(r"(?is)<(?:meta|time)\b[^>]*>"), 0)

    def stated(tag: Column) -> Column:
        low = lambda name: F.lower(F.coalesce(attribute(tag, name), F.lit("")))
        meta = F.lower(tag).rlike(r"^<meta\b")
        named = (low("property") == "article:published_time") | (low("itemprop") == "datepublished") | low("name").isin(PUBLISHED_NAMES)
        label = F.when(meta & named, attribute(tag, "content")).when(~meta & (low("itemprop") == "datepublished"), attribute(tag, "datetime"))
        return let(label, publication_ts)

    return F.get(F.filter(F.transform(tags, stated), lambda x: x.isNotNull()), F.lit(0))


def documents_from_pages(pages: DataFrame) -> DataFrame:
    """``pages(url, html, ..)`` to documents with text, title and publication time."""
    html, url = F.col("html"), F.col("url")
    return pages.withColumns({"content": visible_text(html, url), "title": page_title(html, url), "published_at": published_at(html)}).drop("html")


def page_links(pages: DataFrame, key: str) -> DataFrame:
    """Resolved links with their anchor text, each (address, text) once per page, in page order."""
    url = F.col("url")
    anchors = F.filter(_anchors(_body(without_hidden(F.col("html")))), lambda p: p.rlike(r"(?i)^<a[\s>]"))
    links = F.filter(F.transform(anchors, lambda p: F.struct(_link_target(p, url).alias("url"), norm_ws(_strip(p)).alias("text"))),
                     lambda s: s["url"].isNotNull())
    return pages.select(key, F.posexplode(F.array_distinct(links)).alias("pos", "link")).select(key, "pos", "link.url", "link.text")


def table_cells(pages: DataFrame, key: str) -> DataFrame:
    """One row per table cell: page, row number, column number and text; empty cells are kept."""
    body = _body(without_hidden(F.col("html")))
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr\b|<tr\b|</table\b|$)"), 1)
    out = pages.select(key, "url", F.posexplode(rows).alias("row", "r"))
    return out.select(key, "url", "row", F.posexplode(_cells(F.col("r"))).alias("col", "c")).select(
        key, "row", "col", norm_ws(_inline(F.col("c"), F.col("url"))).alias("text"))
