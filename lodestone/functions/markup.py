"""Markup of filings: format from content, safe HTML, and filing XML as HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import pretty_json

#: What never reaches a reader, as patterns whose matches go.
UNSAFE = (
    r"(?is)<script\b[^>]*>.*?</script>",
    r"(?is)<iframe\b[^>]*>.*?</iframe>",
    r"(?is)<object\b[^>]*>.*?</object>",
    r"""(?i)\son[a-z]+\s*=\s*(?:"[^"\n]*"|'[^'\n]*')""",
    r"""(?i)\s(?:href|src)\s*=\s*(?:"javascript:[^"\n]*"|'javascript:[^'\n]*')""",
)

#: Filing tags that become one HTML tag: tag, opening, closing. Fixed values.
TAGS = (
    ("DOCUMENT", '<main class="dart-document">', "</main>"),
    ("DOCUMENT-NAME", '<div class="document-name">', "</div>"),
    ("COMPANY-NAME", '<span class="company-name">', "</span>"),
    ("COVER-TITLE", "<h1>", "</h1>"),
    ("TITLE", "<h2>", "</h2>"),
    ("TABLE-GROUP", '<div class="table-group">', "</div>"),
    (r"SECTION-[0-9]+", "<section>", "</section>"),
    ("(?:BODY|COVER|LIBRARY)", "<div>", "</div>"),
    ("PGBRK", '<hr class="page-break">', ""),
)


def replaced(text: Column, steps) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def sanitize(html: Column) -> Column:
    return replaced(html, ((p, "") for p in UNSAFE))


def xml_to_html(xml: Column) -> Column:
    """Filing XML as HTML: declarations and comments go, known tags are renamed, layout attributes become styles."""
    steps = [("^﻿", ""), (r"(?is)<\?xml.*?\?>", ""), (r"(?is)<!DOCTYPE.*?>", ""), (r"(?s)<!--.*?-->", "")]
    for tag, opening, closing in TAGS:
        steps += [(rf"(?i)<{tag}(?![\w-])[^>]*>", opening), (rf"(?i)</{tag}>", closing)]
    for cell in ("TE", "TU"):
        steps += [(rf"(?i)<{cell}\b([^>]*)>", "<td$1>"), (rf"(?i)</{cell}>", "</td>")]
    steps += [(r"(?i)<COL\b([^>]*)></COL>", "<col$1>"), (r"(?i)<COL\b([^>]*)/>", "<col$1>")]
    steps += [(r'(?i)\sWIDTH="(\d+)"', ' style="min-width:$1px"'), (r'(?i)\sHEIGHT="\d+"', ""), (r'(?i)\sALIGN="([^"]+)"', ' data-align="$1"'), (r'(?i)\sVALIGN="[^"]+"', "")]
    steps += [(r'(?i)\sxmlns(?::\w+)?="[^"]*"', ""), (r'(?i)\sxsi:[\w-]+="[^"]*"', "")]
    return sanitize(replaced(xml, steps))


def fix_charset(html: Column) -> Column:
    return F.regexp_replace(sanitize(html), r"(?i)charset\s*=\s*(?:euc-kr|cp949)", "charset=utf-8")


def escape_html(text: Column) -> Column:
    return replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


def with_head(html: Column, head: str) -> Column:
    """``head`` at the start of the page's head; before the whole page if it has none."""
    quoted = head.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(html.rlike(r"(?i)<head\b[^>]*>"), F.regexp_replace(html, r"(?is)^(.*?<head\b[^>]*>)", "$1" + quoted)).otherwise(F.concat(F.lit(head), html))


def source_view(text: Column) -> Column:
    """A source as it stands, escaped, as one preformatted block."""
    return F.concat(F.lit("<pre>"), escape_html(text), F.lit("</pre>"))


def json_view(text: Column) -> Column:
    """JSON with line breaks and indents of two, escaped; a text that is no JSON as it stands."""
    return source_view(F.coalesce(pretty_json(text), text))


def sniff_format(head: Column, path: Column | None = None) -> Column:
    """PDF, XML, HTML, JSON or TEXT from how the content begins; else from the path's ending; else UNKNOWN."""
    start = F.lower(F.ltrim(F.substring(head, 1, 512)))
    by_content = F.when(start.startswith("%pdf"), "PDF").when(start.startswith("<!doctype html") | start.startswith("<html"), "HTML").when(start.startswith("<?xml") | start.startswith("<document"), "XML").when(start.startswith("{") | start.startswith("["), "JSON")
    if path is None:
        return F.coalesce(by_content, F.when(F.length(start) > 0, "TEXT").otherwise("UNKNOWN"))
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_path = F.when(end == "pdf", "PDF").when(end.isin("htm", "html"), "HTML").when(end == "xml", "XML").when(end == "json", "JSON").when(end == "txt", "TEXT")
    return F.coalesce(by_content, by_path, F.lit("UNKNOWN"))
