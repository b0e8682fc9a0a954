"""Title, text and links of HTML pages, by expressions only.

A page is cut into tokens: comments, whole raw-text elements (``script``, ``style``, ``title``,
``textarea``), declarations, tags with quoted attributes, runs of text. Since a raw-text element
is one token, markup inside a script is never taken for markup. A comment or raw-text element
that is not closed reaches to the end of the page; a tag whose ``>`` or closing quote is missing
is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f]"
RAW = ["script", "style", "title", "textarea"]
INLINE = "a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup u var".split()
#: Named references that are decoded; others stay as they are written.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

_RAW = "|".join(rf"<{n}(?:[ \t\n\r\f/][^>]*)?>.*?(?:</{n}{WS}*>|\z)" for n in RAW)
TOKEN = (
    rf"(?is)<!--.*?(?:-->|\z)|{_RAW}|<[!?][^>]*>"
    r"""|</?[a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|[^<]+|<"""
)
TITLE = r"(?is)^<title(?:[ \t\n\r\f/][^>]*)?>(.*?)(?:</title[ \t\n\r\f]*>|\z)"
TEXTAREA = TITLE.replace("title", "textarea")
SILENT = r"(?is)^<(?:!|\?|(?:script|style|title)[ \t\n\r\f/>])"
TAG = r"(?is)^</?[a-z].*>$"
INLINE_TAG = rf"(?is)^</?(?:{'|'.join(INLINE)})[ \t\n\r\f/>]"
LINK = r"(?is)^<a[ \t\n\r\f/]"
ATTRIBUTE = r"""(?is)([^ \t\n\r\f"'>/=]+)[ \t\n\r\f]*=[ \t\n\r\f]*("[^"]*"|'[^']*'|[^ \t\n\r\f>"']+)"""
PIECE = r"(?is)&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z]+);|[^&]+|&"


def _one(piece: Column) -> Column:
    """A character reference as its character, anything else as it is."""
    hexed = F.conv(F.regexp_extract(piece, r"(?i)^&#x([0-9a-f]+);$", 1), 16, 10).cast("int")
    number = F.coalesce(F.regexp_extract(piece, r"^&#([0-9]+);$", 1).try_cast("int"), hexed)
    wrong = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    code = F.when(wrong, 0xFFFD).otherwise(number)
    out = F.when(piece.rlike("^&#.+;$"), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    for name, character in NAMED.items():
        out = out.when(piece == f"&{name};", F.lit(character))
    return out.otherwise(piece)


def decode_references(text: Column) -> Column:
    """Character references decoded once: ``&amp;lt;`` gives ``&lt;``."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, _one), "")).otherwise(text)


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def _shown(token: Column) -> Column:
    """What a token leaves in the text: nothing, a gap, or itself."""
    gap = F.when(token.rlike(INLINE_TAG), F.lit("")).otherwise(F.lit(" "))
    area = F.concat(F.lit(" "), F.regexp_extract(token, TEXTAREA, 1), F.lit(" "))
    marked = F.when(token.rlike(SILENT), F.lit(" ")).when(token.rlike(TEXTAREA), area).when(token.rlike(TAG), gap)
    return F.when(token.startswith("<"), marked.otherwise(token)).otherwise(token)


def _target(tag: Column) -> Column:
    """The first ``href`` of a tag, null without one."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2))
    value = F.get(values, (F.array_position(names, "href") - 1).cast("int"))
    bare = F.when(value.rlike("""^["']"""), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
    return decode_references(bare)


def parse_html(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``title``, ``text`` and ``links`` of each page.

    ``title`` is that of the first title element (null without one), ``text`` what is shown:
    blanks folded, inline tags leaving no gap, other tags one blank. ``links`` are the ``href``
    values of ``a`` tags in order, repeats included. A null page has null title and text and no
    links. Columns of these names are replaced.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    cut = df.withColumn("_tokens", F.regexp_extract_all(page, F.lit(TOKEN), F.lit(0)))
    titles = F.filter("_tokens", lambda t: t.rlike(TITLE))
    tags = F.filter("_tokens", lambda t: t.rlike(LINK) & t.endswith(">"))
    found = cut.withColumns(
        {
            "title": _folded(decode_references(F.regexp_extract(F.get(titles, F.lit(0)), TITLE, 1))),
            "text": F.when(F.col(html).isNotNull(), _folded(decode_references(F.array_join(F.transform("_tokens", _shown), "")))),
            "links": F.filter(F.transform(tags, _target), lambda t: t.isNotNull()),
        }
    )
    return found.drop("_tokens")
