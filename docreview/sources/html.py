"""HTML to text with regular expressions over columns."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMED: dict[str, str] = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
"""Characters of the named entities, from the standard library's table; a fixed blank is read as a blank."""
# Elements whose content is dropped, and elements that end a line.
SKIPPED = ("script", "style", "noscript", "svg", "template")
BLOCKS = ("p", "div", "section", "article", "blockquote", "pre", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br",
          "tr", "ul", "ol", "table", "header", "footer")
SPACE = r"[\s\x{a0}\x{3000}]"


def decode_entities(value: Column) -> Column:
    """Named, decimal and hexadecimal entities as characters, each once; what is none stays as it is."""
    names = F.create_map(*[F.lit(x) for item in NAMED.items() for x in item])

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
        text = F.when(name == "", F.lit(None)).when(name.startswith("#"), F.when(code == 160, " ").otherwise(number)).otherwise(
            F.try_element_at(names, name))
        rest = F.call_function("substr", part, F.length(name) + 2)
        return F.when(text.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(text, rest))

    parts = F.split(value, "&")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded)
    return F.when(F.contains(value, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))).otherwise(value)


def html_to_text(df: DataFrame, html: str = "html", max_title: int = 200) -> DataFrame:
    """Adds `title` and `content`: one line per block tag, pieces between other tags joined by a blank.

    Skipped elements, closed or not, and comments are dropped; the title comes first, followed by a blank line. A chain of native
    replacements: two control characters stand for block ends and for other tags until the pieces are joined.
    """
    block, piece = "\x01", "\x02"
    body = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->", piece)
    for tag in SKIPPED:
        body = F.regexp_replace(body, rf"(?is)<{tag}(?:\s[^>]*)?>.*?(?:</{tag}\s*>|$)", piece)
    raw_title = decode_entities(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title", 1))
    trim = lambda v: F.regexp_replace(v, f"^{SPACE}+|{SPACE}+$", "")
    title = F.substring(trim(F.regexp_replace(raw_title, f"{SPACE}+", " ")), 1, max_title)
    body = F.regexp_replace(body, r"(?is)<title[^>]*>.*?</title\s*>", piece)
    body = F.regexp_replace(body, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:[\s/][^>]*)?>", block)
    body = F.regexp_replace(body, r"<[^>]*>", piece)
    join = lambda b: F.array_join(F.filter(F.transform(F.split(b, piece), lambda x: trim(decode_entities(x))),
                                           lambda x: F.length(x) > 0), " ")
    text = F.array_join(F.filter(F.transform(F.split(body, block), join), lambda x: F.length(x) > 0), "\n")
    return df.withColumn("title", title).withColumn("content", F.when(
        F.length("title") > 0, F.concat("title", F.lit("\n\n"), text)).otherwise(text))
