"""Column functions shared by several plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """Discounted price."""
    return F.col(price) * (1 - F.col(discount))


def money(total: Column) -> Column:
    """Rounded to cents, so that the order of summation does not show."""
    return F.round(total, 2)


def cosine(a: str, b: str) -> Column:
    """Cosine of two numeric arrays, in double precision."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Parts of a page that aren't its text, and the entities that are put back (the ampersand last).
SKIPPED = ("script", "style", "head", "nav", "header", "footer", "aside", "form", "noscript", "template")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&middot;": "\u00b7", "&copy;": "\u00a9", "&amp;": "&"}
#: In this order: comments and skipped parts go, block ends become line feeds, other tags go, blanks are made single.
PAGE_STEPS = (
    (r"(?s)<!--.*?-->", " "),
    *((rf"(?is)<{t}(\s[^>]*)?>.*?</{t}\s*>", " ") for t in SKIPPED),
    (r'(?is)<div class="ad">.*?</div>', " "),
    (r"\s+", " "),
    (r"(?i)</?(p|h[1-6]|li|tr|div|article|section|blockquote)(\s[^>]*)?>|<br\s*/?>", "\n"),
    (r"<[^>]*>", ""),
    (r" *\n[ \n]*", "\n"),
)


def page_text(html: str) -> Column:
    """The main text of a web page, a line for each block. Null stays null."""
    out = F.col(html)
    for pattern, by in PAGE_STEPS:
        out = F.regexp_replace(out, pattern, by)
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out, F.lit(" \n"))


def page_text_sql(html: str) -> str:
    """The same in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = html
    for pattern, by in PAGE_STEPS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(by)}, 'g')"
    for entity, char in ENTITIES.items():
        out = f"replace({out}, {quote(entity)}, {quote(char)})"
    return f"trim({out}, ' ' || chr(10))"
