"""Text columns: trimming, redaction, citations, message rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Personal-data patterns in the order they are applied. (?U) gives \w, \d and \b their
# Unicode meaning.
PERSONAL_DATA = [
    ("EMAIL", r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("SSN", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("PHONE", r"(?U)(?<!\d)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)"),
    ("CARD", r"(?U)\b(?:\d[ -]?){13,16}\b"),
]

# Fixed value: a manual section cited in brackets.
CITATION = r"\[([A-Z]{2,4}-\d+(?:\.\d+)?)\]"


# Fixed value: the characters trimming removes.
WHITE_SPACE = (
    " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def may_contain(label: str, text: Column) -> Column:
    """A cheap test that is true wherever the pattern of this kind can match."""
    return F.contains(text, F.lit("@")) if label == "EMAIL" else text.rlike(r"\p{Nd}")


def cited(text: Column) -> Column:
    """All section ids cited in brackets."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def money(cents: Column) -> Column:
    """Cents as $x.yy without grouping."""
    return F.format_string("$%.2f", cents / F.lit(100.0))
