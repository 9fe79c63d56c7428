"""Normalisers of headers, page text and cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No-break space and five characters of no width, which clean-up turns into blanks.
ODD_BLANKS = "\u00a0\u200b\u200c\u200d\ufeff\u2060"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space, of any alphabet, at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def header_a(c: Column | str) -> Column:
    """Header as the page signals compare it: lower case, no white space or .: at the end; null if nothing is left."""
    clean = F.lower(squeeze(F.translate(_c(c), "\ufffd", ".")))
    return F.nullif(F.regexp_replace(clean, r"(?U)[:.\s]+$", ""), F.lit(""))


def header_b(c: Column | str) -> Column:
    """Header as the column mapper compares it: .: at the end go once, then white space; empty if nothing is left."""
    clean = F.lower(squeeze(F.translate(F.coalesce(_c(c), F.lit("")), "\ufffd", ".")))
    return strip(F.regexp_replace(clean, r"[:.]+$", ""))


def header_c(c: Column | str) -> Column:
    """Header as table selection compares it: white space and case only."""
    return F.lower(squeeze(F.coalesce(_c(c), F.lit(""))))


def fingerprint(headers: Column | str) -> Column:
    """Set of headers, ends stripped and lower-cased, without blanks; order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(_c(headers), F.array().cast("array<string>")), lambda h: F.lower(strip(F.coalesce(h, F.lit(""))))), lambda h: h != ""))


def page_text(c: Column | str) -> Column:
    """Page text with control characters (but tab and line ends) and replacement characters as full stops."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFD]", ".")


def clean_blanks(c: Column | str) -> Column:
    return F.translate(_c(c), ODD_BLANKS, " " * len(ODD_BLANKS))


def one_line(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"\r\n|\n|\r", " ")


def blank(c: Column | str) -> Column:
    """True for null and for white space alone."""
    return F.coalesce(~_c(c).rlike(r"(?U)\S"), F.lit(True))


def looks_numeric(c: Column | str) -> Column:
    """A number, perhaps with one decimal mark and a unit of one letter."""
    return F.coalesce(_c(c), F.lit("")).rlike(r"(?U)^\s*[+-]?\d+(?:[.,]\d+)?\s*[a-zA-Z]?\s*$")


def trivial(token: Column | str) -> Column:
    """A token that can't be a label: short, a number, or no letters at all."""
    t = _c(token)
    return (F.length(t) < 2) | t.rlike(r"(?U)^[\W\d_]+$") | t.rlike("^[\\p{Nd}\\u00b2\\u00b3\\u00b9\\u2070\\u2074-\\u2079\\u2080-\\u2089]+$")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two sets; 1 if both are empty."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


# The same three header rules for the few words of the settings, on the driver.


def _plain(s: str) -> str:
    return " ".join(s.replace("\ufffd", ".").split()).lower()


def word_a(s: str) -> str:
    return re.sub(r"[:.\s]+$", "", _plain(s))


def word_b(s: str) -> str:
    return re.sub(r"[:.]+$", "", _plain(s)).strip()


def word_c(s: str) -> str:
    return s.strip().lower()
