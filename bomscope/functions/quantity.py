"""Quantities as people write them: whole numbers, decimals, and text that is neither.

The grammar is that of Python's int() and float() with one comma allowed for the point: underscores between digits,
digits of any alphabet, exponents, nan and infinity. A cast is only tried on what the grammar accepts, as Spark's casts
accept other things (1d, 1f) and refuse some of these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

_D = r"\p{Nd}+(?:_\p{Nd}+)*"
INTEGER = rf"^[+-]?{_D}$"
DECIMAL = rf"^[+-]?(?:{_D}\.?(?:{_D})?|\.{_D})(?:[eE][+-]?{_D})?$"
SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)$"
#: First digits of decimal alphabets that drawings may use.
_ZEROS = [0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xE50, 0xFF10]
_DIGITS = "".join(chr(z + i) for z in _ZEROS for i in range(10))


def _ascii(c: Column) -> Column:
    return F.translate(c, _DIGITS + "_", "0123456789" * len(_ZEROS))


def parse(raw: Column | str) -> Column:
    """struct(kind, i decimal(38,0), d double, s string): kind int, float or text, or all null for a blank.

    A whole number too long for decimal(38,0) stays text, without a warning of its own.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    s = text.strip(raw)
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    pointed = F.when((commas == 1) & ~s.contains("."), F.replace(s, F.lit(","), F.lit("."))).otherwise(s)
    whole = F.when(s.rlike(INTEGER), _ascii(s).try_cast("decimal(38,0)"))
    real = F.when(pointed.rlike(DECIMAL), _ascii(pointed).try_cast("double"))
    endless = F.when(pointed.startswith("-"), F.lit("-Infinity")).otherwise(F.lit("Infinity"))
    odd = F.when(F.lower(pointed).contains("nan"), F.lit("NaN")).otherwise(endless)
    real = F.when(pointed.rlike(SPECIAL), odd.try_cast("double")).otherwise(real)
    kind = F.when(text.blank(raw), None).when(s.rlike(INTEGER) & whole.isNotNull(), "int").when(~s.rlike(INTEGER) & real.isNotNull(), "float").otherwise("text")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "int", whole).alias("i"),
        F.when(kind == "float", real).alias("d"),
        F.when(kind == "text", raw).alias("s"),
    )


def quoted(s: Column) -> Column:
    """A string as Python shows it: the quotes it doesn't hold, escapes for backslash and line ends."""
    body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(shown))
    double = s.contains("'") & ~s.contains('"')
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def warning(raw: Column | str, parsed: Column) -> Column:
    """The warning for a quantity that is no number, else null."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    number = text.strip(raw).rlike(INTEGER)
    return F.when((parsed["kind"] == "text") & ~number, F.concat(F.lit("quantity_unparseable:"), quoted(raw)))


def as_text(q: Column | str) -> Column:
    """A parsed quantity as text; whole decimals without a fraction."""
    q = F.col(q) if isinstance(q, str) else q
    real = F.when((F.abs(q["d"]) < 1e15) & (q["d"] == F.floor(q["d"])), q["d"].cast("decimal(20,1)").cast("string")).otherwise(q["d"].cast("string"))
    return F.coalesce(q["i"].cast("string"), real, q["s"])
