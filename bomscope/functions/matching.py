"""Headers against synonyms: exact, else by edit distance, as expressions over literal word lists.

The lists are settings of fixed size, so they travel inside the expression; a table's headers are matched where they
are, without a join or a shuffle. An exact hit skips the distances. Lambdas compute what they are given anew wherever they
use it, so every value that is used more than once goes through let().
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import flatten
from . import text

#: A header this short is never matched by distance.
FUZZY_LENGTH = 4


_MARK = "\u0001"


def literal(values: list[str]) -> Column:
    """A list of strings as one constant, however long it is; Spark folds the split once for each query."""
    if not values or any(_MARK in v for v in values):
        return F.array(*map(F.lit, values)).cast("array<string>")
    return F.split(F.lit(_MARK.join(values)), _MARK)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def match(norm: Column, synonyms: Mapping[str, list[str]], distance: int, rule, both_long: bool) -> Column:
    """struct(category, method, distance, synonym) of a normalised header; nulls with method none if nothing fits.

    rule normalises the synonyms. both_long: distances need FUZZY_LENGTH characters on both sides, else of the header only.
    The nearest synonym wins, the first listed of equally near ones.
    """
    words = flatten(synonyms, rule)
    none = F.struct(F.lit(None).cast("string").alias("category"), F.lit("none").alias("method"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("synonym"))
    if not words:
        return none
    first = {w: (c, o) for c, w, o in reversed(words)}  # of a word listed twice the first stays
    exact, exact_of, exact_said = literal(list(first)), literal([c for c, _ in first.values()]), literal([o for _, o in first.values()])
    near = [x for x in words if not both_long or len(x[1]) >= FUZZY_LENGTH]
    listed, near_of, near_said = (literal([x[k] for x in near]) for k in (1, 0, 2))

    def nearest(h: Column) -> Column:
        apart = F.transform(listed, lambda w, i: F.struct(F.levenshtein(h, w, distance).alias("d"), i.alias("i")))
        return F.when((F.length(h) >= FUZZY_LENGTH) & F.lit(distance > 0 and bool(near)), F.array_min(F.filter(apart, lambda x: x["d"] >= 0)))

    def named(of: Column, said: Column, at: Column, method: str, far: Column) -> Column:
        return F.struct(F.get(of, at).alias("category"), F.lit(method).alias("method"), far.alias("distance"), F.get(said, at).alias("synonym"))

    def found(h: Column) -> Column:
        fuzzy = let(nearest(h), lambda x: F.when(x["i"].isNull(), none).otherwise(named(near_of, near_said, x["i"], "fuzzy", x["d"])))
        hit = let(F.array_position(exact, h), lambda n: F.when(n > 0, named(exact_of, exact_said, (n - 1).cast("int"), "exact", F.lit(0))).otherwise(fuzzy))
        return F.when(h.isNull() | (h == ""), none).otherwise(hit)

    return let(norm, found)


def page_category(header: Column | str, synonyms: Mapping[str, list[str]], distance: int = 2) -> Column:
    """Category of a header for the page signal, or null."""
    return match(text.header_a(header), synonyms, distance, text.word_a, True)["category"]


def column_match(header: Column | str, synonyms: Mapping[str, list[str]], distance: int = 2) -> Column:
    """Match of a header for the column mapper."""
    return match(text.header_b(header), synonyms, distance, text.word_b, False)


def is_quantity(header: Column | str, words: list[str], distance: int = 2) -> Column:
    """Does table selection take the header for a quantity? It knows no punctuation rule."""
    return match(text.header_c(header), {"quantity": words}, distance, text.word_c, True)["category"].isNotNull()
