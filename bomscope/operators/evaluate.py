"""Found page ranges and rows against expected ones.

expected and found: (doc, start_page, end_page), ends included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank


@dataclass(frozen=True)
class Limits:
    """What a document must reach: fixed values."""

    extra_pages: int = 2
    boundary: int = 1
    rows: float = 0.60
    described: float = 0.70


def overlaps(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of ranges of one document that share pages, and how many."""
    e = expected.select("doc", F.col("start_page").alias("exp_start"), F.col("end_page").alias("exp_end"))
    f = found.select("doc", F.col("start_page").alias("got_start"), F.col("end_page").alias("got_end"))
    pairs = e.join(f, "doc").where("exp_start <= got_end and got_start <= exp_end")
    return pairs.withColumn("shared", F.least("exp_end", "got_end") - F.greatest("exp_start", "got_start") + 1)


def best_overlap(expected: DataFrame, found: DataFrame, tolerance: int = 1) -> DataFrame:
    """Every expected range with the found one that shares most pages (the first of equals), and whether its ends are right."""
    over = Window.partitionBy("doc", "exp_start", "exp_end").orderBy(F.desc("shared"), "got_start", "got_end")
    best = overlaps(expected, found).withColumn("n", F.row_number().over(over)).where("n = 1").drop("n")
    e = expected.select("doc", F.col("start_page").alias("exp_start"), F.col("end_page").alias("exp_end")).distinct()
    near = (F.abs(F.col("exp_start") - F.col("got_start")) <= tolerance) & (F.abs(F.col("exp_end") - F.col("got_end")) <= tolerance)
    return e.join(best, ["doc", "exp_start", "exp_end"], "left").withColumn("found", F.col("got_start").isNotNull()).withColumn("ends_right", F.coalesce(near, F.lit(False)))


def _pages(ranges: DataFrame) -> DataFrame:
    return ranges.where("start_page <= end_page").select("doc", F.explode(F.sequence("start_page", "end_page")).alias("page")).distinct()


def extra_pages(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, extra) for each document with found pages that no expected range has."""
    return _pages(found).join(_pages(expected), ["doc", "page"], "left_anti").groupBy("doc").agg(F.count("*").alias("extra"))


def acceptance(expected: DataFrame, found: DataFrame, rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    """A row for each document with expected ranges: how its found ranges and its rows (source_pdf, description) do.

    missed: expected ranges that no found one meets; wrong_ends: those whose best found range starts or ends more than the
    limit away; extra: found pages that nobody expected; described: the share of rows with a description, null without
    rows. accepted: all limits are kept, and no description has a replacement character.
    """
    limits = limits or Limits()
    best = best_overlap(expected, found, limits.boundary).groupBy("doc").agg(
        F.count("*").alias("ranges"), F.count_if(~F.col("found")).alias("missed"), F.count_if(F.col("found") & ~F.col("ends_right")).alias("wrong_ends"))
    wanted = expected.groupBy("doc").agg(F.coalesce(F.sum("approx_rows"), F.lit(0)).alias("expected_rows"))
    own = rows.groupBy(F.col("source_pdf").alias("doc")).agg(F.count("*").alias("rows"), F.avg((~blank("description")).cast("int")).alias("described"), F.count_if(F.col("description").contains("\ufffd")).alias("lost"))
    out = best.join(wanted, "doc").join(extra_pages(expected, found), "doc", "left").join(own, "doc", "left").fillna(0, ["extra", "rows", "lost"])
    enough = F.col("rows") >= F.floor(F.col("expected_rows") * limits.rows)
    good = (F.col("missed") == 0) & (F.col("wrong_ends") == 0) & (F.col("extra") <= limits.extra_pages) & enough & (F.col("rows") > 0) & (F.col("described") >= limits.described) & (F.col("lost") == 0)
    return out.select("doc", "ranges", "missed", "wrong_ends", "extra", "expected_rows", "rows", enough.alias("enough_rows"), "described", "lost", F.coalesce(good, F.lit(False)).alias("accepted"))
