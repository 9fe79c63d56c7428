"""Section labels: the text in the title-block zones that all pages of a run have and no page of another run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SectionDetection
from ..functions.text import strip, trivial


def zone_tokens(pages: DataFrame, cfg: SectionDetection) -> DataFrame:
    """Distinct (doc, page, token) of words whose box meets a zone, by the page's size; 2 to max_token_length characters.

    pages: (doc, page, width, height, words array<struct<x0, y0, x1, y1, word>>).
    """
    words = pages.select("doc", "page", "width", "height", F.inline("words"))
    inside = F.lit(False)
    for z in cfg.zones:
        across = (F.col("x0") < F.col("width") * z.x_max) & (F.col("x1") > F.col("width") * z.x_min)
        inside = inside | across & (F.col("y0") < F.col("height") * z.y_max) & (F.col("y1") > F.col("height") * z.y_min)
    tokens = words.where(inside).select("doc", "page", strip("word").alias("token"))
    return tokens.where((F.length("token") > 1) & (F.length("token") <= cfg.max_token_length)).distinct()


def labels(tokens: DataFrame, page_runs: DataFrame) -> DataFrame:
    """(doc, run_idx, label) of all runs. A token is a run's own if each of the run's pages has it and no page outside;
    the longest such token that isn't trivial is the label, of equally long ones the first in code-point order.

    tokens: distinct (doc, page, token). Documents with fewer than two runs have null labels.
    """
    pages = page_runs.select("doc", "run_idx", "page").distinct()
    runs = pages.groupBy("doc", "run_idx").agg(F.count("*").alias("pages"))
    several = runs.groupBy("doc").agg(F.count("*").alias("runs")).where("runs > 1").select("doc")
    seen = tokens.join(several, "doc", "left_semi").join(pages, ["doc", "page"])
    # In how many of the run's pages, and in how many of the document's pages (of any run) does the token stand?
    own = seen.groupBy("doc", "run_idx", "token").agg(F.count("*").alias("here"))
    every = seen.select("doc", "token", "page").distinct().groupBy("doc", "token").agg(F.count("*").alias("anywhere"))
    stable = own.join(runs, ["doc", "run_idx"]).where("here = pages").join(every, ["doc", "token"]).where("anywhere = here").where(~trivial("token"))
    best = stable.groupBy("doc", "run_idx").agg(F.min(F.struct((-F.length("token")).alias("shorter"), "token")).alias("best"))
    return runs.select("doc", "run_idx").join(best, ["doc", "run_idx"], "left").select("doc", "run_idx", F.col("best.token").alias("label"))


def page_labels(run_labels: DataFrame, page_runs: DataFrame) -> DataFrame:
    """(doc, page, source_section); a page of two runs has the later run's."""
    both = page_runs.join(run_labels, ["doc", "run_idx"])
    return both.groupBy("doc", "page").agg(F.max_by("label", "run_idx").alias("source_section"))
