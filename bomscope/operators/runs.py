"""Runs of parts-list pages: islands of neighbouring pages, split where the headers change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ClassifierConfig
from ..functions.text import fingerprint, jaccard


def islands(scores: DataFrame, weak: float, max_gap: int) -> DataFrame:
    """Pages that qualify, with the number of their island: a new one after a gap of more than max_gap pages."""
    by_page = Window.partitionBy("doc").orderBy("page")
    far = F.col("page") - F.lag("page").over(by_page) - 1 > max_gap
    good = scores.where(F.col("total_score") >= weak)
    return good.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("island", F.sum("far").over(by_page)).drop("far")


def split(items: Column, similarity: float) -> Column:
    """Run number within an island for each of its pages in order: a page whose headers are too unlike all headers of
    the run so far starts the next run; a page or run without headers is never unlike.

    items: array of structs with prints, in page order. The fold's state resets at a split, so no window frame fits; it
    runs over one document's island.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<int>").alias("runs"), F.lit(0).alias("run"), none.alias("known"))

    def step(acc: Column, x: Column) -> Column:
        unlike = (F.size(acc["runs"]) > 0) & (F.size(acc["known"]) > 0) & (F.size(x["prints"]) > 0) & (jaccard(acc["known"], x["prints"]) < similarity)
        run = F.when(unlike, acc["run"] + 1).otherwise(acc["run"])
        known = F.when(unlike, x["prints"]).otherwise(F.array_union(acc["known"], x["prints"]))
        return F.struct(F.concat(acc["runs"], F.array(run)).alias("runs"), run.alias("run"), known.alias("known"))

    return F.aggregate(items, start, step, lambda acc: acc["runs"])


def assign_runs(scores: DataFrame, cfg: ClassifierConfig) -> DataFrame:
    """(doc, island, part, page, total_score, rows, prints) of qualifying pages."""
    pages = islands(scores, cfg.scoring.weak_match, cfg.clustering.max_gap)
    item = F.struct("page", fingerprint("best_table_headers").alias("prints"), "total_score", "rows")
    whole = pages.groupBy("doc", "island").agg(F.array_sort(F.collect_list(item)).alias("items"))  # neighbouring pages of one document
    numbered = whole.withColumn("parts", split(F.col("items"), cfg.clustering.min_fingerprint_similarity))
    flat = numbered.select("doc", "island", F.inline(F.arrays_zip("items", "parts")))
    return flat.select("doc", "island", F.col("parts").alias("part"), "items.page", "items.total_score", "items.rows", "items.prints")


def summarise(members: DataFrame, cfg: ClassifierConfig) -> DataFrame:
    """Runs with a strong page and enough rows, numbered from 0 in page order."""
    strong, weak = cfg.scoring.strong_match, cfg.scoring.weak_match
    runs = members.groupBy("doc", "island", "part").agg(
        F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.array_sort(F.collect_list("page")).alias("pages"), F.avg("total_score").alias("mean_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("prints")))).alias("column_fingerprint"), F.sum("rows").alias("total_rows"),
        F.struct(F.count_if(F.col("total_score") >= strong).alias("strong_pages"), F.count_if((F.col("total_score") >= weak) & (F.col("total_score") < strong)).alias("weak_pages")).alias("signals_summary"),
    )
    runs = runs.where((F.col("signals_summary.strong_pages") > 0) & (F.col("total_rows") >= cfg.clustering.min_total_rows_per_run))
    runs = runs.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean_score") / 20)))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("start_page")) - 1
    return runs.select("doc", number.alias("run_idx"), "start_page", "end_page", "pages", "mean_score", "column_fingerprint", "total_rows", "confidence", "signals_summary")


def cluster(scores: DataFrame, cfg: ClassifierConfig) -> DataFrame:
    return summarise(assign_runs(scores, cfg), cfg)


def page_runs(runs: DataFrame) -> DataFrame:
    """(doc, run_idx, pos, page) of runs with a pages array; empty ones vanish."""
    return runs.select("doc", "run_idx", F.posexplode("pages").alias("pos", "page"))


def top_pages(scores: DataFrame, n: int = 10) -> DataFrame:
    """The n best pages of every document, lower numbers first among equals."""
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("total_score"), "page"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)
