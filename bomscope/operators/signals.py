"""Page signals and the page score.

grids(doc, page, table_index, grid array<array<string>>): raw tables, the first row presumed the header.
pages(doc, page, text, n_lines, n_curves, n_rects, ...).
Every signal is a struct column with a score; a signal that is switched off scores 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ClassifierConfig, ColumnHeader, Continuity, RowCount, Title, VectorDensity
from ..functions import text
from ..functions.matching import let, page_category


def _java(pattern: str) -> str:
    return f"(?iuU){pattern}"


def valid_patterns(patterns: list[str]) -> list[str]:
    """Patterns that compile; others are passed over."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def title(page_text: Column | str, cfg: Title) -> Column:
    """struct(score, found, patterns, count, snippet): the weight once if any title pattern is found, patterns in the settings' order."""
    patterns = valid_patterns(cfg.patterns) if cfg.enabled else []
    clean = text.page_text(page_text)
    hits = F.array_compact(F.array(*[F.when(clean.rlike(_java(p)), F.lit(p)) for p in patterns])) if patterns else F.array().cast("array<string>")
    snippet = F.lit("")
    for p in reversed(patterns):
        snippet = F.when(clean.rlike(_java(p)), text.squeeze(F.regexp_extract(clean, rf"(?isuU).{{0,30}}?(?:{p}).{{0,30}}", 0))).otherwise(snippet)
    n = F.size(hits)
    return F.struct(F.when(n > 0, F.lit(cfg.weight)).otherwise(0.0).alias("score"), (n > 0).alias("found"), hits.alias("patterns"), n.alias("count"), snippet.alias("snippet"))


def vector_density(lines: Column, curves: Column, rects: Column, cfg: VectorDensity) -> Column:
    """struct(score, primitives): a bonus for quiet pages, a penalty for drawings; missing counts are 0."""
    zero = F.lit(0)
    n = F.coalesce(lines, zero) + F.coalesce(curves, zero) + F.coalesce(rects, zero)
    score = F.when(n <= cfg.quiet_threshold, cfg.weight).when(n >= cfg.noisy_threshold, cfg.noisy_penalty).otherwise(0.0) if cfg.enabled else F.lit(0.0)
    return F.struct(score.alias("score"), n.cast("long").alias("primitives"))


def header_row(row: Column, cfg: ColumnHeader) -> Column:
    """struct(count, categories, headers) of one candidate row: distinct categories, and every header that has one."""
    cells = F.transform(F.coalesce(row, F.array().cast("array<string>")), lambda c: F.struct(page_category(c, cfg.synonyms, cfg.fuzzy_max_distance).alias("category"), c.alias("cell")))

    def counted(known: Column) -> Column:
        categories = F.array_sort(F.array_distinct(F.transform(known, lambda x: x["category"])))
        return let(categories, lambda c: F.struct(F.size(c).alias("count"), c.alias("categories"), F.transform(known, lambda x: x["cell"]).alias("headers")))

    return let(F.filter(cells, lambda x: x["category"].isNotNull()), counted)


def best_header_row(grid: Column | str, cfg: ColumnHeader) -> Column:
    """struct(count, row, categories, headers) of the better of the first two rows, the first one if they are equal."""
    grid = F.col(grid) if isinstance(grid, str) else grid
    ranked = F.transform(F.slice(grid, 1, 2), lambda r, i: let(header_row(r, cfg), lambda h: F.struct(h["count"].alias("count"), (-i).alias("up"), h["categories"].alias("categories"), h["headers"].alias("headers"))))
    return let(F.array_max(ranked), lambda best: F.struct(best["count"].alias("count"), (-best["up"]).alias("row"), best["categories"].alias("categories"), best["headers"].alias("headers")))


def data_rows(grid: Column | str) -> Column:
    """Rows after the first with two filled cells or more."""
    grid = F.col(grid) if isinstance(grid, str) else grid
    filled = lambda r: F.size(F.filter(F.coalesce(r, F.array().cast("array<string>")), lambda c: ~text.blank(c))) >= 2
    return F.when(F.size(grid) < 2, 0).otherwise(F.size(F.filter(F.slice(grid, 2, F.greatest(F.size(grid), F.lit(1))), filled)))


def width(grid: Column | str) -> Column:
    grid = F.col(grid) if isinstance(grid, str) else grid
    return F.coalesce(F.array_max(F.transform(grid, lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0))


def table_signals(grids: DataFrame, headers: ColumnHeader, counts: RowCount) -> DataFrame:
    """(doc, page, column_header, row_count) from one pass over a page's tables.

    column_header: the table with most header categories, the first of equals; null on a page of empty tables alone.
    row_count: the list-like table (3 columns, 2 data rows) with most data rows, the first of equals.
    """
    dims = F.struct(F.size("grid").alias("rows"), width("grid").alias("columns"))
    some = F.size("grid") > 0
    known = grids.select("doc", "page", "table_index", F.when(some, best_header_row("grid", headers)).alias("h"), F.when(some, dims).alias("dims"), data_rows("grid").alias("n"), width("grid").alias("w"))
    up = (-F.col("table_index")).alias("up")
    like = (F.col("w") >= 3) & (F.col("n") >= 2)
    per = F.transform(F.array_sort(F.collect_list(F.struct("table_index", "n"))), lambda x: x["n"])  # the tables of one page
    page = known.groupBy("doc", "page").agg(
        F.max(F.when(F.col("h").isNotNull(), F.struct("h.count", up, "h.row", "h.categories", "h.headers", F.col("dims").alias("dimensions")))).alias("h"), F.count_if(F.col("h").isNotNull()).alias("tables"),
        F.max(F.when(like, F.struct("n", up))).alias("r"), F.count_if(like).alias("candidates"), per.alias("per_table"),
    )
    return page.select("doc", "page", _header_signal(headers).alias("column_header"), _count_signal(counts).alias("row_count"))


def _header_signal(cfg: ColumnHeader) -> Column:
    n = F.col("h.count")
    kind = F.when(n >= cfg.strong_threshold, "strong").when(n >= cfg.weak_threshold, "weak").otherwise("none")
    score = F.when(n >= cfg.strong_threshold, cfg.strong_weight).when(n >= cfg.weak_threshold, cfg.weak_weight).otherwise(0.0)
    if not cfg.enabled:
        kind, score = F.lit("none"), F.lit(0.0)
    some = (n > 0) & F.lit(cfg.enabled)
    none = F.array().cast("array<string>")
    signal = F.struct(
        score.alias("score"), F.when(some, n).otherwise(0).alias("categories_found"), kind.alias("qualification"),
        F.when(some, F.col("h.categories")).otherwise(none).alias("categories"), F.when(some, F.col("h.headers")).otherwise(none).alias("headers"),
        F.when(some, -F.col("h.up")).alias("table_index"), F.when(some, F.col("h.row")).alias("header_row"), F.when(some, F.col("h.dimensions")).alias("dimensions"), F.col("tables").alias("tables_scanned"),
    )
    return F.when(F.col("tables") > 0, signal)


def _count_signal(cfg: RowCount) -> Column:
    n = F.coalesce(F.col("r.n"), F.lit(0))
    kind = F.when(n >= cfg.strong_threshold, "strong").when(n >= cfg.weak_threshold, "weak").when((n >= 1) & (n < cfg.negative_threshold), "negative").otherwise("none")
    if not cfg.enabled:
        kind, n = F.lit("none"), F.lit(0)
    score = F.when(kind == "strong", cfg.strong_weight).when(kind == "weak", cfg.weak_weight).when(kind == "negative", cfg.negative_weight).otherwise(0.0)
    return F.struct(score.alias("score"), n.alias("rows"), kind.alias("qualification"), (-F.col("r.up")).alias("table_index"), F.col("candidates"), F.col("per_table"))


def column_header(grids: DataFrame, cfg: ColumnHeader) -> DataFrame:
    """(doc, page, column_header) of pages with a table that isn't empty."""
    return table_signals(grids, cfg, RowCount()).select("doc", "page", "column_header").where("column_header is not null")


def row_count(grids: DataFrame, cfg: RowCount) -> DataFrame:
    """(doc, page, row_count)"""
    return table_signals(grids, ColumnHeader(), cfg).select("doc", "page", "row_count")


#: A signal of one page: from the pages (with all columns there are so far) to a score, or a struct with score and error.
Signal = Callable[[DataFrame], Column]
#: A signal of all pages: from the scores as they were before any such signal to (doc, page, score).
PostPass = Callable[[DataFrame], DataFrame]
_RESULT = "struct<score:double,error:string>"


def per_page(fn: Callable[[dict], float], *columns: str) -> Signal:
    """A signal from a plain function of one page's columns, in batches; a page on which it fails scores 0 and says why."""

    def signal(pages: DataFrame) -> Column:
        @F.pandas_udf(_RESULT)
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in rows.to_dict("records"):
                try:
                    out.append((float(fn(row)), None))
                except Exception as e:  # noqa: BLE001 - one page or signal mustn't lose the others
                    out.append((0.0, f"{type(e).__name__}: {e}"))
            return pd.DataFrame(out, columns=["score", "error"])

        return run(F.struct(*[pages[c] for c in columns]))

    return signal


def _isolated(pages: DataFrame, name: str, signal: Signal) -> DataFrame:
    """pages with the signal as a struct of score and error; one that can't even be planned scores 0 on every page."""
    try:
        own = signal(pages)
        kind = pages.select(own.alias("x")).schema["x"].dataType  # an unknown column shows here
        if kind.typeName() != "struct":
            own = F.struct(own.cast("double").alias("score"), F.lit(None).cast("string").alias("error"))
        out = pages.withColumn(name, own)
    except Exception as e:  # noqa: BLE001
        return pages.withColumn(name, F.struct(F.lit(0.0).alias("score"), F.lit(f"{type(e).__name__}: {e}".split("\n")[0]).alias("error")))
    return out.withColumn(name, F.struct(F.coalesce(F.col(name)["score"], F.lit(0.0)).alias("score"), F.col(name)["error"].alias("error")))


def page_scores(pages: DataFrame, grids: DataFrame, cfg: ClassifierConfig, extra: Mapping[str, Signal] | None = None) -> DataFrame:
    """One row a page: the signals, total_score, best_table_index, best_table_headers and rows. Pages without tables stay.

    extra: more signals by name, in order; each becomes a column of (score, error) and counts in the total.
    """
    s = cfg.signals
    out = pages.join(table_signals(grids, s.column_header, s.row_count), ["doc", "page"], "left")
    out = out.withColumn("title", title("text", s.title)).withColumn("vector_density", vector_density(F.col("n_lines"), F.col("n_curves"), F.col("n_rects"), s.vector_density))
    for name, signal in (extra or {}).items():
        out = _isolated(out, name, signal)
    parts = [F.col(f"{n}.score") for n in ("title", "column_header", "row_count", "vector_density", *(extra or ()))]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    headers = F.filter(F.coalesce("column_header.headers", F.array().cast("array<string>")), lambda h: ~text.blank(h))
    return out.select(
        "doc", "page", "title", "column_header", "row_count", "vector_density", *(extra or ()), total.alias("total_score"),
        F.col("column_header.table_index").alias("best_table_index"), headers.alias("best_table_headers"), F.coalesce("row_count.rows", F.lit(0)).alias("rows"),
    )


def post_passes(scores: DataFrame, passes: Mapping[str, PostPass] | None) -> DataFrame:
    """scores with one column (score, error) for each pass, its score added to total_score; each pass sees the scores as given.

    A pass that can't be planned scores 0 and says why.
    """
    out, named = scores, []
    for name, fn in (passes or {}).items():
        try:
            own = fn(scores).groupBy("doc", "page").agg(F.sum(F.col("score").cast("double")).alias(f"_{name}"))
            out = out.join(own, ["doc", "page"], "left")
            column = F.struct(F.coalesce(F.col(f"_{name}"), F.lit(0.0)).alias("score"), F.lit(None).cast("string").alias("error"))
            out = out.withColumn(name, column).drop(f"_{name}")
        except Exception as e:  # noqa: BLE001
            out = out.withColumn(name, F.struct(F.lit(0.0).alias("score"), F.lit(f"{type(e).__name__}: {e}".split("\n")[0]).alias("error")))
        named.append(name)
    return out.withColumn("total_score", sum((F.col(f"{n}.score") for n in named), F.col("total_score"))) if named else out


def continuity(scores: DataFrame, cfg: Continuity) -> DataFrame:
    """Adds continuity and puts it on total_score: once, if the page before or after (by number) had base_threshold or more.

    Both neighbours are read as they were before any bonus.
    """
    by_page = Window.partitionBy("doc").orderBy("page")
    near = F.greatest(F.max("total_score").over(by_page.rangeBetween(-1, -1)), F.max("total_score").over(by_page.rangeBetween(1, 1)))
    bonus = F.when(near >= cfg.base_threshold, cfg.weight).otherwise(0.0) if cfg.enabled else F.lit(0.0)
    out = scores.withColumn("continuity", F.struct(bonus.alias("score"), near.alias("best_neighbour")))
    return out.withColumn("total_score", F.col("total_score") + F.col("continuity.score"))
