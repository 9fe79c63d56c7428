"""Choosing the one data table of a page.

raw_tables(doc, page, parser, table_index, headers, rows array<array<string>>, n_cols, n_rows, bbox).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ColumnMapping, ExtractorConfig
from ..functions.matching import is_quantity

#: Parsers in order of preference.
PRIMARY, SECONDARY = "pymupdf", "pdfplumber"


def from_grid(grids: DataFrame, parser: Column | str) -> DataFrame:
    """raw_tables from grids: the first row as headers, null cells as empty ones; tables without rows vanish."""
    parser = F.lit(parser) if isinstance(parser, str) else parser
    text = F.transform("grid", lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))
    out = grids.where(F.size("grid") > 0).withColumn("cells", text)
    rows = F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1)))
    return out.select("doc", "page", parser.alias("parser"), "table_index", F.get("cells", 0).alias("headers"), rows.alias("rows"), F.size(F.get("cells", 0)).alias("n_cols"), F.size(rows).alias("n_rows"))


def has_quantity(headers: Column | str, cfg: ColumnMapping) -> Column:
    words, distance = cfg.synonyms.get("quantity") or [], cfg.fuzzy_max_distance
    return F.exists(F.coalesce(headers, F.array().cast("array<string>")), lambda h: is_quantity(h, words, distance))


def promote_headers(tables: DataFrame, cfg: ColumnMapping) -> DataFrame:
    """A first data row with a quantity header becomes the header where the header has none (a title stood there)."""
    first = F.get("rows", 0)
    up = ~has_quantity("headers", cfg) & first.isNotNull() & has_quantity(first, cfg)
    out = tables.withColumn("up", up)
    out = out.withColumn("headers", F.when(F.col("up"), first).otherwise(F.col("headers")))
    out = out.withColumn("rows", F.when(F.col("up"), F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))).otherwise(F.col("rows")))
    return out.withColumn("n_rows", F.when(F.col("up"), F.col("n_rows") - 1).otherwise(F.col("n_rows"))).withColumnRenamed("up", "promoted")


def qualifies(cfg: ExtractorConfig) -> Column:
    s = cfg.table_selection
    good = F.col("n_cols").between(s.min_columns, s.max_columns) & (F.col("n_rows") >= s.min_data_rows)
    return good & has_quantity("headers", cfg.column_mapping) if s.require_quantity_header else good


def select_tables(tables: DataFrame, cfg: ExtractorConfig) -> DataFrame:
    """One table for each page and parser: of those that qualify the one with fewest rows, then columns, then index."""
    good = tables.where(qualifies(cfg))
    rest = [c for c in good.columns if c not in ("doc", "page", "parser", "n_rows", "n_cols", "table_index")]
    best = good.groupBy("doc", "page", "parser").agg(F.min_by(F.struct("n_rows", "n_cols", "table_index", *rest), F.struct("n_rows", "n_cols", "table_index")).alias("t"))
    return best.select("doc", "page", "parser", "t.*")


def prefer(selected: DataFrame) -> DataFrame:
    """One table for each page: the primary parser's, else the secondary's."""
    rank = F.when(F.col("parser") == PRIMARY, 0).when(F.col("parser") == SECONDARY, 1).otherwise(2)
    rest = [c for c in selected.columns if c not in ("doc", "page")]
    return selected.groupBy("doc", "page").agg(F.min_by(F.struct(*rest), F.struct(rank, "parser")).alias("t")).select("doc", "page", "t.*")


def consensus(page_list: DataFrame, selected: DataFrame, tolerance: int) -> DataFrame:
    """(doc, page, primary_rows, secondary_rows, warning) of every page of the list; 0 rows where a parser has no table."""
    n = lambda p: F.coalesce(F.max(F.when(F.col("parser") == p, F.col("n_rows"))), F.lit(0))
    counts = selected.groupBy("doc", "page").agg(n(PRIMARY).alias("primary_rows"), n(SECONDARY).alias("secondary_rows"))
    out = page_list.select("doc", "page").distinct().join(counts, ["doc", "page"], "left").fillna(0, ["primary_rows", "secondary_rows"])
    diff = F.abs(F.col("primary_rows") - F.col("secondary_rows"))
    said = F.format_string(f"page %d: {PRIMARY}=%d {SECONDARY}=%d diff=%d tolerance={tolerance}", "page", "primary_rows", "secondary_rows", diff)
    return out.withColumn("warning", F.when(diff > tolerance, said))


def pages_without_table(page_list: DataFrame, chosen: DataFrame) -> DataFrame:
    return page_list.select("doc", "page").distinct().join(chosen.select("doc", "page"), ["doc", "page"], "left_anti")
