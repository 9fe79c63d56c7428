"""Rows of the chosen tables: empty and section rows, inherited tags, fields and what belongs to no field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CANONICAL_FIELDS, ExtractorConfig
from ..functions import text


def _strings() -> Column:
    return F.array().cast("array<string>")


def explode_rows(tables: DataFrame) -> DataFrame:
    """One row a table row: (..., mappings, row_pos, raw)."""
    keep = [c for c in ("doc", "page", "parser", "table_index", "run_idx", "pos", "source_section") if c in tables.columns]
    return tables.select(*keep, "mappings", F.posexplode("rows").alias("row_pos", "raw")).withColumn("raw", F.coalesce("raw", _strings()))


def mark_rows(rows: DataFrame, cfg: ExtractorConfig) -> DataFrame:
    """Drops empty rows, adds cells (stripped) and is_section_header: few filled cells and no number in a quantity column.

    Without a quantity column every row with few filled cells is a section header.
    """
    parsing = cfg.row_parsing
    if parsing.drop_empty_rows:
        rows = rows.where(F.exists("raw", lambda c: ~text.blank(c)))
    cells = F.transform("raw", lambda c: text.strip(F.coalesce(c, F.lit(""))) if cfg.post_processing.trim_whitespace else F.coalesce(c, F.lit("")))
    rows = rows.withColumn("cells", cells)
    filled = F.size(F.filter("cells", lambda c: ~text.blank(c)))
    quantities = F.filter("mappings", lambda m: m["canonical_field"] == "quantity")
    number = F.exists(quantities, lambda m: text.looks_numeric(F.get("cells", m["column_index"])))
    few = parsing.section_header_detection
    header = (filled > 0) & (filled <= few.max_filled_cells) & ~number if few.enabled else F.lit(False)
    return rows.withColumn("is_section_header", header)


def inherit_labels(rows: DataFrame) -> DataFrame:
    """Adds label, the first filled cell of the last section header before the row in its table."""
    keys = [c for c in ("doc", "run_idx", "pos", "page", "parser", "table_index") if c in rows.columns]
    over = Window.partitionBy(*keys).orderBy("row_pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("is_section_header"), F.get(F.filter("cells", lambda c: ~text.blank(c)), 0))
    return rows.withColumn("label", F.last(own, ignorenulls=True).over(over))


def field_value(field: str) -> Column:
    """All columns of a field in order, merged: an empty one gives way, an equal one adds nothing, another one a line."""
    mine = F.filter("mappings", lambda m: m["canonical_field"] == field)
    values = F.transform(mine, lambda m: F.coalesce(F.get("cells", m["column_index"]), F.lit("")))

    def merge(acc: Column, v: Column) -> Column:
        return F.when(acc.isNull() | (acc == ""), v).when((v == "") | (v == acc), acc).otherwise(F.concat(acc, F.lit("\n"), v))

    return F.aggregate(values, F.lit(None).cast("string"), merge)


def extra_fields() -> Column:
    """map of the columns without a field: by header, else by position; a name used before in the row gets its position too."""
    width = F.greatest(F.size("mappings"), F.size("cells"))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))

    def entry(i: Column) -> Column:
        m = F.get("mappings", i)
        plain = F.concat(F.lit("col_"), i.cast("string"))
        key = F.coalesce(F.nullif(m["normalized_header"], F.lit("")), F.nullif(text.strip(m["raw_header"]), F.lit("")), plain)
        return F.struct(m["canonical_field"].alias("field"), key.alias("key"), F.coalesce(F.get("cells", i), F.lit("")).alias("value"), plain.alias("plain"))

    free = F.filter(F.transform(places, entry), lambda e: e["field"].isNull())
    named = F.transform(free, lambda e, i: F.struct(F.when(F.exists(F.slice(free, 1, i), lambda x: x["key"] == e["key"]), F.concat(e["key"], F.lit("__"), e["plain"])).otherwise(e["key"]).alias("key"), e["value"].alias("value")))
    # Two headers may still make the same name; the later value holds.
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def merged_columns(tables: DataFrame) -> DataFrame:
    """(keys, canonical_field, columns) of fields that more than one column of a table goes into: a diagnostic."""
    keys = [c for c in ("doc", "page", "parser", "table_index") if c in tables.columns]
    flat = tables.select(*keys, F.inline("mappings")).where("canonical_field is not null")
    return flat.groupBy(*keys, "canonical_field").agg(F.count("*").alias("columns")).where("columns > 1")


def parse_rows(tables: DataFrame, cfg: ExtractorConfig) -> DataFrame:
    """Rows with fields, extra_fields and raw; section rows are still among them, marked, and inherited tags are filled in."""
    rows = inherit_labels(mark_rows(explode_rows(tables), cfg))
    out = rows.select("*", *[field_value(f).alias(f) for f in CANONICAL_FIELDS], extra_fields().alias("extra_fields"))
    inherit = text.blank("device_tag") & ~F.col("is_section_header") & F.col("label").isNotNull()
    out = out.withColumn("inherited_device_tag", F.when(inherit, F.col("label")))
    return out.withColumn("device_tag", F.coalesce("inherited_device_tag", "device_tag")).drop("mappings", "cells")


def number_rows(rows: DataFrame) -> DataFrame:
    """Data rows alone, with row_index: 0, 1, ... in each document by run, page in the run, and row."""
    order = [c for c in ("run_idx", "pos", "page", "table_index", "row_pos") if c in rows.columns]
    return rows.where(~F.col("is_section_header")).withColumn("row_index", F.row_number().over(Window.partitionBy("doc").orderBy(*order)) - 1)
