"""Headers of a table to the uniform fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ColumnMapping
from ..functions import text
from ..functions.matching import column_match, let


def mappings(headers: Column | str, cfg: ColumnMapping) -> Column:
    """array<struct(column_index, raw_header, normalized_header, canonical_field, match_method, match_distance, matched_synonym)>"""
    headers = F.coalesce(headers, F.array().cast("array<string>"))

    def one(h: Column, i: Column) -> Column:
        said = lambda m: F.struct(
            i.alias("column_index"), F.coalesce(h, F.lit("")).alias("raw_header"), text.header_b(h).alias("normalized_header"), m["category"].alias("canonical_field"), m["method"].alias("match_method"), m["distance"].alias("match_distance"), m["synonym"].alias("matched_synonym"),
        )
        return let(column_match(h, cfg.synonyms, cfg.fuzzy_max_distance), said)

    return F.transform(headers, one)


def tag_fallback(maps: Column | str) -> Column:
    """The first column is the device tag, by position, if no column is and it has no field of its own."""
    maps = F.col(maps) if isinstance(maps, str) else maps
    tagged = F.exists(maps, lambda m: F.coalesce(m["canonical_field"] == "device_tag", F.lit(False)))

    def one(m: Column, i: Column) -> Column:
        use = ~tagged & (i == 0) & m["canonical_field"].isNull()
        return m.withField("canonical_field", F.when(use, "device_tag").otherwise(m["canonical_field"])).withField("match_method", F.when(use, "positional").otherwise(m["match_method"]))

    return F.transform(maps, one)


def map_columns(tables: DataFrame, cfg: ColumnMapping, fallback: bool = True) -> DataFrame:
    """Adds mappings, with the positional device tag unless it is turned off."""
    out = tables.withColumn("mappings", mappings("headers", cfg))
    return out.withColumn("mappings", tag_fallback("mappings")) if fallback else out


def mapping_rows(tables: DataFrame) -> DataFrame:
    """One row a column of a table with mappings."""
    keys = [c for c in ("doc", "page", "parser", "table_index") if c in tables.columns]
    return tables.select(*keys, F.inline("mappings"))
