"""What was found and what is wrong with it, a row a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CANONICAL_FIELDS, Validation
from ..functions.text import blank


def _has(field: str):
    return F.col("quantity.kind").isNotNull() if field == "quantity" else ~blank(field)


def summary(rows: DataFrame, cfg: Validation) -> DataFrame:
    """(source_pdf, total_rows, rows_with_warnings, encoding_warnings_total, fields_never_populated)"""
    lost = F.size(F.filter("warnings", lambda w: w.startswith("encoding_replacement_char_found")))
    seen = [F.max(_has(f)).alias(f"has_{f}") for f in CANONICAL_FIELDS]
    total = F.sum(lost).cast("int") if cfg.flag_unicode_replacement else F.lit(0)
    out = rows.groupBy("source_pdf").agg(F.count("*").cast("int").alias("total_rows"), F.count_if(F.size("warnings") > 0).cast("int").alias("rows_with_warnings"), total.alias("encoding_warnings_total"), *seen)
    never = F.array_compact(F.array(*[F.when(~F.col(f"has_{f}"), F.lit(f)) for f in CANONICAL_FIELDS]))
    return out.select("source_pdf", "total_rows", "rows_with_warnings", "encoding_warnings_total", never.alias("fields_never_populated"))


def audit(documents: DataFrame, rows: DataFrame, consensus: DataFrame, tableless: DataFrame, page_list: DataFrame, cfg: Validation) -> DataFrame:
    """The audit of every document of the list (doc); one without pages says so."""
    pages = page_list.groupBy("doc").agg(F.count("*").alias("pages"))
    notes = consensus.where("warning is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "warning"))).alias("issues"))  # pages of one document
    lacking = tableless.groupBy("doc").agg(F.array_sort(F.collect_list("page")).alias("pages_without_table"))
    out = documents.select("doc").distinct().join(pages, "doc", "left").join(summary(rows, cfg).withColumnRenamed("source_pdf", "doc"), "doc", "left")
    out = out.join(notes, "doc", "left").join(lacking, "doc", "left")
    zero = F.lit(0)
    ints, names = F.array().cast("array<int>"), F.array().cast("array<string>")
    every = F.array(*map(F.lit, CANONICAL_FIELDS))
    return out.select(
        F.col("doc").alias("source_pdf"), F.coalesce("total_rows", zero).alias("total_rows"), F.when(F.col("pages").isNull(), "no_page_runs_provided").alias("note"),
        F.coalesce("rows_with_warnings", zero).alias("rows_with_warnings"), F.coalesce("encoding_warnings_total", zero).alias("encoding_warnings_total"),
        F.coalesce(F.transform("issues", lambda x: x["warning"]), names).alias("consensus_warnings"), F.coalesce(F.transform("issues", lambda x: x["page"].cast("int")), ints).alias("pages_with_consensus_issues"),
        F.coalesce(F.transform("pages_without_table", lambda p: p.cast("int")), ints).alias("pages_without_table"), F.coalesce("fields_never_populated", every).alias("fields_never_populated"),
    )


def metrics(rows: DataFrame) -> DataFrame:
    """One row: rows, distinct pages, number of distinct sections, rows with warnings. The sections themselves: sections()."""
    section = F.nullif(F.col("source_section"), F.lit(""))
    return rows.agg(F.count("*").alias("total_rows"), F.count_distinct("source_pdf", "source_page").alias("pages"), F.count_distinct(section).alias("n_sections"), F.count_if(F.size("warnings") > 0).alias("rows_with_warnings"))


def sections(rows: DataFrame) -> DataFrame:
    """(source_section) of all rows, each once, however many there are; order it for display."""
    return rows.select("source_section").where("source_section <> ''").distinct()


def fill_rates(rows: DataFrame) -> DataFrame:
    """(source_pdf, field, filled): the share of rows in which the field is not blank."""
    shares = rows.groupBy("source_pdf").agg(*[F.avg(_has(f).cast("int")).alias(f) for f in CANONICAL_FIELDS])
    return shares.unpivot("source_pdf", CANONICAL_FIELDS, "field", "filled")
