"""The uniform rows: clean-up, quantities, warnings; and their projections for import sheets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CANONICAL_FIELDS, PostProcessing, Validation
from ..functions import quantity, text

TEXT_FIELDS = [f for f in CANONICAL_FIELDS if f != "quantity"]
META = ["source_pdf", "source_page", "source_section", "row_index"]


def _java_pattern(pattern: str | None) -> tuple[str | None, str | None]:
    """The pattern if it compiles, else None and the reason."""
    try:
        re.compile(pattern or "")
    except re.error as e:
        return None, str(e)
    return pattern, None


def project(rows: DataFrame, cfg: PostProcessing) -> DataFrame:
    """Parsed rows as uniform rows: empty texts are null, blanks of odd kinds are plain, the quantity is typed, a blank
    schematic position is looked for in the description. Warnings: characters lost (by field), quantity, pattern.
    """
    first = [F.nullif(F.col(f), F.lit("")).alias(f) for f in TEXT_FIELDS]
    out = rows.select(
        F.col("doc").alias("source_pdf"), F.col("page").alias("source_page"), F.col("source_section") if "source_section" in rows.columns else F.lit(None).cast("string").alias("source_section"),
        "row_index", *first, F.col("quantity").alias("said"), "extra_fields", "raw",
    )
    lost = [F.when(F.col(f).contains("�"), F.lit(f"encoding_replacement_char_found:{f}")) for f in TEXT_FIELDS]
    out = out.withColumn("warnings", F.array(*lost))

    def tidy(c: Column) -> Column:
        c = text.clean_blanks(c)
        c = text.one_line(c) if cfg.normalize_newlines else c
        return text.strip(c) if cfg.trim_whitespace else c

    out = out.select(*[tidy(F.col(c)).alias(c) if c in TEXT_FIELDS else F.col(c) for c in out.columns])
    if cfg.trim_whitespace:
        out = out.withColumn("extra_fields", F.transform_values("extra_fields", lambda k, v: text.strip(v)))
    out = out.withColumn("quantity", quantity.parse("said"))
    pattern, wrong = _java_pattern(cfg.extract_schematic_position_regex)
    warnings = [F.col("warnings"), F.array(quantity.warning("said", F.col("quantity")))]
    if pattern or wrong:
        wanted = text.blank("schematic_position") & (F.coalesce("description", F.lit("")) != "")
        found = F.nullif(F.regexp_extract("description", f"(?U){pattern}", 0), F.lit("")) if pattern else F.lit(None).cast("string")
        if wrong:
            warnings.append(F.array(F.when(wanted, F.lit(f"schematic_regex_invalid:{wrong}"))))
        out = out.withColumn("schematic_position", F.when(wanted, F.coalesce(found, "schematic_position")).otherwise(F.col("schematic_position")))
    out = out.withColumn("warnings", F.array_distinct(F.array_compact(F.concat(*warnings))))
    return out.select(*META, *CANONICAL_FIELDS, "extra_fields", "raw", "warnings")


def require_fields(rows: DataFrame, cfg: Validation) -> DataFrame:
    """Adds a warning for every required field that is blank; the row stays."""
    missing = []
    for f in cfg.required_fields:
        empty = F.col("quantity.kind").isNull() if f == "quantity" else text.blank(f)
        missing.append(F.when(empty, F.lit(f"required_field_missing:{f}")))
    return rows.withColumn("warnings", F.array_distinct(F.array_compact(F.concat("warnings", F.array(*missing))))) if missing else rows


def remark(section: Column | str = "source_section", warnings: Column | str = "warnings") -> Column:
    """[section] and the warnings; null if there is neither."""
    section, warnings = (F.col(c) if isinstance(c, str) else c for c in (section, warnings))
    head = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("["), section, F.lit("]")))
    return F.nullif(F.concat_ws(" ", head, F.nullif(F.concat_ws("; ", warnings), F.lit(""))), F.lit(""))


def _filled(c: str) -> Column:
    return F.nullif(text.strip(c), F.lit(""))


def import_sheet(rows: DataFrame) -> DataFrame:
    """The ten columns of the import sheet, with the keys of the row. Whole quantities have no decimals."""
    q = F.col("quantity")
    whole = F.coalesce(q["i"], F.when(q["d"] == F.floor(q["d"]), q["d"].try_cast("decimal(38,0)")))
    said = F.coalesce(whole.cast("string"), q["d"].cast("string"), q["s"])
    none = F.lit(None).cast("string")
    return rows.select(
        "source_pdf", "row_index", said.alias("aantal"), F.lit("Stuks").alias("eenheid"), _filled("device_tag").alias("klantartikel"), _filled("description").alias("omschrijving"),
        _filled("manufacturer").alias("fabrikant"), F.coalesce(_filled("model_number"), _filled("order_number")).alias("type_bestelnummer"),
        none.alias("toegeleverd"), none.alias("odc_code"), remark().alias("opmerking"), none.alias("ean_code"),
    )


def order_sheet(sheet: DataFrame) -> DataFrame:
    """What the import workbook's formulas make of its sheet."""
    pos = F.row_number().over(Window.partitionBy("source_pdf").orderBy("row_index"))
    both = F.concat(F.coalesce("fabrikant", F.lit("")), F.coalesce("type_bestelnummer", F.lit("")))
    return sheet.select(
        "source_pdf", pos.alias("pos"), F.col("aantal").alias("menge"), F.col("eenheid").alias("me"), F.left("omschrijving", F.lit(120)).alias("kunden_bezeichnung"),
        F.when(F.coalesce("klantartikel", F.lit("")) != "", F.col("klantartikel")).otherwise(both).alias("kunden_artikel"), F.col("type_bestelnummer").alias("bstnr"),
        F.col("fabrikant").alias("lieferant"), F.lit("zie bstnr").alias("typ"), F.col("fabrikant").alias("hersteller"), F.col("odc_code").alias("bmk"), F.col("opmerking").alias("bemerkung"),
        F.lit("not used").alias("seite_pfad"), F.when(F.coalesce("toegeleverd", F.lit("")) == "", 0).otherwise(1).alias("beistellung"), F.lit("not used").alias("einbau_ort"),
        F.col("ean_code").alias("eannr"), F.coalesce(F.length("type_bestelnummer"), F.lit(0)).alias("lengte"),
    )


def search(rows: DataFrame, pdf: str | None = None, sections: list[str] | None = None, text_search: str | None = None, literal: bool = False) -> DataFrame:
    """Rows of one document, of some sections, whose description has the text: a pattern without regard to case, or literal.

    A row without a description never matches a text.
    """
    if pdf is not None:
        rows = rows.where(F.col("source_pdf") == pdf)
    if sections:
        rows = rows.where(F.col("source_section").isin(sections))
    if text_search:
        hit = F.contains(F.lower("description"), F.lit(text_search.lower())) if literal else F.col("description").rlike(f"(?iuU){text_search}")
        rows = rows.where(hit)
    return rows


def union(frames: dict[str, DataFrame]) -> DataFrame | None:
    """Rows of several results on top of one another, with the name first."""
    out = None
    for name, df in frames.items():
        one = df.select(F.lit(name).alias("pdf"), "*")
        out = one if out is None else out.unionByName(one)
    return out
