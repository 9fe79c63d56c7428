"""classify: which pages hold parts lists. extract: what rows they hold. One plan for all documents."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClassifierConfig, ExtractorConfig
from ..operators import audit as audits
from ..operators import canonical, columns, rows, runs, sections, signals, tables


@dataclass
class Classified:
    runs: DataFrame
    scores: DataFrame


@dataclass
class Extracted:
    rows: DataFrame
    audit: DataFrame
    mappings: DataFrame
    sections: DataFrame


def classify(pages: DataFrame, grids: DataFrame, cfg: ClassifierConfig | None = None, extra: Mapping[str, signals.Signal] | None = None, passes: Mapping[str, signals.PostPass] | None = None) -> Classified:
    """pages(doc, page, text, n_lines, n_curves, n_rects), grids(doc, page, table_index, grid).

    extra and passes: signals of one page and of all pages beyond the built-in ones, by name (operators.signals).
    """
    cfg = cfg or ClassifierConfig()
    first = signals.page_scores(pages, grids, cfg, extra)
    bonus = {n: (lambda s, f=f: f(first)) for n, f in (passes or {}).items()}  # as they were before any bonus
    scores = signals.post_passes(signals.continuity(first, cfg.signals.continuity), bonus)
    return Classified(runs.cluster(scores, cfg), scores)


def extract(documents: DataFrame, raw_tables: DataFrame, page_runs: DataFrame, words: DataFrame | None = None, cfg: ExtractorConfig | None = None) -> Extracted:
    """documents(doc), raw_tables, page_runs(doc, run_idx, pos, page); words: pages with boxes, for section labels.

    A page that stands in two runs gives its rows in both.
    """
    cfg = cfg or ExtractorConfig()
    wanted = raw_tables.join(page_runs.select("doc", "page").distinct(), ["doc", "page"], "left_semi")
    selected = tables.select_tables(tables.promote_headers(wanted, cfg.column_mapping), cfg)
    chosen = columns.map_columns(tables.prefer(selected), cfg.column_mapping)
    if words is not None and cfg.section_detection.enabled:
        found = words.join(page_runs.select("doc", "page").distinct(), ["doc", "page"], "left_semi")
        labelled = sections.page_labels(sections.labels(sections.zone_tokens(found, cfg.section_detection), page_runs), page_runs)
    else:
        labelled = page_runs.select("doc", "page").distinct().withColumn("source_section", F.lit(None).cast("string"))
    placed = page_runs.join(chosen, ["doc", "page"]).join(labelled, ["doc", "page"], "left")
    parsed = rows.number_rows(rows.parse_rows(placed, cfg))
    out = canonical.require_fields(canonical.project(parsed, cfg.post_processing), cfg.validation)
    agreement = tables.consensus(page_runs, selected, cfg.validation.cross_parser_row_count_tolerance)
    audit = audits.audit(documents, out, agreement, tables.pages_without_table(page_runs, chosen), page_runs, cfg.validation)
    return Extracted(out, audit, columns.mapping_rows(chosen), labelled)


def run(documents: DataFrame, pages: DataFrame, grids: DataFrame, raw_tables: DataFrame, classifier: ClassifierConfig | None = None, extractor: ExtractorConfig | None = None) -> tuple[Classified, Extracted]:
    """Both halves, one after the other, over the same pages."""
    found = classify(pages, grids, classifier)
    words = pages if {"words", "width", "height"} <= set(pages.columns) else None
    return found, extract(documents, raw_tables, runs.page_runs(found.runs), words, extractor)
