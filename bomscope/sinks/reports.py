"""What classify found, for people and for programs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.runs import top_pages

SIGNALS = ["title", "column_header", "row_count", "vector_density", "continuity"]


def run_rows(runs: DataFrame) -> DataFrame:
    """Runs as shown: means to two places, confidence to three."""
    return runs.withColumn("mean_score", F.round("mean_score", 2)).withColumn("confidence", F.round("confidence", 3))


def page_rows(scores: DataFrame) -> DataFrame:
    return scores.select("doc", F.col("page").alias("page_number"), F.round("total_score", 2).alias("total_score"), F.col("rows").alias("row_count"), F.struct(*[F.round(f"{s}.score", 2).alias(s) for s in SIGNALS]).alias("signals"))


def run_list(runs: Column | str) -> Column:
    """Several runs of pages, an array of arrays in order, as 3-4, 7; empty ones are left out, a dash if nothing is left."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    said = F.transform(F.filter(F.coalesce(runs, F.array().cast("array<array<int>>")), lambda r: F.size(r) > 0), lambda r: F.when(F.size(r) == 1, F.get(r, 0).cast("string")).otherwise(F.concat_ws("-", F.get(r, 0).cast("string"), F.element_at(r, -1).cast("string"))))
    return F.when(F.size(said) == 0, "—").otherwise(F.array_join(said, ", "))


def page_span(pages: str = "pages") -> Column:
    """A run of pages as 3-4, or 7."""
    first, last = F.array_min(pages), F.array_max(pages)
    return F.when(F.size(pages) == 0, "—").when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def as_json(doc: str, runs: DataFrame, scores: DataFrame) -> str:
    """One document's report."""
    own = [json.loads(r[0]) for r in run_rows(runs.where(F.col("doc") == doc)).orderBy("run_idx").select(F.to_json(F.struct("start_page", "end_page", "pages", "mean_score", "column_fingerprint", "total_rows", "confidence", "signals_summary"), {"ignoreNullFields": "false"})).toLocalIterator()]
    pages = [json.loads(r[0]) for r in page_rows(scores.where(F.col("doc") == doc)).orderBy("page_number").select(F.to_json(F.struct("page_number", "total_score", "row_count", "signals"), {"ignoreNullFields": "false"})).toLocalIterator()]
    return json.dumps({"pdf": doc, "runs": own, "page_scores": pages}, indent=2, ensure_ascii=False)


def as_text(doc: str, runs: DataFrame, scores: DataFrame) -> str:
    """One document's runs, with up to six headers, and its ten best pages with their signals."""
    own = runs.where(F.col("doc") == doc).orderBy("run_idx").collect()  # runs and pages of one document
    mine = scores.where(F.col("doc") == doc)
    out = [f"{doc}: {len(own)} parts lists in {mine.count()} pages", ""]
    for r in own:
        heads = " | ".join(r["column_fingerprint"][:6]) + (" | and more" if len(r["column_fingerprint"]) > 6 else "")
        out.append(f"  from page {r['start_page']} to {r['end_page']}, {r['total_rows']} rows, confidence {r['confidence']:.2f}, average score {r['mean_score']:.1f}; headers: {heads}")
    if not own:
        out.append("  nothing that looks like a parts list")
    out += ["", f"{'page':>5} {'total':>7} {'rows':>5}  " + "  ".join(f"{s[:10]:>10}" for s in SIGNALS)]
    for p in top_pages(mine).orderBy("rank").collect():
        out.append(f"{p['page']:>5} {p['total_score']:>7.2f} {p['rows']:>5}  " + "  ".join(f"{p[s]['score']:>10.2f}" if p[s] else f"{'-':>10}" for s in SIGNALS))
    return "\n".join(out)
