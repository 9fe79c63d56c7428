"""Expected page ranges of documents that somebody has looked through, from a YAML file or its contents.

Layout: fixtures, a list of documents, each with pdf, total_pages and expected, a list of pages [first, last], title and
approx_row_count.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

EXPECTED = "doc string, start_page int, end_page int, title string, approx_rows int"


def expected_runs(spark: SparkSession, source: str | Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(documents(doc, total_pages), expected ranges). A path is read through Spark, so any store will do; ValueError names
    a document without a name or a range that isn't two pages in order."""
    if isinstance(source, str):
        import yaml

        source = yaml.safe_load("\n".join(r[0] for r in spark.read.text(source, wholetext=True).collect()))  # one small file
    documents, ranges = [], []
    for f in (source or {}).get("fixtures") or []:
        name = f.get("pdf")
        if not name:
            raise ValueError(f"a document without a name: {f}")
        documents.append((name, f.get("total_pages")))
        for e in f.get("expected") or []:
            pages = e.get("pages")
            if not isinstance(pages, list) or len(pages) != 2 or not 0 < pages[0] <= pages[1]:
                raise ValueError(f"{name}: pages {pages} are not a range")
            ranges.append((name, *pages, e.get("title"), e.get("approx_row_count")))
    return spark.createDataFrame(documents, "doc string, total_pages int"), spark.createDataFrame(ranges, EXPECTED)
