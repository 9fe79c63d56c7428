"""The engine for one file or many: what the command line calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ClassifierConfig, ExtractorConfig
from .operators import runs
from .operators.tables import PRIMARY, SECONDARY, from_grid
from .plans.lifecycle import Classified, Extracted, classify, extract
from .sinks import files
from .sources import pdf, ranges


class Reader:
    """Documents under a path, parsed once and kept; errors has the files that could not be read.

    reader: what parses one file (sources.pdf). signal_parser: the one parser whose tables page signals read.
    """

    def __init__(self, spark: SparkSession, path: str, reader=None, signal_parser: str | None = None) -> None:
        self.spark = spark
        reader = reader or default_reader()
        self.signal_parser = signal_parser or (SECONDARY if reader is pdf.read_libraries else PRIMARY)
        self.documents, self.pages, self.grids, self.errors = pdf.read_documents(spark, path, reader)

    def page_grids(self) -> DataFrame:
        """The grids that page signals read: those of one parser, on every page."""
        return self.grids.where(F.col("parser") == self.signal_parser).drop("parser")

    def classify(self, cfg: ClassifierConfig | None = None, **more) -> Classified:
        """more: extra and passes of plans.lifecycle.classify."""
        return classify(self.pages, self.page_grids(), cfg, **more)

    def extract(self, page_runs: DataFrame, cfg: ExtractorConfig | None = None) -> Extracted:
        return extract(self.documents, from_grid(self.grids, self.grids["parser"]), page_runs, self.pages, cfg)

    def manual_runs(self, spec: str) -> DataFrame:
        """The given page ranges for every document."""
        ranges.parse(spec)  # a wrong one is an error here, not on an executor
        return ranges.page_runs(self.documents.select("doc", F.lit(spec).alias("spec")))

    def found_runs(self, cfg: ClassifierConfig | None = None) -> DataFrame:
        return runs.page_runs(self.classify(cfg).runs)


def as_bytes(found: Extracted, document: str, fmt: str, cfg: ExtractorConfig | None = None, template: str = "") -> bytes:
    """One document's rows as the content of a csv, json, xlsx or procos file."""
    output = (cfg or ExtractorConfig()).output
    rows = found.rows.where(F.col("source_pdf") == document)
    if fmt == "csv":
        return files.to_bytes(files.write_csv, rows, cfg=output)
    if fmt == "json":
        return files.to_bytes(files.write_json, rows, found.audit.where(F.col("source_pdf") == document).first(), document, cfg=output)
    if fmt == "xlsx":
        return files.to_bytes(files.write_xlsx, {document: rows}, cfg=output)
    if fmt == "procos":
        return files.to_bytes(files.write_template, rows, template)
    raise ValueError(f"no such format: {fmt}")


def default_reader():
    """Both libraries if they are installed, else the plain reader."""
    try:
        import fitz  # noqa: F401
        import pdfplumber  # noqa: F401
    except ImportError:
        return pdf.read_plain
    return pdf.read_libraries
