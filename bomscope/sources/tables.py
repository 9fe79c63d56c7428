"""Pages and tables that another job has already written, as Parquet or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES = "doc string, page int, text string, width double, height double, n_lines int, n_curves int, n_rects int, words array<struct<x0:double,y0:double,x1:double,y1:double,word:string>>"
GRIDS = "doc string, page int, parser string, table_index int, grid array<array<string>>"


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table of the given schema, columns it lacks being null; no inference."""
    if kind == "parquet":
        return spark.read.schema(schema).parquet(path)
    if kind == "json":
        return spark.read.schema(schema).json(path)
    raise ValueError(f"no such kind of file: {kind}")


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return read(spark, path, PAGES, kind)


def read_grids(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return read(spark, path, GRIDS, kind)
