"""New documents as a stream: every micro-batch of files goes through both halves. A document is complete in its file,
so nothing is kept between batches and no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.lifecycle import run
from ..operators.tables import from_grid
from ..sources.tables import PAGES


def watch(spark: SparkSession, pages_path: str, grids_of: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str) -> StreamingQuery:
    """Run over new Parquet files of pages; rows go to out_path/rows, audits to out_path/audit, once each batch.

    grids_of: the grids (doc, page, parser, table_index, grid) of a batch of pages. A batch that is done again after a
    failure overwrites its own folders.
    """
    stream = spark.readStream.schema(PAGES).parquet(pages_path)

    def batch(pages: DataFrame, number: int) -> None:
        pages = pages.persist()
        grids = grids_of(pages).persist()
        _, found = run(pages.select("doc").distinct(), pages, grids.where("parser is not null").drop("parser").dropDuplicates(["doc", "page", "table_index"]), from_grid(grids, grids["parser"]))
        found.rows.write.mode("overwrite").parquet(f"{out_path}/rows/batch={number}")
        found.audit.write.mode("overwrite").parquet(f"{out_path}/audit/batch={number}")
        grids.unpersist()
        pages.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
