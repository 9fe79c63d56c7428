"""Toxicity scores of documents by the network of gru.py, trained by one task on a bounded sample of labelled rows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, local_table, map_rows, release, small_batches, table, texts
from .gru import Net, Scorer, train

#: The sample: rows of each label, and the longest text taken (characters). Scoring has no such bounds.
TRAIN_ONES, TRAIN_ZEROS, TRAIN_CHARS = 800, 2400, 5_000
THRESHOLD = 0.3
_scorers: dict[int, Scorer] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Net | None:
    """Train on labelled rows that aren't held out, the same ones of each label whatever the partitioning. One task trains: the
    driver gets the ids and the net, no text.

    Null labels and labels of no document are passed over; None if a label is missing.
    """
    rows = texts(docs).where(F.length("text") <= TRAIN_CHARS)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample: list[DataFrame] = []
    for label, n in ((1, TRAIN_ONES), (0, TRAIN_ZEROS)):
        # Twice as many ids as rows wanted, as some texts are too long or missing.
        ids = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n).select("doc_id")
        ids = local_table(docs.sparkSession, pa.table({"doc_id": pa.array(ids.toPandas()["doc_id"], pa.int64())}))
        got = rows.join(F.broadcast(ids), "doc_id").select(F.lit(label).alias("label"), F.xxhash64("doc_id").alias("place"), "doc_id", "text")
        sample.append(got.orderBy("place", "doc_id", "text").limit(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        got.sort(key=lambda x: (-x[0], x[1], x[2], x[3].encode("utf-8", "surrogatepass")))
        net = train([x[3] for x in got], [x[0] for x in got])
        del got
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])
        del net
        release()

    # At most TRAIN_ONES + TRAIN_ZEROS rows.
    back = sample[0].unionByName(sample[1]).coalesce(1).mapInArrow(run, "net binary").collect()
    give_back(docs.sparkSession)
    return pickle.loads(back[0].net) if back else None


def toxicity(docs: DataFrame, net: Net | None, name: str = "score") -> DataFrame:
    """Per row: doc_id and the score of the whole text, the highest of all its overlapping windows.

    A null or empty text, or one of white space, scores 0, as does everything without a net. Rows keep their number;
    null and repeated doc_ids pass through. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(model.value)
        if key not in _scorers:
            _scorers.clear()
            got = pickle.loads(model.value)
            _scorers[key] = Scorer(got) if got else None
        scorer = _scorers[key]
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                part = pdf.iloc[i : i + 512]
                yield pd.DataFrame({"doc_id": part["doc_id"], name: scorer.score(part["text"].tolist()) if scorer else 0.0})

    return map_rows(texts(docs), run, f"doc_id long, {name} double")


def clean(docs: DataFrame, net: Net | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The input's rows whose text scores below the threshold, all their columns as they are. A null text stays."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pickle.loads(model.value)
        scorer = Scorer(got) if got else None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                said = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield part.filter(pa.array(scorer.score([t or "" for t in said]) < threshold)) if scorer else part
        del got, scorer
        release()

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
