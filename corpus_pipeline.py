"""From raw documents to packed training sequences, each stage one operator of bomscope.llm on all that the one before kept.

toxicity   documents whose text scores 0.3 or more go
line dedup of alike lines the first stays; a document of which no line is left goes
near dedup of each group of documents with Jaccard 0.8 or more, the one with the smallest doc_id stays
pii        personal data is replaced by its kind
packing    what is left, as pieces with their place in sequences of 2048 tokens

All but the last return the columns of documents, n_chars brought up to date where the text changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomscope.llm import line_dedup, packing, pii, toxicity, trie_join
from bomscope.llm.common import discard, stash, table
from bomscope.llm.linking import without


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of score 0.3 or more go; null and empty texts stay, and everything if no label can be learned from. Rows that
    repeat go or stay together; null ids count as any other. An empty table stays empty."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; rows that had lines and have none left go, null and blank texts stay. Rows that repeat
    a doc_id and its text keep the same lines; null ids give way to others. An empty table stays empty."""
    out = line_dedup.line_dedup(docs)
    before, after = out.columns[-2:]
    kept = out.where((F.col(after) > 0) | (F.col(before) == 0))
    return _sized(kept.select(*[F.col(f"`{c}`") for c in docs.columns]))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates stays; texts without words are in no group, rows
    without a doc_id in none either and stay. Rows that repeat a doc_id are one document and go or stay together, whichever
    of them is alike to another. An empty table stays empty."""
    groups = trie_join.jaccard_join(docs)
    gone = stash(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return without(docs, gone, "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes <email>, <ip>, <card> or <phone>; every row stays, null and empty texts as they are, rows that
    repeat all alike. Of overlapping spans the first one's kind is written. An empty table stays empty."""
    return _sized(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; a null or empty text is one piece, the end id alone. Rows that
    repeat and rows without a doc_id are packed each for itself. An empty table gives no piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_jaccard", drop_near), ("pii", hide_pii), ("packing", pack)]

#: None of the learnt, hashed and searched decisions can be said in SQL; tests/llm/test_pipeline.py has them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, stash(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)
    return docs
