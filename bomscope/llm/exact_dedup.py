"""Exact deduplication by skew-safe combining: inside each task, over salted digest groups, then over the salt winners.

One plan at every size. The rows are grouped as they are read, by salt, digest and full text: Spark combines inside each
task first, so a task sends one row for each salt and text whatever number of copies it holds, and merges the salted
groups next; the winners of all salts are combined by digest and text. The digest only routes, the full text is compared
at every stage, so two texts that share a digest never merge. What the rows then learn travels without texts, by digest
and salt. All of it is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stash, table, texts

SALTS = 128


def salted(rows: DataFrame) -> DataFrame:
    """(doc_id, text, digest, salt) -> one row for each salt, digest and full text: combined inside tasks, then by salted digest."""
    return rows.groupBy("salt", "digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] | None = None, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty; of equal texts the largest doc_id stays. Rows that
    repeat a doc_id and its text share their flags and count separately in group_size. A null doc_id never wins over
    another id; a group of null ids has a null keep_id and keeps them all. An empty table gives an empty result. Other
    columns are ignored. digest: any function of the text; a weak one only costs time.
    """
    own = digest is None
    digest = digest or (lambda c: F.unhex(F.sha2(c, 256)))
    # The salt depends on the row alone, so that a task that is run again deals its rows as before.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    rows = texts(docs).select("doc_id", "text", digest(F.col("text")).alias("digest"), salt.alias("salt"))
    won = salted(rows).groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    won = stash(won.select("digest", "keep_id", "group_size"), "winners")
    clash = stash(won.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "clashes")
    marks = stash(rows.select("doc_id", "digest", "salt", *[F.sha2("text", 256).alias("text_sha256")] * (not own)), "marks")
    marks = marks.withColumn("text_sha256", F.lower(F.hex("digest"))) if own else marks
    # A digest that many rows have is met by its rows salt by salt; one that a single row has needs no partner.
    met = marks.groupBy("digest", "salt").agg(F.count("*").alias("n")).select("digest", "salt")
    copies = met.join(won.where("group_size > 1"), "digest").withColumnRenamed("digest", "of").withColumnRenamed("salt", "of_salt")
    found = marks.join(copies, F.expr("digest = of and salt = of_salt"), "left")
    columns = ("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    if clash.isEmpty():
        out = found.select(*columns)
        discard(clash)
    else:
        found = marks.join(clash, "digest", "left_anti").join(copies.join(clash.withColumnRenamed("digest", "of"), "of", "left_anti"), F.expr("digest = of and salt = of_salt"), "left")
        mixed = rows.join(clash, "digest", "left_semi")
        by_text = mixed.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = found.select(*columns).unionByName(mixed.join(by_text, ["digest", "text"]).select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
