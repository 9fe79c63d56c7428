"""Byte-level BPE encoding and decoding of a documents table by monoid tree reduction (see bpe.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByWord, TreeBPE, load_ranks
from .common import map_rows, table, texts


@lru_cache(maxsize=2)
def _coder(path: str) -> tuple[TreeBPE, ByWord]:
    """One per Python worker, which keeps it from task to task."""
    bpe = TreeBPE(load_ranks(path))
    return bpe, ByWord(bpe)


def bpe_encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids array<int>: whole texts by the given ranks, without special tokens (their strings are ordinary text).

    A null or empty text has no ids. Rows keep their number; repeated rows repeat. The path must exist on all machines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, words = _coder(ranks_path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [words.ids(t) for t in pdf["text"]]})

    return map_rows(texts(docs), run, "doc_id long, ids array<int>")


def bpe_decode(ids: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text_bytes binary from (doc_id, ids): the inverse. Null ids decode to no bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, _ = _coder(ranks_path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_bytes": [bpe.decode([] if x is None else list(x)) for x in pdf["ids"]]})

    return map_rows(ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text_bytes binary")


def bpe_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again in one pass.

    Nulls, empty texts and repeated rows as in bpe_encode: an empty text has the digests of no bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, words = _coder(ranks_path)
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                said, decoded = words.digests(t)
                rows.append((said.count(",") + 1 if said else 0, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return map_rows(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
