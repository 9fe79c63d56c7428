"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands (see genetic.py).

What the islands work on is the histogram of piece lengths, at most one count for each length up to the capacity: this
bounds what is sent to them and what comes back, at any number of documents. The pieces are then numbered within their
length and each number has its place by arithmetic; no task holds a group.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import discard, local_table, map_rows, parts, stash, table, texts
from .genetic import Solution, bins, evolve, fitness, load

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that are numbered in one group, and such groups that one running sum spans.
GROUP, SPAN = 512, 4096


def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a byte-level vocabulary file (.json or ranks); special strings are ordinary text."""
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str):
    """Ids of a text; one per Python worker."""
    return encoding(path).encode_ordinary


@lru_cache(maxsize=2)
def library_encoder(path: str):
    """Ids of a text as the library of a .json file gives them by default: its added tokens, where a text holds them, are
    one id each. Added tokens that take blanks with them, whole words or normalised text alone are refused."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError(f"{path} has added tokens of an unknown kind")
    special = {t["content"]: t["id"] for t in added}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens=special)

    def encode(text: str) -> list[int]:
        return enc.encode(text, allowed_special="all") if any(t in text for t in special) else enc.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, added: bool = False) -> DataFrame:
    """Each document's ids and the end id as pieces of at most the capacity; only the first piece may be shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = (library_encoder if added else encoder)(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for pdf in parts(batches):
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.asarray(encode(text), dtype="<u4").tobytes() + end
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                for k, b in enumerate(range(first, n + 1, capacity)):
                    a = max(0, b - (capacity if k else first))
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out

    return map_rows(texts(docs), run, PIECES)


def _number(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rank: 0, 1, ... within each length, without a task that holds all rows of a length."""
    spark = rows.sparkSession
    salts = local_table(spark, pa.table({"length": pa.array(list(counts), pa.int64()), "salts": pa.array([-(-n // GROUP) for n in counts.values()], pa.int64())}))
    salted = rows.join(F.broadcast(salts), "length")  # at most one row for each length up to the capacity
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "salts"))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("span", F.expr(f"salt div {SPAN}"))
    spans = sums.groupBy("length", "span").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("length").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("length", "span", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before_span"))
    inner = Window.partitionBy("length", "span").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before_salt", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(spans, ["length", "span"])
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("own", own).join(sums.select("length", "salt", "before_span", "before_salt"), ["length", "salt"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before_span") + F.col("before_salt") + F.col("own")).alias("rank"))


def search(spark: SparkSession, counts: np.ndarray, capacity: int, islands: int = 6, epochs: int = 3, population: int = 6, generations: int = 10) -> Solution:
    """The islands' best solution. Between epochs the best of every island moves on to the next one in a ring."""
    if not counts.any():
        return {}
    least = -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    held: dict[int, list[Solution]] = {}
    best: Solution | None = None
    for epoch in range(epochs):
        sent = {i: pickle.dumps(held.get(i, [])) for i in range(islands)}

        def island(batches: Iterator[pd.DataFrame], sent: dict[int, bytes] = sent, epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in pdf["id"].tolist():
                    top = evolve(counts, capacity, 1000 * epoch + i, pickle.loads(sent[i]), population, generations)
                    yield pd.DataFrame({"id": [i], "top": [pickle.dumps(top)]})

        # One small row for each island: its size depends on the number of distinct lengths alone.
        back = {r.id: pickle.loads(r.top) for r in spark.range(0, islands, 1, islands).mapInPandas(island, "id long, top binary").collect()}
        best = max([*(s for top in back.values() for s in top), *([best] if best else [])], key=lambda s: fitness(s, capacity))
        if bins(best) <= least:
            break
        held = {i: [*back[i], back[(i - 1) % islands][0]] for i in range(islands)}
    return best


def _places(solution: Solution) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where each pattern's share of its ranks starts, and the pattern's first bin, items a bin and offset."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for p, m in sorted(solution.items()):
        at = 0
        for a, k in p:
            found.setdefault(a, []).append((k * m, first, k, at))
            at += a * k
        first += m
    out = {}
    for a, x in found.items():
        share, first_bin, k, at = map(np.array, zip(*x, strict=True))
        out[a] = (np.concatenate([[0], np.cumsum(share)[:-1]]), first_bin, k, at)
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, added: bool = False, **search_options: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows with repeated or null doc_ids are packed each for itself. Sequences are
    filled without gaps from offset 0. An empty table gives an empty result. Other columns are ignored. With added, the
    added tokens of the vocabulary's .json file are one id each in texts that hold them, else they are ordinary text.
    """
    spark = docs.sparkSession
    rows = stash(pieces(docs, tokenizer_path, capacity, end_id, added), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    hist = np.zeros(capacity, dtype=np.int64)
    for a, n in counts.items():
        if a < capacity:
            hist[a] = n
    solution = search(spark, hist, capacity, **search_options)
    assert all(load(p) <= capacity for p in solution)
    places, full = _places(solution), bins(solution)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
            seq, offset = full + rank, np.zeros(len(rank), dtype=np.int64)  # full pieces have a sequence each
            for a in np.unique(length[length < capacity]).tolist():
                start, first, k, at = places[a]
                own = length == a
                i = np.searchsorted(start, rank[own], side="right") - 1
                r = rank[own] - start[i]
                seq[own] = first[i] + r // k[i]
                offset[own] = at[i] + r % k[i] * a
            yield pdf.assign(sequence_id=seq, offset=offset)

    # Deterministic numbers need a fixed order of equal rows; the numbered table is written so that a retry can't renumber half.
    numbered = stash(_number(rows, counts), "numbered")
    discard(rows)
    return map_rows(numbered, place, f"{PIECES}, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)
