"""Training-order materialisation: every sequence gets a global slot by a keyed permutation, and shards hold slot ranges.

Layout of a shard: records of one stride, each an id (int64), the part's number (uint32), the number of its tokens
(uint32), seq_len uint16 ids (unused ones 65535) and a newline. A shard's first slot is the number of records in the
shards before it, by their file sizes, and its record k stands at byte k * stride: a reader seeks there and goes on, a
broken-off one too. Spark's text writer commits the files, on any store.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts as slices
from .common import map_rows, shared_dir, table, texts
from .packing import encoder

HEAD = np.dtype([("doc_id", "<i8"), ("part", "<u4"), ("n_tokens", "<u4")])
NO_ID = -(2**63)


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1, n up to 2**64: a Feistel network over the next even number of bits, walked along its cycle until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1)) for r in range(rounds)]

    def mix(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x ^ k) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for k in reversed(keys) if back else keys:
            a, b = (b ^ mix(a, k), a) if back else (b, a ^ mix(b, k))
        return (a << shift) | b

    out = once(np.asarray(index, dtype=np.uint64))
    while (outside := out > np.uint64(n - 1)).any():
        out[outside] = once(out[outside])
    return out


def places(ids: np.ndarray, parts: np.ndarray, span: int, key: int) -> np.ndarray:
    """Where sequences stand: part k of the document at id (from 0 to span - 1) at the k-th keyed permutation of its id."""
    out = np.empty(len(ids), dtype=np.uint64)
    for k in np.unique(parts).tolist():
        own = parts == k
        out[own] = feistel(ids[own], span, key + k * 0x9E3779B9)
    return out


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, seq_len: int = 512, shard_bytes: int = 16 << 20, key: int = 20_240_501, end_id: int = 50_256) -> int:
    """Write the shards under path; how many there are at most (one of few sequences may stay empty).

    A document is its ids and the end id, cut every seq_len tokens; a null or empty text is the end id alone. Part k of the
    document with id i has the place that the k-th keyed permutation of all ids from the least to the largest gives i;
    sequences are ordered by place, then part, then content; shards are equal ranges of places, and a sequence's global slot
    is its rank. The order depends on ids, texts and key alone, not on how the input is split, and one pass over the texts
    suffices: nobody need know the number of sequences before.
    An empty table writes no shard. Rows that repeat are written each for itself, side by side; rows with a null id stand
    where a hash of their text says (the least 64-bit number marks them in the files and is no id). Other columns are ignored.
    """
    rows = texts(docs)
    size = F.octet_length("text").cast("long")
    known = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(size).alias("bytes")).first()
    if not known["n"]:
        return 0
    low = known["low"] or 0
    span = (known["high"] or 0) - low + 1
    # As many shards as the texts' bytes fill at about four to a token.
    width = min(2**64 - 1, -(-span // max(1, min(known["n"], span, -(-(known["bytes"] + known["n"]) // shard_bytes)))))
    n_shards = -(-span // width)
    end = np.array([end_id], dtype="<u2").tobytes()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, squeeze = encoder(tokenizer_path), zstandard.ZstdCompressor(level=1).compress
        for pdf in slices(batches, 500):
            head, part, number = [], [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                null = pd.isna(doc_id)
                at = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % span if null else int(doc_id) - low
                tokens = np.asarray(encode(text), dtype="<u2").tobytes() + end
                for k, a in enumerate(range(0, len(tokens), 2 * seq_len)):
                    part.append(tokens[a : a + 2 * seq_len])
                    head.append((NO_ID if null else int(doc_id), k, len(part[-1]) // 2))
                    number.append(at)
            raw = np.array(head, dtype=HEAD)
            place = places(np.array(number, dtype=np.uint64), raw["part"], span, key)
            shard = (place // np.uint64(width)).astype(np.int32)
            yield pd.DataFrame({"shard": shard, "place": (place ^ np.uint64(1 << 63)).view(np.int64), "part": raw["part"].astype(np.int32), "record": [squeeze(raw[j].tobytes() + x) for j, x in enumerate(part)]})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full, open_up = HEAD.itemsize + 2 * seq_len, zstandard.ZstdDecompressor().decompress
        for pdf in batches:
            yield pd.DataFrame({"shard": pdf["shard"], "value": [open_up(x).ljust(full, b"\xff") for x in pdf["record"]]})

    dealt = map_rows(rows, deal, "shard int, place long, part int, record binary")
    dealt = dealt.repartitionById(n_shards, "shard").sortWithinPartitions("shard", "place", "part", "record")
    dealt.mapInPandas(fill, "shard int, value binary").select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").text(path)
    return n_shards


def read_shards(spark: SparkSession, path: str, seq_len: int = 512, with_ids: bool = True) -> DataFrame:
    """Per record: slot, shard, doc_id, part, n_tokens, ids_crc32 (of the uint16 ids) and the ids."""
    stride = HEAD.itemsize + 2 * seq_len + 1
    kind = np.dtype([("head", HEAD), ("ids", "<u2", (seq_len,)), ("end", "u1")])
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    sizes = found.select("shard", "length").toPandas().sort_values("shard")  # a row a shard; the content isn't read
    base = dict(zip(sizes["shard"].tolist(), ((sizes["length"].cumsum() - sizes["length"]) // stride).tolist(), strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, content in zip(pdf["shard"].tolist(), pdf["content"], strict=True):
                if len(content) % stride:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                got = np.frombuffer(content, dtype=kind)
                n = got["head"]["n_tokens"]
                doc_id = pd.Series(got["head"]["doc_id"], dtype="Int64").mask(got["head"]["doc_id"] == NO_ID)
                ids = [x[:k] for x, k in zip(got["ids"], n.tolist(), strict=True)]
                out = {"slot": base[shard] + np.arange(len(got)), "shard": shard, "doc_id": doc_id, "part": got["head"]["part"].astype(np.int32), "n_tokens": n.astype(np.int32), "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}
                yield pd.DataFrame(out | ({"ids": [x.astype(np.int32) for x in ids]} if with_ids else {}))

    schema = "slot long, shard int, doc_id long, part int, n_tokens int, ids_crc32 long" + ", ids array<int>" * with_ids
    return found.select("shard", "content").mapInPandas(run, schema)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/bomscope/shards-{uuid.uuid4().hex}"
    schema = "slot long, shard int, doc_id long, part int, n_tokens int, ids_crc32 long"
    if not write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")):
        return spark.createDataFrame([], schema)
    return read_shards(spark, path, with_ids=False)
