import base64
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bomscope.llm.bpe import ByWord, TreeBPE, load_ranks
from bomscope.llm.genetic import bins, crossover, evolve, first_solution, load, mutate
from bomscope.llm.exact_dedup import exact_dedup
from bomscope.llm.masked_lm import fit, score
from bomscope.llm.packing import encoding, library_encoder, op4_packing, pack
from bomscope.llm.pii import pii
from bomscope.llm.shards import feistel, read_shards, write_shards
from bomscope.llm.toxicity import toxicity
from bomscope.llm.tree_bpe import bpe_decode, bpe_digests, bpe_encode
from bomscope.llm.trie_join import jaccard_join

MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
with open(MULTI, "rb") as f:
    PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
TREE = TreeBPE(load_ranks(MULTI))
WORDS = ByWord(TREE, size=50)
TEXTS = ["", None, " ", "a", "  two  blanks  ", "It's we'll\n\n\tdone \r\n x", "naïve café 123 4567!!", "a" * 5000, "ab" * 3000 + " end", "日本語 текст  x", "<|endoftext|> is text", "é​ 🙂🙂"]
ROWS = list(enumerate([*TEXTS, *TEXTS[3:6]], 1)) + [(None, "null id"), (1, "again")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "c", 7) for i, t in rows], "doc_id long, text string, piece string, length int")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\tabcdeéíothernsw'12.,-"), st.characters(codec="utf-8")), max_size=60))
def test_tree_is_the_plain_encoding(text):
    ids = PLAIN.encode_ordinary(text)
    assert TREE.encode(text) == ids
    assert WORDS.ids(text) == ids
    assert WORDS.digests(text) == (",".join(map(str, ids)), text.encode())
    assert TREE.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=24), st.binary(max_size=24))
def test_join_is_a_monoid(x, y):
    assert TREE.join(TREE.merge(x), TREE.merge(y)) == TREE.merge(x + y) == TREE.encode_bytes(x + y)


def test_large_ids_beside_null_ones(spark):
    """No operator may pass ids through floating point."""
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "one two three four five six"), (None, "a"), (big + 2, "x 1.2.3.4 y")], "doc_id long, text string").coalesce(1)
    path = P.path("byte_bpe_50k.json")
    for got in (bpe_digests(docs, MULTI), bpe_encode(docs, MULTI), pack(docs, path), pii(docs), jaccard_join(docs), toxicity(docs, None), exact_dedup(docs), score(docs, fit(docs, rounds=1))):
        assert sorted((r.doc_id for r in got.select("doc_id").collect()), key=str) == sorted([big, None, big + 2], key=str)


def test_bpe_of_a_table(spark):
    ids = bpe_encode(frame(spark), MULTI)
    got = sorted(((r.doc_id, list(r.ids)) for r in ids.collect()), key=str)
    assert got == sorted(((i, PLAIN.encode_ordinary(t or "")) for i, t in ROWS), key=str)
    assert sorted(((r.doc_id, bytes(r.text_bytes)) for r in bpe_decode(ids, MULTI).collect()), key=str) == sorted(((i, (t or "").encode()) for i, t in ROWS), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(PLAIN.encode_ordinary(t or "")), sha(",".join(map(str, PLAIN.encode_ordinary(t or ""))).encode()), sha((t or "").encode())) for i, t in ROWS]
    assert sorted(map(tuple, bpe_digests(frame(spark), MULTI).collect()), key=str) == sorted(want, key=str)


def test_the_json_vocabulary_gives_the_ids_of_its_library():
    other = Tokenizer.from_file(JSON)
    other.encode_special_tokens = True
    mine = encoding(JSON)
    for t in TEXTS:
        assert mine.encode_ordinary(t or "") == other.encode(t or "", add_special_tokens=False).ids


def test_packing_has_the_ids_of_the_library_by_default(spark, tmp_path):
    other = Tokenizer.from_file(JSON)
    special = ["a <|endoftext|>", "x  <|endoftext|>  y<|endoftext|><|endoftext|>z \n", "<|endoftext|", " <|endoftext|> 's"]
    rows = [(i, t) for i, t in enumerate([*TEXTS, *special])]
    assert library_encoder(JSON)("<|endoftext|> is text")[0] == 50256
    want = set()
    for i, t in rows:
        ids = other.encode(t or "", add_special_tokens=False).ids
        assert library_encoder(JSON)(t or "") == ids
        if len(ids) < 2048:
            want.add((i, len(ids) + 1, zlib.crc32(np.array([*ids, 0], dtype="<u4").tobytes())))
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.length, r.ids_crc32) for r in op4_packing(spark, str(tmp_path)).collect()}
    assert want <= got and len(want) >= len(special)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_feistel_permutes(n):
    out = feistel(np.arange(n), n, 9)
    assert sorted(out) == list(range(n))
    assert (feistel(out, n, 9, back=True) == np.arange(n)).all()
    assert n < 60 or (out != feistel(np.arange(n), n, 10)).any()


def test_shards_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    n = write_shards(frame(spark).repartition(3), path, JSON, seq_len=16, shard_bytes=2000, key=4)
    rows = read_shards(spark, path, seq_len=16).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert n >= len({r.shard for r in rows}) > 1
    docs = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.part):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u2").tobytes()) and r.n_tokens == len(r.ids) <= 16
        docs[r.doc_id].append(list(r.ids))
    enc = encoding(JSON)
    for i, t in ROWS:
        if i != 1:  # that id names two rows
            assert sum(docs[i], []) == [*enc.encode_ordinary(t or ""), 50256]
    assert write_shards(frame(spark, []), f"file://{tmp_path}/none", JSON) == 0


def plain_feistel(x, n, key):
    """The permutation once more, number by number in whole numbers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, all_ = (1 << half) - 1, (1 << 64) - 1
    while True:
        a, b = x >> half, x & low
        for r in range(6):
            m = ((b ^ ((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & all_)) * 0xBF58476D1CE4E5B9) & all_
            m = ((m ^ (m >> 27)) * 0x94D049BB133111EB) & all_
            a, b = b, a ^ ((m ^ (m >> 31)) & low)
        x = a << half | b
        if x < n:
            return x


@pytest.mark.parametrize("ids", [list(range(40, 80)), [1 - 2**63, 5, 2**63 - 1, 12, -4], [7]], ids=["dense", "all of 64 bits", "one"])
def test_slots_follow_the_permutation_however_the_input_is_split(spark, tmp_path, ids):
    rows = [(i, "some words " * (1 + n % 9)) for n, i in enumerate(ids)]
    enc, low, span = encoding(JSON), min(ids), max(ids) - min(ids) + 1
    want = sorted((plain_feistel(i - low, span, 3 + k * 0x9E3779B9), k, i) for i, t in rows for k in range(-(-(len(enc.encode_ordinary(t)) + 1) // 8)))
    for n in (1, 4):
        path = f"file://{tmp_path}/{n}"
        write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), path, JSON, seq_len=8, shard_bytes=300, key=3)
        got = sorted((r.slot, r.part, r.doc_id) for r in read_shards(spark, path, seq_len=8).collect())
        assert got == [(s, k, i) for s, (_, k, i) in enumerate(want)]


def feasible(s, counts, cap):
    use = np.zeros_like(counts)
    for p, m in s.items():
        assert load(p) <= cap and m > 0
        for a, k in p:
            use[a] += k * m
    return (use == counts).all()


def test_genetic_operators_keep_every_item():
    import random

    rng = random.Random(1)
    counts = np.zeros(100, dtype=np.int64)
    for a in rng.choices(range(1, 100), k=400):
        counts[a] += 1
    one, two = first_solution(counts, 100, rng), first_solution(counts, 100, rng)
    for s in (one, two, crossover(one, two, counts, 100, rng), mutate(one, counts, 100, rng)):
        assert feasible(s, counts, 100)
    best = evolve(counts, 100, 5, [], 4, 6)[0]
    assert bins(best) <= bins(one) and bins(best) <= 1.02 * -(-int((counts * np.arange(100)).sum()) // 100) + 1


def test_packing(spark):
    rows = [*ROWS, *[(100 + i, "word " * (i % 40)) for i in range(200)]]
    got = pack(frame(spark, rows), JSON, capacity=64, islands=2, epochs=2).collect()
    enc = encoding(JSON)
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*enc.encode_ordinary(t or ""), 0], dtype="<u4")
        first = len(ids) % 64 or min(len(ids), 64)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64
    assert len(seqs) <= -(-sum(r.length for r in got) // 64) + 1
    assert pack(frame(spark, []), JSON).count() == 0
