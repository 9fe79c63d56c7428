"""N-gram Jaccard join over a prefix tree.

Global order of n-grams: those that stand in many documents last, else by hash; any order gives the same links, this one
gives short lists. Documents with the same set are one class. A set's first |x| - ceil(0.8 |x|) + 1 n-grams are its
prefix: two sets that link share one of them, so each shared prefix n-gram is a bucket. The sets of a bucket's block are
first reduced to those that parities of n-gram counts leave a partner, a bound that loses no link, and then
stored in a tree whose edges hold the n-grams in the global order; every set walks the tree, which counts the overlap of
a shared path once, and leaves a subtree when the n-grams that remain on both sides can't reach the overlap needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_table, map_rows, parts, stash, table, texts
from .components import Labels, components
from .linking import SENT_KEYS, linked, only
from .shingles import shingle_set, word_hashes

#: An n-gram that a batch of a task holds this often is reported; the most frequent of those reported, at most KEPT, come
#: last in order. N-grams over LOW of the hashes' range are hardly ever in a prefix anyway and aren't counted.
LOCAL, KEPT, LOW = 4, 500_000, np.uint64(0.35 * 2**63)
_LAST = np.uint64(1 << 63)


class Trie:
    """Path-compressed tree over sorted sets; a node is a range of them, the n-grams they share from a depth on, and its children."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.size = np.array([len(sets[i]) for i in self.order])
        self.root = self._node(0, len(sets), 0)

    def _node(self, lo: int, hi: int, depth: int) -> tuple:
        one, two = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
        n = min(len(one), len(two))
        differ = np.flatnonzero(one[depth:n] != two[depth:n])
        end = depth + int(differ[0]) if len(differ) else n
        kids = []
        at = lo
        while at < hi and len(self.sets[self.order[at]]) == end:  # these end here; they sort first
            at += 1
        ends = at
        while at < hi:
            head = self.sets[self.order[at]][end]
            to = at + 1
            while to < hi and self.sets[self.order[to]][end] == head:
                to += 1
            kids.append(self._node(at, to, end))
            at = to
        sizes = self.size[lo:hi]
        return lo, hi, ends, end, one[depth:end], int(sizes.min()), int(sizes.max()), kids

    def near(self, x: np.ndarray, skip) -> Iterator[int]:
        """Sets with 100 * overlap >= 80 * union, except in subtrees that skip(list of sets) turns down."""
        n = len(x)
        todo = [(self.root, 0, 0)]
        while todo:
            (lo, hi, ends, depth, path, least, most, kids), overlap, seen = todo.pop()
            if 5 * most < 4 * n or 4 * least > 5 * n or skip(self.order[lo:hi]):
                continue
            if len(path):
                at = np.searchsorted(x, path)
                overlap += int((x[np.minimum(at, n - 1)] == path).sum())
                seen = int(np.searchsorted(x, path[-1], side="right"))
            size = min(max(depth + n - seen, least), most)  # the size for which the bound is widest
            if 9 * (overlap + min(n - seen, size - depth)) < 4 * (n + size):
                continue
            for i in range(lo, ends):
                if 9 * overlap >= 4 * (n + depth):
                    yield self.order[i]
            todo += [(k, overlap, seen) for k in kids]


def compare_sets(data: list[bytes], side: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Links that join a block's sets; pairs known to be connected are passed over."""
    sets = [np.frombuffer(x, dtype="<u8") for x in data]
    have, sides = Labels(known), side.tolist()
    of = have.of
    out = []
    tree = Trie(sets)
    for i, x in enumerate(sets):
        own = sides[i]

        def skip(some: list[int], i: int = i, own: int = own) -> bool:
            r = of[i]
            return all(of[j] == r or own >= 0 and sides[j] == own for j in some)

        for j in tree.near(x, skip):
            if not (own >= 0 and sides[j] == own) and have.join(i, j):
                out.append((i, j))
    return out


def parity(s: np.ndarray) -> bytes:
    """The set's size and, for each of at least that many cells that n-grams are dealt to, whether it has an odd number of them."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.uint64(len(s)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(sketches: list[bytes], side: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Members with a partner that sizes and parities allow."""
    return may_pair(sketches, side, known).any(axis=1)


def may_pair(sketches: list[bytes], side: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Pairs that sizes and parities allow: each cell in which the parities differ holds an n-gram that
    only one of the two has, and of |x| + |y| no more than a ninth may be such."""
    size = np.array([int(np.frombuffer(x[:8], dtype=np.uint64)[0]) for x in sketches])
    words = np.array([(len(x) - 8) // 8 for x in sketches])
    own = np.zeros((len(sketches), len(sketches)), dtype=bool)
    cells = {w: np.array([np.frombuffer(sketches[i], dtype=np.uint64, offset=8) for i in np.flatnonzero(words == w)]) for w in np.unique(words).tolist()}
    for w, x in cells.items():
        a = np.flatnonzero(words == w)
        for v, y in cells.items():
            if v < w or v > 2 * w:  # sizes within 4 : 5 have as many cells or twice as many
                continue
            b = np.flatnonzero(words == v)
            folded = y if v == w else y[:, :w] ^ y[:, w:]
            for lo in range(0, len(a), 64):
                i = a[lo : lo + 64]
                differ = np.bitwise_count(x[lo : lo + 64, None, :] ^ folded[None, :, :]).sum(axis=2, dtype=np.int64)
                total = size[i][:, None] + size[b][None, :]
                ok = (9 * differ <= total) & (5 * np.minimum(size[i][:, None], size[b][None, :]) >= 4 * np.maximum(size[i][:, None], size[b][None, :]))
                ok &= known[i][:, None] != known[b][None, :]
                ok &= (side[i][:, None] < 0) | (side[i][:, None] != side[b][None, :])
                own[np.ix_(i, b)] = ok
                own[np.ix_(b, i)] |= ok.T
    return own


def _sets(pdf: pd.DataFrame, k: int) -> Iterator[tuple[object, np.ndarray]]:
    yield from zip(pdf["doc_id"].tolist(), (shingle_set(w, k) for w in word_hashes(pdf["text"].tolist())), strict=True)


def frequent(docs: DataFrame, k: int = 5) -> np.ndarray:
    """N-grams that come last in the global order, sorted: counts over all documents, of what a batch holds LOCAL times or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            every = [s[: np.searchsorted(s, LOW)] for _, s in _sets(pdf, k)]
            if every:
                h, n = np.unique(np.concatenate(every), return_counts=True)
                yield pd.DataFrame({"h": h[n >= LOCAL].astype(np.int64), "n": n[n >= LOCAL]})

    counts = docs.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(KEPT).select("h").toPandas()  # at most 4 MB
    return np.sort(top["h"].to_numpy().astype(np.uint64))


def ordered(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A set in the global order: the top bit marks the n-grams that come last."""
    if not len(last) or not len(s):
        return s
    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
    own = last[at] == s
    return np.concatenate([s[~own], s[own] | _LAST])


def name(raw: bytes, seed: int) -> int:
    """A set's id, or with another seed its check."""
    return xxhash.xxh3_64_intdigest(raw, seed=seed) - 2**63


def jaccard_join(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, for links of at least 0.8 between sets of k-word shingles.

    A null or empty text, or one of white space, has an empty set, links with nothing and is its own component. Equal sets
    link. Rows that repeat a doc_id count as one document with each of its texts. A null doc_id links with nothing and has
    a null component. An empty table gives an empty result; other columns are ignored. N-grams and sets are identified by
    64-bit hashes; sets that share one, as a second hash shows, are known by the second.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    last = spark.sparkContext.broadcast(frequent(rows, k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in parts(batches):
            out = []
            for doc_id, s in _sets(pdf, k):
                raw = s.tobytes()
                sig, check = name(raw, 0), name(raw, 1)
                n = len(s)
                prefix = sketch = None
                if n and sig not in seen and not pd.isna(doc_id):
                    if len(seen) >= 250_000:
                        seen.clear()
                    seen.add(sig)
                    prefix = ordered(s, last.value)[: n - -(-4 * n // 5) + 1].view(np.int64)
                    sketch = parity(s)
                out.append((doc_id, n, sig, check, prefix, sketch))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "id", "check", "prefix", "sketch"])

    all_rows = stash(map_rows(rows, run, "doc_id long, n_shingles long, id long, check long, prefix array<long>, sketch binary"), "sets")
    marks = lambda every: every.where("n_shingles > 0 and doc_id is not null")
    marked = marks(all_rows)
    classes = stash(marked.groupBy("id").agg(F.min("doc_id").alias("low"), F.min("check").alias("c1"), F.max("check").alias("c2")), "classes")
    # Of n sets some n * n / 2**65 share an id: none, or so few that each can have its other hash for an id.
    twins = {r.id for r in classes.where("c1 <> c2").select("id").limit(SENT_KEYS + 1).collect()}
    if len(twins) > SENT_KEYS:
        raise ValueError("too many sets share a 64-bit hash")
    if twins:
        again = F.broadcast(local_table(spark, pa.table({"id": pa.array(list(twins), pa.int64()), "clash": pa.array([True] * len(twins))})))
        all_rows = all_rows.join(again, "id", "left").withColumn("id", F.when(F.col("clash"), F.col("check")).otherwise(F.col("id"))).drop("clash")
        marked = marks(all_rows)
        classes = stash(marked.groupBy("id").agg(F.min("doc_id").alias("low")), "classes")

    def payload_of(ids: DataFrame) -> DataFrame:
        def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts(batches, 200):
                got = []
                for _, s in _sets(pdf, k):
                    if len(s):
                        sig = name(s.tobytes(), 0)
                        got.append((name(s.tobytes(), 1) if sig in twins else sig, ordered(s, last.value).tobytes()))
                yield pd.DataFrame(got, columns=["id", "data"])

        wanted = stash(classes.join(ids, "id", "left_semi").select(F.col("low").alias("doc_id")).distinct(), "wanted")
        return only(rows, wanted, "doc_id").mapInPandas(full, "id long, data binary")

    signed = all_rows.where("prefix is not null").select("id", F.col("n_shingles").cast("int").alias("size"), F.col("prefix").alias("buckets"))
    sketches = all_rows.where("sketch is not null").select("id", "sketch").dropDuplicates(["id"])
    found = linked(signed, payload_of, compare_sets, sketches=sketches, may=may_pair)
    of_class = stash(classes.join(found, "id", "left").select("id", "low", F.coalesce("component", "id").alias("component")), "of_class")
    least = of_class.groupBy("component").agg(F.min("low").alias("least"))
    named = of_class.join(least, "component").select("id", "least")
    # A doc_id that repeats with other texts connects their components.
    twice = marked.select("doc_id", "id").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        own = marked.join(twice, "doc_id").join(named, "id").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
        more = components(own.unionByName(named.select(F.col("least").alias("a"), F.col("least").alias("b")))).select(F.col("id").alias("least"), "component")
        named = named.join(more, "least", "left").select("id", F.coalesce("component", "least").alias("least"))
    keyed = all_rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("id")).alias("id"))
    return keyed.join(stash(named, "named"), "id", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op10_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
