"""Connected components, distributed: union-find inside each partition, then contraction rounds.

No link or component reaches the driver, only the count of the edges left. Few edges are joined by one task. Else every
round maps each vertex to the smallest of itself and its neighbours (on every other round in an order stirred by XOR, so
that long chains halve too), and relabels the edges. The written maps are composed backwards at the end.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

#: Rows of two numbers that are sent to all executors (a few MB) instead of dealing both sides of a join.
FEW = 100_000
#: Links, a forest of each batch, that one task joins at most (8 MB); more are joined in rounds.
TOGETHER = 500_000


def few(df: DataFrame, n: int | None = None) -> DataFrame:
    """A written table, marked to be broadcast if it has few rows: n, or as counted."""
    return F.broadcast(df) if (df.count() if n is None else n) <= FEW else df


class Sets:
    """Union-find over positions 0..n-1; the root is the smallest position."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class Labels:
    """Components of a block's members by their labels, which are always up to date: of[i] == of[j] if i and j are connected."""

    def __init__(self, known: np.ndarray) -> None:
        first: dict[int, int] = {}
        self.of = [first.setdefault(c, i) for i, c in enumerate(known.tolist())]
        self.members: dict[int, list[int]] = {}
        for i, c in enumerate(self.of):
            self.members.setdefault(c, []).append(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.of[i], self.of[j]
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        for k in moved:
            self.of[k] = a
        self.members[a] += moved
        return True


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's edges as a spanning forest: every vertex beside its smallest reachable one."""
    for pdf in batches:
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = Sets(len(ids))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            sets.join(x, y)
        root = np.array([sets.root(i) for i in range(len(ids))], dtype=np.int64)
        own = root != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[root[own]], "b": ids[own]})


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, r) of all the links of one task: every vertex with the smallest that it reaches."""
    parts = [pdf.to_numpy() for pdf in batches]
    if parts:
        ids, at = np.unique(np.concatenate(parts), return_inverse=True)
        at, sets = at.reshape(-1, 2), Sets(len(ids))
        for x, y in zip(at[:, 0].tolist(), at[:, 1].tolist(), strict=True):
            sets.join(x, y)
        yield pd.DataFrame({"id": ids, "r": ids[[sets.root(i) for i in range(len(ids))]]})


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b long) -> (id, component): every linked id with the smallest id of its component.

    Self-links and null ends link nothing. An empty table gives an empty one. Links may repeat in either direction.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = stash(e.mapInPandas(_forest, "a long, b long").distinct(), "edges")
    chain: list[DataFrame] = []
    size: list[int] = []  # of the chain's maps
    rounds = 0
    stir = random.Random(7)
    n = e.count()
    if 0 < n <= TOGETHER:
        return _least(stash(e.coalesce(1).mapInPandas(_together, "id long, r long"), "labels"), e)
    while n:
        seed = F.lit(0 if rounds < 2 or rounds % 2 else stir.getrandbits(62)).cast("long")
        ends = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(seed)).alias("m"))
        up = stash(up.select(F.col("a").alias("id"), F.least("m", F.col("a").bitwiseXOR(seed)).bitwiseXOR(seed).alias("r")), "map")
        chain.append(up)
        size.append(up.count())
        sent = few(up, size[-1])
        one = sent.select(F.col("id").alias("a"), F.col("r").alias("ra"))
        two = sent.select(F.col("id").alias("b"), F.col("r").alias("rb"))
        nxt = e.join(one, "a").join(two, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        nxt = stash(nxt.mapInPandas(_forest, "a long, b long").distinct(), "edges")
        discard(e)
        e, rounds = nxt, rounds + 1
        n = e.count()
    if not chain:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = chain[-1]
    for up, n in zip(reversed(chain[:-1]), reversed(size), strict=False):
        later = few(label, n).select(F.col("id").alias("r"), F.col("r").alias("root"))
        label = up.join(later, "r", "left").select("id", F.coalesce("root", "r").alias("r"))
    return _least(stash(label, "labels"), e, *chain)


def _least(label: DataFrame, *done: DataFrame) -> DataFrame:
    """label(id, r), r the same for all of a component, as (id, component)."""
    discard(*done)
    # Written, so that a join of many rows deals both sides itself and Spark can split a root that very many ids share.
    least = stash(label.groupBy("r").agg(F.min("id").alias("component")), "roots")
    return label.join(few(least), "r").select("id", "component")
