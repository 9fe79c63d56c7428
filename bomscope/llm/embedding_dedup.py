"""Embedding near-deduplication by PCA-ordered tiled comparison.

Unit vectors are turned into the basis of their second moments, largest first. Every label is cut into tiles along the
first coordinate; tiles whose boxes in the leading coordinates stand too far apart are never compared. What travels is
the vector as given, once for each tile that its own may meet; tasks turn it again. Two tiles are compared on leading dimensions
first: a pair goes on only while its partial product plus the product of the norms of what is left can reach the
threshold. The turning only decides what to leave out, with a margin above its rounding; a link is decided by the
cosine of the vectors as given, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_runs, small_batches, stash, table
from .components import Sets, components

#: Components of a tile's vectors, cuts along the first coordinate, coordinates of a tile's box, room for rounding, and rows
#: of a tile that are compared at once.
TILE, BINS, BOX, SLACK, AT_ONCE = 1 << 18, 2048, 8, 1e-9, 512


def moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension count, the basis (columns, by falling eigenvalue) of the unit vectors' second moments.

    d * d sums for each task are added up by Spark; what comes to the driver is d * d numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, g in pdf.groupby("dim"):
                x = _unit(g["embedding"])
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pd.DataFrame({"dim": d, "i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "v": s.ravel()})

    rows = vectors.mapInPandas(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, g in rows.groupby("dim"):
        m = np.zeros((d, d))
        m[g["i"], g["j"]] = g["v"]
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def _scaled(vectors: pd.Series | np.ndarray) -> np.ndarray:
    """Vectors in double precision, each times a power of two that brings its largest component near 1: no digit changes."""
    x = np.array(vectors.tolist(), dtype=np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    x = _scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, steps: tuple[int, ...] = (4, 12, 28)) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two turned tiles whose product may reach the threshold."""
    d = a.shape[1]
    cuts = [*[s for s in steps if s < d], d]
    left = lambda x, k: np.sqrt((x[:, k:] ** 2).sum(axis=1))
    dot = a[:, : cuts[0]] @ b[:, : cuts[0]].T
    i, j = np.nonzero(dot + np.outer(left(a, cuts[0]), left(b, cuts[0])) >= threshold - SLACK)
    part = dot[i, j]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if not len(i):
            break
        if len(i) * 4 > a.shape[0] * b.shape[0]:  # most are left: the whole tile at once is cheaper
            part = (a[:, :hi] @ b[:, :hi].T)[i, j]
        else:
            part = part + np.einsum("nd,nd->n", a[i, lo:hi], b[j, lo:hi])
        own = part + left(a, hi)[i] * left(b, hi)[j] >= threshold - SLACK
        i, j, part = i[own], j[own], part[own]
    return i, j


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, tile: int | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Only vectors of one label (not null) and one number of dimensions are compared. A vector that is null, zero, empty or
    has a null or non-finite component, and one with a null vec_id or label, links with nothing: n_links 0, its own
    component, kept. Equal vectors are compared once and counted each. Rows that repeat a vec_id are vectors of their own
    with one name. An empty table gives an empty result; other columns are ignored. tile: vectors of a tile, else as many as
    TILE components make.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    kind = vectors.schema["embedding"].dataType.simpleString()
    if kind not in ("array<float>", "array<double>"):
        kind = "array<double>"
        rows = rows.withColumn("embedding", F.col("embedding").cast(kind))
    small_batches(spark)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("sound", sound)
    good = rows.where("sound").withColumn("dim", F.size("embedding"))
    reps = stash(good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "vectors")
    # A vec_id may name several different vectors: what is compared needs a name of its own.
    reps = reps.withColumn("key", F.xxhash64("rep", "embedding"))
    basis = spark.sparkContext.broadcast(moments(reps))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, g in pdf.groupby("dim"):
                y = _unit(g["embedding"]) @ basis.value[d]
                bin_ = np.clip(((y[:, 0] + 1) * (BINS / 2)).astype(int), 0, BINS - 1).astype(np.int32)
                yield g.assign(bin=bin_, lead=list(y[:, :BOX]))

    turned = stash(reps.mapInPandas(turn, f"label string, dim int, embedding {kind}, rep long, m long, key long, bin int, lead array<double>"), "turned")
    # At most BINS rows for a label: runs of neighbouring bins are tiles, a bin over a tile's size is split.
    size = F.lit(tile) if tile else F.greatest(F.lit(64), F.floor(F.lit(TILE) / F.col("dim")))
    bins = turned.groupBy("label", "dim", "bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label", "dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("label", "dim", "bin", F.floor(before / size).cast("int").alias("run"), F.ceil(F.col("n") / size).cast("int").alias("splits"))
    tiled = turned.join(stash(bins, "bins"), ["label", "dim", "bin"]).withColumn("tile", F.col("run") * 4096 + F.pmod(F.xxhash64("key"), "splits"))
    tiled = stash(tiled.select("label", "dim", "tile", "key", "rep", "m", "lead", "embedding"), "tiles")
    ends = [f(F.get("lead", F.lit(i))).alias(f"{n}{i}") for i in range(BOX) for n, f in (("lo", F.min), ("hi", F.max))]
    tiles = stash(tiled.groupBy("label", "dim", "tile").agg(*ends), "spans")
    one, two = (tiles.select("label", "dim", *[F.col(c).alias(f"{c}_{x}") for c in tiles.columns[2:]]) for x in "ab")
    zero = F.lit(0.0)
    gaps = [F.coalesce(F.greatest(zero, F.col(f"lo{i}_b") - F.col(f"hi{i}_a"), F.col(f"lo{i}_a") - F.col(f"hi{i}_b")), zero) for i in range(BOX)]
    reach = 2 - 2 * threshold + 1e-6  # unit vectors with that cosine are no farther apart, in any coordinates, squared
    near = one.join(two, ["label", "dim"]).where((F.col("tile_a") <= F.col("tile_b")) & (sum((g * g for g in gaps), zero) <= reach))
    pairs = stash(near.select("label", "dim", "tile_a", "tile_b"), "pairs")
    sides = pairs.select("*", F.col("tile_a").alias("tile")).unionByName(pairs.where("tile_a <> tile_b").select("*", F.col("tile_b").alias("tile")))
    dealt = tiled.select("label", "dim", "tile", "key", "m", "embedding").join(sides, ["label", "dim", "tile"])

    def match(g: dict) -> dict | None:
        """Of a pair of tiles: links counted for each vector, and a forest of them."""
        own = g["tile"] == g["tile_a"]
        a = np.flatnonzero(own)
        b = a if own.all() else np.flatnonzero(~own)
        x = _scaled(g["embedding"])
        norm = np.sqrt((x * x).sum(axis=1))
        y = x / norm[:, None] @ basis.value[int(g["dim"][0])]
        found = []
        for lo in range(0, len(a), AT_ONCE):
            rows = a[lo : lo + AT_ONCE]
            others = a[lo:] if b is a else b
            i, j = near_pairs(y[rows], y[others], threshold)
            i, j = rows[i], others[j]
            if b is a:
                i, j = i[i < j], j[i < j]
            link = np.einsum("nd,nd->n", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
            found.append((i[link], j[link]))
        i, j = (np.concatenate(z) for z in zip(*found, strict=True))
        if not len(i):
            return None
        m, key = g["m"], g["key"]
        n = np.zeros(len(m), dtype=np.int64)
        np.add.at(n, i, m[j])
        np.add.at(n, j, m[i])
        sets, forest = Sets(len(m)), []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            if sets.join(p, q):
                forest.append((p, q))
        has = np.flatnonzero(n)
        p, q = np.array(forest).T
        return {"a": np.concatenate([key[has], key[p]]), "b": np.concatenate([key[has], key[q]]), "n": np.concatenate([n[has], np.zeros(len(p), dtype=np.int64)])}

    found = stash(map_runs(dealt, ["dim", "label", "tile_a", "tile_b"], match, "a long, b long, n long"), "found")
    counts = found.where("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    labels = components(found.where("a <> b").select("a", "b")).select(F.col("id").alias("key"), "component")
    named = tiled.select("key", "label", "dim", "rep", "m", "embedding").join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = stash(named.join(counts, "key", "left"), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    answer = named.join(least, "component").select("label", "dim", "embedding", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    answer = stash(answer, "answer")
    discard(turned, tiled, found)
    linked = good.join(answer, ["label", "dim", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
