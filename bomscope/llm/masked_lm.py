"""Masked pseudo-likelihood: a window network predicts every token from both sides; a document's score is the sum.

The most frequent words of the corpus have ids of their own, all others share ids by hash; both numbers grow with the
square root of the number of distinct words. An id is size * class + member, size the root of the number of ids, and its
probability the product of two softmaxes. A word that shares its id has besides its part of that id's tokens, from the
counts of all words of the corpus, which are joined to the texts by Spark: so every word is predicted, none a bucket.
Training covers every token of the corpus once, in rounds: in each, every task improves the current weights on its share
of the round's documents, and Spark averages them by the number of tokens. Word counts and weights are summed by Spark;
the driver receives the most frequent words, a count for each id and one set of weights a round.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, stash, table, texts
from .shingles import word_hashes

#: LEAST is the smallest size of a softmax; one id in SHARE is shared.
SIDE, LEAST, SHARE = 2, 32, 4
DIM, HIDDEN = 10, 16
ROUNDS, BATCH, RATE = 4, 4096, 0.08


def size_for(distinct: int) -> int:
    """The size of a softmax for so many distinct words: ids of their own for as many as the square root of that."""
    return max(LEAST, math.ceil(math.sqrt(math.sqrt(distinct) * SHARE / (SHARE - 1))))


class WindowNet:
    """P(id | the SIDE ids before and the SIDE after); counts of a square number of ids, the shared ones last."""

    def __init__(self, counts: np.ndarray, seed: int = 11) -> None:
        self.ids, self.size = len(counts), math.isqrt(len(counts))
        self.own = self.ids - self.ids // SHARE
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        n = np.log(counts + 1.0).reshape(-1, self.size)
        total = np.logaddexp.reduce(n, axis=1)
        self.p = {
            "e": make(self.ids + 1, DIM, scale=0.3), "w": make(2 * SIDE * DIM, HIDDEN, scale=0.2), "b": np.zeros(HIDDEN, np.float32),
            "c": make(HIDDEN, self.size, scale=0.05), "cb": (total - np.logaddexp.reduce(total)).astype(np.float32),
            "m": make(self.size, HIDDEN, self.size, scale=0.05), "mb": (n - total[:, None]).astype(np.float32),
        }

    @staticmethod
    def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of logits (ids, n), in place: their exponentials beside the largest of a column, and the sums of these."""
        x -= x.max(axis=0)
        np.exp(x, out=x)
        return x, x.sum(axis=0)

    def log_probs(self, around: np.ndarray, target: np.ndarray, learn: dict | None = None) -> np.ndarray:
        """Log-probabilities of targets in their windows; with learn (squares by weight), one Adagrad step besides.

        Logits stand as (ids, n), so that what goes over the ids of a softmax goes over whole rows; a last column of ones
        beside the hidden values takes the biases.
        """
        p, n, of = self.p, len(target), self.size
        order = np.argsort((target // of).astype(np.uint16), kind="stable")  # sorted by radix
        around, cls, member = around[order], target[order] // of, target[order] % of
        x = p["e"].take(around, axis=0).reshape(n, -1)
        h = np.ones((n, HIDDEN + 1), np.float32)
        np.tanh(x @ p["w"] + p["b"], out=h[:, :-1])
        c, m = np.vstack([p["c"], p["cb"]]), np.concatenate([p["m"], p["mb"][:, None, :]], axis=1)
        edge = np.searchsorted(cls, np.arange(of + 1)).tolist()
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if a < b]
        pm = np.empty((of, n), np.float32)
        for k, a, b in spans:
            pm[:, a:b] = m[k].T @ h[a:b].T
        (pc, sc), (pm, sm) = self._softmax(c.T @ h.T), self._softmax(pm)
        at = np.arange(n)
        out = np.empty(n)
        pick = lambda q, s, which: np.log((q[which, at] / s).astype(np.float64) + 1e-30)
        out[order] = pick(pc, sc, cls) + pick(pm, sm, member)
        if learn is None:
            return out
        pc /= sc * n
        pm /= sm * n
        pc[cls, at] -= np.float32(1 / n)
        pm[member, at] -= np.float32(1 / n)
        gc, gm = h.T @ pc.T, np.zeros_like(m)
        dh = pc.T @ p["c"].T
        for k, a, b in spans:
            gm[k] = h[a:b].T @ pm[:, a:b].T
            dh[a:b] += pm[:, a:b].T @ p["m"][k].T
        h = h[:, :-1]
        dh *= 1 - h * h
        g = {"c": gc[:-1], "cb": gc[-1], "m": gm[:, :-1], "mb": gm[:, -1], "w": x.T @ dh, "b": dh.sum(axis=0)}
        dx, ids = (dh @ p["w"].T).reshape(-1, DIM).T, around.ravel()
        g["e"] = np.stack([np.bincount(ids, d, len(p["e"])) for d in dx], axis=1).astype(np.float32)
        for k, d in g.items():
            learn[k] += d * d
            p[k] -= RATE * d / np.sqrt(learn[k])
        return out


def shared_id(h: np.ndarray, ids: int) -> np.ndarray:
    """The ids of words that have none of their own."""
    shared = ids // SHARE
    return (ids - shared + (h >> np.uint64(7)) % np.uint64(shared)).astype(np.int64)


def windows(hashes: list[np.ndarray], top: np.ndarray, top_ids: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbours, targets, lengths) of documents given by their words' hashes; past the ends is a token of its own."""
    sizes = np.array([len(h) for h in hashes])
    gap = np.full(SIDE, n_ids)
    parts = [gap]
    for h in hashes:
        at = np.minimum(np.searchsorted(top, h), max(0, len(top) - 1))
        ids = shared_id(h, n_ids)
        if len(top):
            ids = np.where(top[at] == h, top_ids[at], ids)
        parts += [ids, gap]
    every = np.concatenate(parts)
    at = np.flatnonzero(every < n_ids)
    around = np.stack([every[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1) if len(at) else np.empty((0, 2 * SIDE), np.int64)
    return around, every[at], sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, n) over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [h for h in word_hashes(pdf["text"].tolist()) if len(h)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"word": h.view(np.int64), "n": n})

    return docs.mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _slices(pdf: pd.DataFrame, n: int = 256) -> Iterator[pd.DataFrame]:
    for i in range(0, len(pdf), n):
        yield pdf.iloc[i : i + n]


class Model(NamedTuple):
    """The net, the sorted hashes and ids of the words that have ids of their own, (word, n) of all words, and for each id
    how often the words that share it occur."""

    net: WindowNet
    hashes: np.ndarray
    ids: np.ndarray
    counts: DataFrame
    shared: np.ndarray


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Train on the documents' texts. Null and empty ones have no words, rows that repeat count each time, and of no words at
    all the model is the untrained net. Averaged weights depend on how the input is split into tasks, as each task improves
    them in its own order; counts don't."""
    docs, spark = texts(docs), docs.sparkSession
    counts = stash(word_counts(docs), "words")
    n_ids = size_for(counts.count()) ** 2
    shared = n_ids // SHARE
    own = n_ids - shared
    top = counts.orderBy(F.desc("n"), "word").limit(own).select("word", "n").toPandas()
    rest = counts.groupBy((own + F.pmod(F.shiftrightunsigned("word", 7), F.lit(shared))).alias("shared")).agg(F.sum("n").alias("n")).toPandas()
    by_id = np.zeros(n_ids)
    by_id[rest["shared"].to_numpy(dtype=np.int64)] = rest["n"].to_numpy(dtype=np.float64)
    words = top["word"].to_numpy(dtype=np.int64).view(np.uint64)
    np.subtract.at(by_id, shared_id(words, n_ids), top["n"].to_numpy(dtype=np.float64))  # these have ids of their own
    sharing = by_id.copy()
    by_id[: len(top)] = top["n"]
    order = np.argsort(words)
    hashes, ids = words[order], order.astype(np.int64)
    net = WindowNet(by_id)
    shapes = {k: v.shape for k, v in net.p.items()}
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(pickle.dumps((net, hashes, ids)))

        def improve(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own, top_, top_ids = pickle.loads(sent.value)
            squares = {k: np.full(v.shape, 1e-4, np.float32) for k, v in own.p.items()}
            seen = 0
            for pdf in batches:
                for part in _slices(pdf):
                    around, target, _ = windows(list(word_hashes(part["text"].tolist())), top_, top_ids, own.ids)
                    turn = np.random.default_rng(len(target)).permutation(len(target))
                    for lo in range(0, len(turn), BATCH):
                        own.log_probs(around[turn[lo : lo + BATCH]], target[turn[lo : lo + BATCH]], squares)
                    seen += len(target)
            if seen:
                flat = np.concatenate([v.ravel() for v in own.p.values()]).astype(np.float64)
                yield pd.DataFrame({"place": np.arange(len(flat)), "value": flat * seen, "seen": float(seen)})

        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r)
        means = some.mapInPandas(improve, "place int, value double, seen double").groupBy("place").agg((F.sum("value") / F.sum("seen")).alias("value")).toPandas()
        if len(means):
            flat = np.empty(len(means), np.float32)
            flat[means["place"]] = means["value"]
            at = 0
            for k, shape in shapes.items():
                size = int(np.prod(shape))
                net.p[k] = flat[at : at + size].reshape(shape)
                at += size
    return Model(net, hashes, ids, counts, sharing)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, log_prob (the sum over all tokens) and mean_log_prob.

    A word that shares its id with words of N tokens, n of them its own, has n / (N + 1) of the id's probability; a word
    that the model's corpus lacks has 1 / (N + 1), for all such words of the id together. A null or empty text has no
    tokens, a sum of 0 and a null mean. Null and repeated doc_ids pass through; other columns are ignored. Rows are
    known by a 64-bit hash of doc_id and text. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.net, model.hashes, model.ids, np.log(model.shared + 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, top, ids, of_shared = pickle.loads(sent.value)
        for pdf in batches:
            for part in _slices(pdf):
                around, target, sizes = windows(list(word_hashes(part["text"].tolist())), top, ids, net.ids)
                logs = np.concatenate([net.log_probs(around[i : i + BATCH], target[i : i + BATCH]) for i in range(0, len(target), BATCH)] or [np.empty(0)])
                end = np.cumsum(sizes)
                per_row = lambda x, end=end, sizes=sizes: (s := np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)]))[end] - s[end - sizes]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "doc_id": part["doc_id"], "n_tokens": sizes, "log_net": per_row(logs - of_shared[target]), "n_sharing": per_row((target >= net.own).astype(np.int64))})

    def sharing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, top, _, _ = pickle.loads(sent.value)
        for pdf in batches:
            for part in _slices(pdf):
                found = list(word_hashes(part["text"].tolist()))
                key, word = np.repeat(part["key"].to_numpy(), [len(h) for h in found]), np.concatenate(found)
                if len(top):
                    rare = top[np.minimum(np.searchsorted(top, word), len(top) - 1)] != word
                    key, word = key[rare], word[rare]
                yield pd.DataFrame({"key": key, "word": word.view(np.int64)})

    keyed = texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = map_rows(keyed, run, "key long, doc_id long, n_tokens long, log_net double, n_sharing long")
    # A count of 1 adds nothing to the sum, so these and unknown words need no partner. Rows that repeat have equal means.
    known = model.counts.where("n > 1")
    parts = keyed.mapInPandas(sharing, "key long, word long").join(known, "word", "left").groupBy("key").agg(F.avg(F.log(F.coalesce("n", F.lit(1)))).alias("part"))
    total = F.col("log_net") + F.col("n_sharing") * F.coalesce("part", F.lit(0.0))
    return rows.join(parts, "key", "left").select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
