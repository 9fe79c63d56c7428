"""Odd input: nothing, nulls, ties, repeats, very long texts, hot groups, columns whose names clash."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bomscope.llm import gru
from bomscope.llm.common import shared_dir, stash
from bomscope.llm.line_dedup import line_dedup
from bomscope.llm.linking import LOCAL, linked, shared
from bomscope.llm.masked_lm import fit as fit_lm
from bomscope.llm.masked_lm import score
from bomscope.llm.toxicity import fit, held_out, toxicity
from bomscope.llm.trie_join import jaccard_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id int, spans string, component string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "k", 1, "x", "c") for i, t in rows], DOCS)


def test_masked_model_of_nothing_repeats_and_long_texts(spark):
    none = docs_of(spark, [])
    assert score(none, fit_lm(none, rounds=1)).count() == 0
    long = " ".join(f"w{i % 50}" for i in range(120_000))
    docs = docs_of(spark, [(1, "a b c d"), (1, "a b c d"), (2, long), (3, None), (4, "  ")])
    got = score(docs, fit_lm(docs, rounds=1)).collect()
    same = [r.log_prob for r in got if r.doc_id == 1]
    assert len(got) == 5 and same[0] == same[1] and math.isfinite(same[0])
    assert next(r for r in got if r.doc_id == 2).n_tokens == 120_000
    assert {r.log_prob for r in got if r.doc_id in (3, 4)} == {0.0}


def test_toxicity_without_usable_labels(spark):
    docs = docs_of(spark, [(i, f"some text {i}") for i in range(40)])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for rows in ([], [(1, 0, None), (2, 0, None)], [(i, 0, 0) for i in range(40)], [(None, 0, 1), (999, 0, 1), (3, 0, 0)]):
        assert fit(docs, labels(rows)) is None
    assert {r.score for r in toxicity(docs, None).collect()} == {0.0}
    assert toxicity(docs_of(spark, []), None).count() == 0 and fit(docs_of(spark, []), labels([(1, 0, 1)])) is None


def test_held_out_labels_change_no_score(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["oak", "elm", "ash", "yew"], k=20)) + (" grobble" if i % 3 == 0 else "")) for i in range(200)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert turned.exceptAll(labels).count() > 20
    one, two = fit(docs, labels), fit(docs, turned)
    assert all((one.p[k] == two.p[k]).all() for k in one.p)


def plain_logit(net, x, n):
    """One window's logit, step by step."""
    p, H = net.p, gru.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))

    def walk(x, u, steps):
        h, out = np.zeros(H), {}
        for i in steps:
            hu = h @ u
            z, r = sig(x[i][:H] + hu[:H]), sig(x[i][H : 2 * H] + hu[H : 2 * H])
            h = z * h + (1 - z) * np.tanh(x[i][2 * H :] + r * hu[2 * H :])
            out[i] = h
        return out

    f, b = walk(x[:, : 3 * H], p["uf"], range(n)), walk(x[:, 3 * H :], p["ub"], reversed(range(n)))
    states = [np.concatenate([f[i], b[i]]) for i in range(n)]
    weights = np.exp([np.tanh(s @ p["a"]) @ p["v"] for s in states])
    return sum(w * s for w, s in zip(weights / weights.sum(), states, strict=True)) @ p["o"] + p["c"][0]


def test_the_network_by_plain_loops_and_its_gradients_by_differences():
    rng = np.random.default_rng(4)
    net = gru.Net(["a"])
    sizes = [3, gru.WINDOW, 9]
    x = rng.standard_normal((3, gru.WINDOW, 6 * gru.HIDDEN)).astype(np.float32)
    mask = np.arange(gru.WINDOW)[None, :] < np.array(sizes)[:, None]
    got = net.forward(x, mask)
    assert np.allclose(got, [plain_logit(net, x[i], n) for i, n in enumerate(sizes)], atol=1e-4)
    y, weight = np.array([1, 0, 1], np.float32), np.array([1, 2, 0.5], np.float32)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x, mask).astype(np.float64)))
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    grads, dx, _ = net.gradients(x, mask, y, weight)
    for values, grad in [(net.p[k], grads[k]) for k in ("uf", "ub", "a", "v", "o", "c")] + [(x, dx)]:
        for at in map(tuple, rng.integers(0, values.shape, (6, values.ndim))):
            if values is x and not mask[at[0], at[1]]:
                continue
            old, step = values[at], np.float32(1e-2)
            values[at] = old + step
            up = loss()
            values[at] = old - step
            down = loss()
            values[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * float(step)), rel=0.05, abs=2e-4)


def test_very_long_texts_and_lines(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 300_000), (4, "x" * 300_000), (5, "\n" * 50_000 + "tail of it")]
    docs = docs_of(spark, rows)
    assert {r.doc_id: r.component_id for r in jaccard_join(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    got = {r.doc_id: (r.lines_before, r.lines_after) for r in line_dedup(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (1, 1), 4: (1, 0), 5: (50_001, 50_001)}


def test_lines_of_documents_without_ids(spark):
    line = "the same line of some length stands in all of them"
    rows = [(None, f"{line}\nfirst of {i} has one of its own {i * 7919}") for i in range(6)]
    one, two = (line_dedup(docs_of(spark, rows).repartition(n)) for n in (1, 4))
    got = sorted(r.text for r in one.collect())
    assert got == sorted(r.text for r in two.collect())
    assert sum(line in t for t in got) == 1 and len(got) == 6


def test_line_dedup_finds_what_all_pairs_find(spark):
    """Recall over a whole table: every two lines at 0.8 or more, counted by a matrix of all lines and shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    first = {}
    for i, t in sorted(rows):
        for n, x in enumerate(t.split("\n")):
            if x.strip():
                first.setdefault(x, (i, n))
    keys = list(first)
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in keys]
    number = {s: k for k, s in enumerate(set().union(*sets))}
    matrix = np.zeros((len(keys), len(number)), dtype=np.float32)
    for k, s in enumerate(sets):
        matrix[k, [number[x] for x in s]] = 1
    size = matrix.sum(axis=1)
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for lo in range(0, len(keys), 500):
        both = matrix[lo : lo + 500] @ matrix.T
        for a, b in zip(*np.nonzero(9 * both >= 4 * (size[lo : lo + 500, None] + size[None, :])), strict=True):
            links += b > a + lo
            a, b = root(a + lo), root(b)
            up[max(a, b)] = min(a, b)
    owner = {}
    for k, x in enumerate(keys):
        owner[root(k)] = min(owner.get(root(k), (2**63, 0)), first[x])
    at = {x: k for k, x in enumerate(keys)}
    want = {i: sum(not x.strip() or owner[root(at[x])] == (i, n) for n, x in enumerate(t.split("\n"))) for i, t in rows}
    got = {r.doc_id: r.lines_after for r in line_dedup(docs).collect() if r.doc_id in want}
    assert links > 20
    assert sum(got[i] != want[i] for i in want) <= 0.001 * len(want)


def test_shared_buckets_whatever_the_borders_of_batches(spark):
    """Buckets across batches and tasks, repeated rows, one bucket that a batch alone shows to be large."""
    rng = random.Random(6)
    rows = [(i, 1, [rng.randrange(60) for _ in range(rng.randrange(4))] + [1000 + i]) for i in range(120)]
    rows += [(i, 1, [7000]) for i in range(500, 500 + 3 * LOCAL)] + rows[:30] + [(900, 1, [8000])] * 3
    of = {}
    for i, _, buckets in rows:
        for b in buckets:
            of.setdefault(b, set()).add(i)
    want = {(b, i) for b, ids in of.items() if len(ids) > 1 for i in ids}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for size, tasks in ((3, 4), (200, 1)):
        spark.conf.set(key, size)
        try:
            got = shared(spark.createDataFrame(rows, "id long, size int, buckets array<long>").repartition(tasks)).collect()
        finally:
            spark.conf.unset(key)
        extra = {(r.bucket, r.id) for r in got} - want
        assert want <= {(r.bucket, r.id) for r in got} and not extra


def test_a_hot_bucket_is_not_compared_pair_by_pair(spark):
    """5,000 members of one bucket, all but ten of them alike: rows that are compared stay a small multiple of the members."""
    n, odd = 5000, 10
    counted = spark.sparkContext.accumulator(0)

    def compare(data, side, known):
        counted.add(len(data))
        seen, out = {}, []
        for i, x in enumerate(data):
            j = seen.setdefault(x, i)
            if j != i:
                out.append((j, i))
        return out

    data = lambda i: b"odd%d" % i if i < odd else b"alike"
    rows = spark.createDataFrame([(i, 50, [7]) for i in range(n)], "id long, size int, buckets array<long>").repartition(6)
    payload = stash(spark.createDataFrame([(i, data(i)) for i in range(n)], "id long, data binary"), "payload")
    got = {r.id: r.component for r in linked(rows, lambda ids: payload.join(ids, "id", "left_semi"), compare).collect()}
    assert got == {i: odd for i in range(odd, n)}
    assert counted.value < 4 * n


def test_the_pipeline_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = " ".join(f"some{i}" for i in range(40))
    for name, rows in (("none", []), ("odd", [(1, None), (2, ""), (None, "no id but 1.2.3.4 here"), (None, None), (5, text), (5, text), (6, text + " more"), (7, "a\n\na b"), (8, "only one line")])):
        docs = docs_of(spark, rows)
        columns = docs.columns
        for stage, fn in corpus_pipeline.STAGES:
            docs = stash(fn(spark, docs, str(tmp_path)), stage)
            if stage != "packing":
                assert docs.columns == columns
            if stage == "pii":
                kept = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.count() == len(kept)
        if rows:
            assert (None, "no id but <ip> here") in kept and (1, None) in kept and (2, "") in kept and (6, text + " more") not in kept
            assert sum(i == 5 for i, _ in kept) >= 1


def test_no_local_folder_off_one_machine(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
