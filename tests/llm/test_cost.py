"""Work that the CPU budgets depend on, beside a plain way of doing it on the same machine, and the same results."""

import os
import subprocess
import sys
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from bomscope.llm import components as components_of
from bomscope.llm import line_dedup, linking
from bomscope.llm.components import components
from bomscope.llm.gru import WINDOW, Net, Scorer
from bomscope.llm.masked_lm import DIM, HIDDEN, RATE, SIDE, WindowNet
from bomscope.llm.shingles import _BASE, _BYTE, mix, word_hashes


def least(*works, turns=7):
    """CPU seconds of each piece of work, the least of some turns taken one after another."""
    took = [[] for _ in works]
    for _ in range(turns):
        for t, work in zip(took, works, strict=True):
            began = time.process_time()
            work()
            t.append(time.process_time() - began)
    return [min(t) for t in took]


def plain_step(net, around, target, squares):
    """One training step, softmax by softmax, row by row of logits."""

    def softmax(x):
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    p, n = net.p, len(target)
    order = np.argsort(target // net.size, kind="stable")
    around, cls, member = around[order], target[order] // net.size, target[order] % net.size
    x = p["e"][around].reshape(n, -1)
    h = np.tanh(x @ p["w"] + p["b"])
    pc, pm = softmax(h @ p["c"] + p["cb"]), np.empty((n, net.size), np.float32)
    edge = np.searchsorted(cls, np.arange(net.size + 1))
    of = [slice(a, b) for a, b in zip(edge, edge[1:], strict=False)]
    for k, own in enumerate(of):
        if own.start < own.stop:
            pm[own] = softmax(h[own] @ p["m"][k] + p["mb"][k])
    at, out = np.arange(n), np.empty(n)
    out[order] = np.log(pc[at, cls].astype(np.float64)) + np.log(pm[at, member].astype(np.float64))
    pc[at, cls] -= 1
    pm[at, member] -= 1
    pc, pm = pc / n, pm / n
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["c"], g["cb"], dh = h.T @ pc, pc.sum(axis=0), pc @ p["c"].T
    for k, own in enumerate(of):
        if own.start < own.stop:
            g["m"][k], g["mb"][k] = h[own].T @ pm[own], pm[own].sum(axis=0)
            dh[own] += pm[own] @ p["m"][k].T
    dh *= 1 - h * h
    g["w"], g["b"] = x.T @ dh, dh.sum(axis=0)
    ids, dx = around.ravel(), (dh @ p["w"].T).reshape(-1, DIM)
    order = np.argsort(ids, kind="stable")
    some, first = np.unique(ids[order], return_index=True)
    g["e"][some] = np.add.reduceat(dx[order], first, axis=0)
    for k, d in g.items():
        squares[k] += d * d
        p[k] -= RATE * d / np.sqrt(squares[k])
    return out


def nets(n, size, seed=1):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 1000, size * size).astype(np.float64))[::-1]
    around, target = rng.integers(0, size * size + 1, (n, 2 * SIDE)), rng.integers(0, size * size, n)
    made = [WindowNet(counts), WindowNet(counts)]
    return made, [{k: np.full(v.shape, 1e-4, np.float32) for k, v in x.p.items()} for x in made], around, target


def test_masked_models_steps_are_the_plain_ones():
    for n, size in ((1, 32), (7, 32), (3000, 33)):
        (one, two), (a, b), around, target = nets(n, size)
        assert one.p["w"].shape == (2 * SIDE * DIM, HIDDEN)
        before = one.log_probs(around, target)
        for turn in range(3):
            got, want = one.log_probs(around, target, a), plain_step(two, around, target, b)
            np.testing.assert_allclose(got, want, rtol=2e-3, atol=2e-3)
            assert turn or np.allclose(got, before)
        for k in one.p:
            # Adagrad's first steps go by the sign of a gradient, however small.
            assert np.mean(np.abs(one.p[k] - two.p[k]) > 1e-3) < 0.01, k


def step_costs():
    (one, two), (a, b), around, target = nets(4096, 51)
    print(*least(lambda: one.log_probs(around, target, a), lambda: plain_step(two, around, target, b)))


def test_masked_models_step_costs_less_than_softmax_by_softmax():
    """On one thread, as a worker has."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYTHONPATH": root}
    said = subprocess.run([sys.executable, "-c", "from tests.llm.test_cost import step_costs; step_costs()"], env=env, cwd=root, capture_output=True, text=True, check=True).stdout
    own, plain = map(float, said.split())
    assert own < 0.8 * plain, (own, plain)


def by_bytes(word):
    return mix(np.array([sum(int(_BYTE[c]) * pow(int(_BASE), i, 1 << 64) for i, c in enumerate(word)) % (1 << 64) ^ len(word)], dtype=np.uint64))[0]


def test_word_hashes_are_sums_over_the_bytes_of_each_word():
    for text in ("", " \t", "a", " A b\x0bcd\x1fe\r\n", "é ü" * 9, "x" * 3000 + " y"):
        data = text.encode().lower()
        for c in b"\t\n\x0b\x0c\r":
            data = data.replace(bytes([c]), b" ")
        (got,) = word_hashes([text])
        assert got.tolist() == [by_bytes(w) for w in data.split(b" ") if w]


def test_scoring_many_new_words_at_once_takes_bounded_memory():
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(10**8, 10**9, 150).tolist())) for _ in range(400)]
    texts += ["", " \n", "one " * (3 * WINDOW), "x" * 300_000, *texts[:3]]
    net = Net(["one", "two"])
    tracemalloc.start()
    try:
        scorer = Scorer(net)
        got = scorer.score(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 45e6
    small = Scorer(net, 500)  # emptied again and again, and fewer places than one text has words
    np.testing.assert_allclose(got, [small.score([t])[0] for t in texts], rtol=1e-5, atol=1e-6)
    many = " ".join(map(str, range(25_000)))
    np.testing.assert_allclose(small.score([many, texts[0]]), Scorer(net).score([many, texts[0]]), rtol=1e-5, atol=1e-6)
    assert scorer.score([]).tolist() == [] and got[400] == got[401] == 0


def test_components_of_few_links_are_joined_without_shuffling(spark):
    """Whatever Spark itself would broadcast."""
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(-5, 2000), (3000, 3000)]
    want = {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)} | {-5: -5, 2000: -5}
    edges = spark.createDataFrame(links, "a long, b long").repartition(2)
    key = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = components(edges)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {r.id: r.component for r in got.collect()}
    finally:
        spark.conf.set(key, kept)
    assert found == want
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    """And those of many take rounds, which give the same."""
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1050)] + [(-5, 2000), (3000, 3000), (2**60, -(2**60))]
    want = {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1050)} | {-5: -5, 2000: -5, 2**60: -(2**60), -(2**60): -(2**60)}
    edges = spark.createDataFrame(links, "a long, b long").repartition(3)
    for most in (components_of.TOGETHER, 0):
        tags, written = [], components_of.stash
        monkeypatch.setattr(components_of, "TOGETHER", most)
        monkeypatch.setattr(components_of, "stash", lambda df, tag, to=written, tags=tags: tags.append(tag) or to(df, tag))
        assert {r.id: r.component for r in components(edges).collect()} == want
        assert ("map" in tags) == (most == 0), tags
        monkeypatch.undo()


def test_hashes_of_lines_by_plain_loops_and_at_less_cost():
    rng = np.random.default_rng(2)
    words = [chr(c) for c in rng.integers(97, 123, 400)] + ["é", "\U0001f600"]
    lines = ["".join(rng.choice(words, n)) for n in rng.integers(1, 700, 400)] + ["", "abcd", "abcde", "\ud800x"]

    def plain(lines):
        h, count = line_dedup.hashed(lines)
        h = (h >> np.uint64(32)).astype(np.uint32)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        out, some = np.empty((len(lines), line_dedup.BANDS), dtype=np.uint64), np.zeros((len(lines), 64), dtype=np.uint8)
        for b in range(line_dedup.BANDS):
            key = np.full(len(lines), np.uint64(b + 1))
            for r in range(b * line_dedup.ROWS, (b + 1) * line_dedup.ROWS):
                low = np.minimum.reduceat(h * line_dedup._A[r], first)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
                some[:, r] = (low * np.uint32(0x9E3779B1)) >> np.uint32(28)
            out[:, b] = key
        return out, some[:, ::2] << 4 | some[:, 1::2]

    for got, want in zip(line_dedup.bands(lines), plain(lines), strict=True):
        assert (got == want).all()
    assert [tuple(x) for x in line_dedup.ids_of(lines).tolist()] == [line_dedup.line_ids(x) for x in lines]
    many = lines * 20
    own, slow = least(lambda: line_dedup.ids_of(many), lambda: [line_dedup.line_ids(x) for x in many])
    assert own < 0.9 * slow, (own, slow)


def test_briefs_of_pairs_are_those_of_larger_groups_at_less_cost():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 256, (30_000, 3, 13), dtype=np.uint8)
    x[::5, 1, :11] = x[::5, 0, :11]
    pairs = np.ascontiguousarray(x[:, :2])
    want = line_dedup.may_link_brief(x)[:, :2, :2]
    got = line_dedup.may_link_brief(pairs)
    assert (got == want).all() and got[::5, 0, 1].sum() > 100 and not got.all()

    def both_ways():
        wide = np.zeros((len(pairs), 2, 16), dtype=np.uint8)
        wide[..., :13] = pairs
        wide = wide.view(np.uint64)
        differ = np.zeros((len(pairs), 2, 2), dtype=np.uint8)
        for k in range(2):
            d = wide[:, :, None, k] ^ wide[:, None, :, k]
            differ += np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555))
        return differ <= line_dedup.BANDS * line_dedup.ROWS - line_dedup.LEAST_BRIEF

    own, slow = least(lambda: line_dedup.may_link_brief(pairs), both_ways)
    assert own < 0.9 * slow, (own, slow)


def test_bytes_of_binary_values_are_read_in_place():
    for kind in (pa.binary(), pa.large_binary()):
        values = pa.array([b"abcd", b"efgh", b"ijkl", b"mnop"], kind)
        assert linking._bytes_of(values[1:3]).tobytes() == b"efghijkl" and linking._bytes_of(values).shape == (4, 4)
