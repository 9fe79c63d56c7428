import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bomscope.llm.components import components
from bomscope.llm.embedding_dedup import embedding_dedup
from bomscope.llm.exact_dedup import exact_dedup, salted
from bomscope.llm.line_dedup import compare_lines, line_dedup, sets_of
from bomscope.llm.trie_join import Trie, jaccard_join, may_link, parity

DOCS = "doc_id long, text string, n long, id string, key string, component string"


def frame(spark, rows):
    """Documents with other columns, whose names operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], DOCS)


def union_find(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def words(rng, n):
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def mixed_texts(seed=1):
    """Copies, near copies, chains of near copies, a shared passage, empty and blank texts."""
    rng = random.Random(seed)
    out = ["", None, " \n\t ", "one", "ONE", "two words", "two  words"]
    passage = words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.choice([6, 30, 120, 300]))
        out += [" ".join(base)] * rng.choice([1, 1, 3])
        for _ in range(rng.randrange(6)):
            base = base[:]
            base[rng.randrange(len(base))] = "edit" + str(rng.random())
            out.append(" ".join(base))
        out.append(" ".join(words(rng, 200) + passage))
    rng.shuffle(out)
    return list(enumerate(out, 10))


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 300)] + [(7, i) for i in range(400, 600)] + [(5, 5), (900, 800), (800, 900)]
    random.Random(3).shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {k: v for k, v in union_find({x for e in links for x in e}, links).items() if k != 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string").cast("binary")], ids=["sha256", "clashing"])
def test_exact_dedup_compares_whole_texts(spark, digest):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "aa"), (5, None), (6, ""), (7, "a "), (7, "a "), (None, "b"), (None, "cc"), (9, "x" * 200_000), (8, "x" * 200_000)]
    got = sorted(map(tuple, exact_dedup(frame(spark, rows), digest, salts=2).collect()), key=str)
    group = collections.defaultdict(list)
    for i, t in rows:
        group[t or ""].append(i)
    want = []
    for i, t in rows:
        ids = group[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_deals_a_hot_text_to_many_tasks(spark):
    """A third of all rows have one text; salted groups of it stand in several tasks, each of a few rows, joins broadcast or not."""
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"text {i}") for i in range(900)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = frame(spark, rows).repartition(6)
        keyed = docs.select("doc_id", "text", F.sha2("text", 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int").alias("salt"))
        hot = salted(keyed).where("text like 'hot%'").select(F.spark_partition_id().alias("task"), "salt").collect()
        assert len({r.task for r in hot}) > 1 and len(hot) == len({r.salt for r in hot}) == 32
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: (897, 300, i == 897) if i % 3 == 0 else (i, 1, True) for i, _ in rows}


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(s), c) for (i, s), c in zip(sets.items(), union_find(sets, links).values(), strict=True)}


def test_jaccard_join_by_brute_force(spark):
    rows = mixed_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(frame(spark, rows).repartition(3)).collect()}
    assert got == brute_jaccard(rows)
    assert jaccard_join(frame(spark, [])).count() == 0


def test_jaccard_join_of_a_large_group_and_null_ids(spark):
    rng = random.Random(5)
    base = words(rng, 80)
    rows = []
    for i in range(260):  # more than a block
        w = base[:]
        for _ in range(2):
            w[rng.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = jaccard_join(frame(spark, [*rows, (None, " ".join(base)), (None, None)])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_jaccard(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def test_parity_never_loses_a_link_and_the_trie_finds_what_pairs_find():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**62, rng.integers(1, 90), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base, rng.integers(0, 2**62, rng.integers(0, 1 + len(base) // 8), dtype=np.uint64)])) for _ in range(3)]
    link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    n = len(sets)
    own = may_link([parity(s) for s in sets], np.full(n, -1), np.arange(n))
    tree = Trie(sets)
    for i in range(n):
        want = {j for j in range(n) if j != i and link(sets[i], sets[j])}
        assert own[i] or not want
        assert {j for j in tree.near(sets[i], lambda some: False) if j != i} == want


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def test_pairs_of_lines_are_compared_exactly():
    rng = random.Random(12)
    data, want = [], []
    for _ in range(400):
        a = "".join(rng.choices("ab c", k=rng.randrange(1, 60)))
        b = list(a)
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = rng.choice("abé")
        b = "".join(b)
        data += [a.encode(), b.encode()]
        want.append(5 * len(shingles(a) & shingles(b)) >= 4 * len(shingles(a) | shingles(b)))
    sets = sets_of(data)
    got = [bool(compare_lines(sets[k : k + 2], np.array([-1, -1]), np.array([0, 1]))) for k in range(0, len(sets), 2)]
    assert got == want and 50 < sum(want) < 350


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(4)
    lines = []
    for _ in range(12):
        line = " ".join(words(rng, rng.choice([1, 4, 25])))
        lines.append(line)
        lines.append(line.replace(line[len(line) // 2], "#", 1))
    texts = ["\n".join(rng.choices([*lines, "", "  "], k=rng.randrange(1, 9))) for _ in range(25)] + ["", None, "\n", "short"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    out = line_dedup(frame(spark, rows).repartition(3))
    assert out.columns == ["doc_id", "text", "n", "id", "key", "component", "lines_before", "lines_after"]
    order = sorted((i if i is not None else 2**63, t) for i, t in rows if t)
    first = {}
    for i, t in order:
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (i, n))
    keys = list(first)
    like = lambda a, b: 5 * len(shingles(a) & shingles(b)) >= 4 * len(shingles(a) | shingles(b))
    root = union_find(range(len(keys)), [(a, b) for a in range(len(keys)) for b in range(a) if like(keys[a], keys[b])])
    owner = {}
    for k, line in enumerate(keys):
        owner[root[k]] = min(owner.get(root[k], (2**64, 0)), first[line])
    want = []
    for i, t in rows:
        if i is None:
            continue  # equal places of null ids are settled by a hash
        kept = [x for n, x in enumerate((t or "").split("\n")) if not x.strip() or owner[root[keys.index(x)]] == (i, n)]
        want.append((i, None if t is None else "\n".join(kept)))
    assert sorted((r.doc_id, r.text or "") for r in out.collect() if r.doc_id is not None) == sorted((i, t or "") for i, t in want)


def test_short_lines_with_one_edit_are_alike(spark):
    rng = random.Random(9)
    of = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
    rows, pairs = [], []
    for i in range(60):
        a = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(11))[: rng.randrange(50, 78)]
        b = a[:25] + "#" + a[26:]
        assert 5 * len(of(a) & of(b)) >= 4 * len(of(a) | of(b))
        rows += [(2 * i, a), (2 * i + 1, b)]
        pairs.append(2 * i + 1)
    rows += [(1000, "we said that the old mill by the river was empty until winter came"), (1001, "we said that is old mill by the river was empty until winter came")]
    assert 5 * len(of(rows[-1][1]) & of(rows[-2][1])) >= 4 * len(of(rows[-1][1]) | of(rows[-2][1]))
    got = {r.doc_id: r.lines_after for r in line_dedup(frame(spark, rows)).collect()}
    assert {i for i, n in got.items() if n == 0} == {*pairs, 1001}


def test_embedding_dedup_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(160):
        v = rng.standard_normal(12)
        rows.append((i, v.tolist(), i % 3))
        if i % 4 == 0:
            rows.append((1000 + i, (v + rng.standard_normal(12) * 0.11).tolist(), i % 3))
            rows.append((2000 + i, v.tolist(), i % 3))
    rows += [(3000, [1e200 * x for x in rows[0][1]], 0), (3001, [1e-200 * x for x in rows[0][1]], 0)]
    unit = {i: np.array(v) / np.abs(v).max() for i, v, _ in rows}
    odd = [(5000, None, 1), (5001, [0.0] * 12, 1), (5002, [float("nan")] + [1.0] * 11, 1), (5003, [None] + [1.0] * 11, 1), (5004, [float("inf")] * 12, 1), (5005, [1.0] * 12, None), (5006, [], 1), (5007, [1.0] * 5, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), tile=16).collect()}
    links = []
    for a, x, la in rows:
        for b, y, lb in rows:
            if a < b and la == lb and np.dot(unit[a], unit[b]) / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.93:
                links.append((a, b))
    count = collections.Counter(x for e in links for x in e)
    root = union_find([r[0] for r in rows], links)
    want = {i: (count[i], root[i], root[i] == i) for i, _, _ in rows} | {i: (0, i, True) for i, _, _ in odd}
    assert len(links) > 60
    assert got == want
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
