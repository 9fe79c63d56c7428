import os
import random

import numpy as np
import pyspark
from pyspark.sql import functions as F

from bomscope.llm import common, linking, packing, toxicity
from bomscope.llm.common import stash
from bomscope.llm.line_dedup import BANDS, Line, bands, brief_of, compare_lines, may_link_brief, sets_of
from bomscope.llm.linking import linked, shared


def random_line(rng, n=120):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def test_unlike_lines_of_a_bucket_go_no_further(spark):
    """400 lines, each in a bucket with an unlike one; every tenth also with a near copy of itself. Only those are passed on."""
    rng = random.Random(8)
    lines, buckets, want = [], [], set()
    for i in range(400):
        lines.append(random_line(rng))
        buckets.append([10_000 + i // 2] + [20_000 + 100 * i + k for k in range(BANDS - 1)])
    for i in range(0, 400, 10):
        want |= {i, len(lines)}
        lines.append(lines[i][:60] + "#" + lines[i][61:])
        buckets.append([30_000 + 100 * i] + buckets[i][1:])
    sketch = [x.tobytes() for x in bands(lines)[1]]
    rows = [([i], buckets[i], [sketch[i]]) for i in range(len(lines))]
    packed = spark.createDataFrame(rows, "id array<long>, buckets array<long>, sketch array<binary>").repartition(3)
    got = shared(packed, (brief_of, may_link_brief)).collect()
    assert {r.id for r in got} == want
    # The same members have the same name in every bucket.
    assert len({(r.bucket, r.id) for r in got}) == len(want)


def test_pairs_that_parities_tell_apart_are_not_compared(monkeypatch):
    rng = random.Random(3)
    data = [random_line(rng).encode() for _ in range(60)]
    data += [x[:50] + b"#" + x[51:] for x in data[:20]]
    calls, overlap = [], Line.overlap
    monkeypatch.setattr(Line, "overlap", lambda a, b: calls.append(1) or overlap(a, b))
    got = compare_lines(sets_of(data), np.full(80, -1), np.arange(80))
    assert {tuple(sorted(x)) for x in got} == {(i, 60 + i) for i in range(20)}
    assert len(calls) == 20


def test_what_many_buckets_have_in_common_is_compared_once(spark):
    """0 and 1 share 40 buckets, each with another third member; their sketches leave a link possible, their data doesn't."""
    counted = spark.sparkContext.accumulator(0)

    def compare(data, side, known):
        counted.add(len(data))
        return []

    def may(sketches, side, known):
        x = np.array(sketches)
        return (x[:, None] == x[None, :]) & (known[:, None] != known[None, :])

    buckets = list(range(40))
    rows = spark.createDataFrame([(0, 50, buckets), (1, 50, buckets), *((100 + b, 50, [b]) for b in buckets)], "id long, size int, buckets array<long>")
    sketches = stash(rows.select("id", F.when(F.col("id") < 2, F.lit("a")).otherwise(F.col("id").cast("string")).cast("binary").alias("sketch")), "sketches")
    payload = stash(rows.select("id", F.col("id").cast("string").cast("binary").alias("data")), "payload")
    got = linked(rows, lambda ids: payload.join(ids, "id", "left_semi"), compare, sketches=sketches, may=may).collect()
    assert got == []
    assert 2 <= counted.value <= 4


def test_links_are_written_before_they_are_joined(spark, monkeypatch):
    """A task with two Python operators in a row takes two workers, and they stay: components() reads files."""
    rng = random.Random(5)
    lines = [random_line(rng) for _ in range(12)]
    lines += [x[:60] + "#" + x[61:] for x in lines[:4]]
    signed = spark.createDataFrame([(i, 1, [7]) for i in range(len(lines))], "id long, size int, buckets array<long>")
    payload = spark.createDataFrame([(i, x.encode()) for i, x in enumerate(lines)], "id long, data binary")
    plans, components = [], linking.components
    monkeypatch.setattr(linking, "components", lambda e: plans.append(e._jdf.queryExecution().executedPlan().toString()) or components(e))
    found = linked(signed, lambda ids: payload.join(ids, "id", "left_semi"), compare_lines, block=3, prepare=sets_of)
    assert {(r.id, r.component) for r in found.collect()} == {(i, i % 12) for i in (0, 1, 2, 3, 12, 13, 14, 15)}
    assert len(plans) > 1 and not any("MapIn" in p for p in plans)


def test_small_tables_of_the_driver_need_no_workers_of_another_kind(spark, monkeypatch):
    """Those of RDDs, which a list that becomes a table is."""
    texts = [f"good words number {i}" if i % 2 else f"awful nasty thing {i}" for i in range(60)]
    docs = stash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    labels = stash(spark.createDataFrame([(i, i % 2 ^ 1) for i in range(60)], "doc_id long, toxic int"), "labels")
    rows = stash(docs.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("doc_id") % 3).alias("length"), F.lit(5).cast("long").alias("ids_crc32")), "rows")

    def parallelize(*_args):
        raise AssertionError

    monkeypatch.setattr(pyspark.SparkContext, "parallelize", parallelize)
    assert toxicity.fit(docs, labels) is not None and toxicity.fit(docs, labels.where("doc_id < 0")) is None
    got = sorted((r.length, r.rank) for r in packing._number(rows, {0: 20, 1: 20, 2: 20}).collect())
    assert got == [(k, i) for k in range(3) for i in range(20)]


def test_written_tables_make_one_file_a_task(spark):
    """And no checksums beside it, for each of which a process would be started too."""
    out = stash(spark.range(0, 100, 1, 5), "files")
    assert out.count() == 100
    names = os.listdir(out._stash_path.removeprefix("file://"))
    assert sorted(x.rpartition(".")[2] for x in names) == ["_SUCCESS"] + ["parquet"] * 5


def test_the_driver_holds_no_texts_to_learn_from(spark, monkeypatch):
    """A task trains on the sample, in the order of its ids, ones first; rows that repeat an id by their text."""
    texts = {i: f"{'awful' if i % 2 == 0 else 'good'} text {i}" for i in range(60)}
    docs = spark.createDataFrame([*texts.items(), (8, "another"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 ^ 1) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TRAIN_ONES", 9)
    monkeypatch.setattr(toxicity, "train", lambda texts, ys: (os.getpid(), texts, ys))
    pid, got, ys = toxicity.fit(docs.repartition(5), labels)
    assert pid != os.getpid()
    kept = labels.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", F.xxhash64("doc_id").alias("place")).collect()
    by_place = [r.doc_id for r in sorted(kept, key=lambda r: r.place)]
    said = lambda i: sorted([texts[i], *(["another"] if i == 8 else []), *([""] if i == 7 else [])])
    ones, zeros = ([t for i in by_place if i % 2 == k for t in said(i)] for k in (0, 1))
    assert (got, ys) == (ones[:9] + zeros, [1] * 9 + [0] * len(zeros))


def test_memory_that_the_driver_has_freed_goes_back(spark, monkeypatch):
    """Tables are discarded again and again; what compilers and buffers took meanwhile is not kept."""
    calls, give_back = [], common.give_back
    monkeypatch.setattr(common, "give_back", lambda spark: calls.append(give_back(spark)))
    common.discard(stash(spark.range(3), "gone"))
    version = spark._jvm.java.lang.Runtime.version()
    assert calls == [(version.feature(), version.interim(), version.update()) >= (17, 0, 9)]
    common.discard(None)
    assert len(calls) == 1
