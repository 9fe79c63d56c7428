import random
import zlib

import pytest

import __spark_entry__
import corpus_pipeline
from bomscope.llm.common import stash


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents that each stage must act on, and clean ones."""
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "ter", "ran", "os", "den"], k=rng.choice([1, 2, 3])))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, text(60) + (" grobble snarf zluk" if bad else "")))
        labels.append((i, 1, int(bad)))
    clean = text(300)
    rows += [(1000, clean), (1001, clean + " more"), (1002, "header line of " + "boiler " * 20 + "\n" + text(90)), (1003, "header line of " + "boiler " * 20 + "\n" + text(90))]
    rows += [(1004, text(40) + " mail me@site.example.org now"), (1005, clean), (1006, ""), (1007, None), (1008, text(50) + " grobble zluk snarf")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_do_their_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    toxic = {i for i in range(600) if i % 4 == 0} | {1008}
    assert len(toxic - set(seen["toxicity"])) > 0.95 * len(toxic)
    assert len({i for i in range(600) if i % 4} & set(seen["toxicity"])) > 0.97 * 450
    lines = seen["line_dedup"]
    assert 1005 not in lines and 1000 in lines  # its only line stands in 1000
    assert "boiler" in lines[1002].text and "boiler" not in lines[1003].text and lines[1003].n_chars == len(lines[1003].text)
    assert 1006 in lines and lines[1007].text is None
    assert 1001 not in seen["ngram_jaccard"]
    assert "<email>" in seen["pii"][1004].text and "@" not in seen["pii"][1004].text
    assert set(seen["packing"]) == set(seen["pii"])


def test_run_is_the_stages_one_after_another(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.where("doc_id = 1006").first().ids_crc32 == zlib.crc32(bytes(4))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) >= {"op1_embedding_dedup", "op6_exact_dedup"}
