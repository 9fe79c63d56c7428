import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bomscope.llm import pii
from bomscope.llm.gru import Scorer, train
from bomscope.llm.masked_lm import fit, score, shared_id, size_for
from bomscope.llm.shingles import word_hashes
from bomscope.llm.toxicity import clean, toxicity

KINDS = ["email", "ip", "card", "phone"]
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = [True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0, 9 <= len(digits) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.@+-() abZ_%é\n", max_size=50))
def test_base_spans_are_the_plain_expressions(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_cards_and_long_runs():
    for t in ("4111 1111 1111 1111", "x4111-1111-1111-1111.", "4111111111111112", "a@b.co@c.de", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "+1 (555) 123-4567."):
        assert pii.base_spans(t) == brute(t)
    assert pii.base_spans("9" * 300_000 + "a" * 300_000 + "@") == []


def test_patterns_discover_what_seeds_stand_in(spark):
    rng = random.Random(2)
    rows = [(i, f"please call me at +1 (555) 010-{1000 + i} today") for i in range(20)]
    rows += [(100, "please call me at 555 010 7777 today"), (101, f"serial number is 555 010 {rng.randrange(1000, 9999)} here"), (102, None), (103, ""), (None, "call me at +1 (555) 010-9999 now"), (100, "please call me at 555 010 7777 today")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, key string, spans string")
    got = [(r.doc_id, [(s.start, s.kind, s.end) for s in r.base], [(s.start, s.kind, s.end) for s in r.spans]) for r in pii.pii(docs).collect()]
    assert len(got) == len(rows)
    by_id = {i: (b, s) for i, b, s in got}
    for i, t in rows:
        assert by_id[i][0] == brute(t or "")
    assert by_id[100][1] == [(18, 3, 30)]
    assert by_id[101] == ([], [])
    hidden = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert hidden[0] == "please call me at <phone> today" and hidden[100] == "please call me at <phone> today" and hidden[102] is None and hidden[101] == rows[21][1]
    assert pii.redact(docs).columns == docs.columns
    assert pii.pii(docs.limit(0)).count() == 0


def plain_discovery(marks):
    """The scoring of patterns and strings once more, in plain loops."""
    edges = set(marks)
    seeds = {(i, k) for _, i, k, s in edges if s}
    by_pattern = {}
    for p, i, k, s in edges:
        by_pattern.setdefault(p, []).append((i, k, s))
    belief = dict.fromkeys(seeds, 1.0)
    for _ in range(pii.TURNS):
        doubt = {}
        for members in by_pattern.values():
            n = len(members)
            if n <= pii.SEEDS:
                continue
            for kind in range(4):
                own = [belief.get((i, k), 0.0) for i, k, _ in members if k == kind]
                if sum(b >= pii.CONFIDENCE for b in own) < pii.SEEDS:
                    continue
                p, z = sum(own) / n, pii.DEVIATIONS
                trust = (p + z * z / (2 * n) - z * math.sqrt(max(0.0, p * (1 - p)) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                if trust >= pii.CONFIDENCE:
                    for i, k, seed in members:
                        if k == kind and not seed:
                            doubt[i, k] = doubt.get((i, k), 1.0) * (1 - min(trust, 0.999))
        belief = {**{x: 1 - d for x, d in doubt.items()}, **dict.fromkeys(seeds, 1.0)}
    return {x for x, b in belief.items() if b >= pii.CONFIDENCE} - seeds


def test_discovery_goes_on_from_what_it_discovered(spark):
    """Seeds stand after "call me at"; strings found there also stand after "fax goes to", where no seed ever does, and
    others stand there alone. Numbers after "serial number" and numbers in mixed company stay."""
    rng = random.Random(13)
    local = lambda i: f"555 01{i // 1000} {i % 1000:04d}"
    rows = [f"please call me at +1 (555) 010-{1000 + i} today" for i in range(300)]
    rows += [f"please call me at {local(i)} today" for i in range(30)]
    rows += [f"his fax goes to {local(i)} now" for i in range(30)]
    rows += [f"his fax goes to {local(5000 + i)} now" for i in range(2)]
    rows += [f"the serial number {local(7000 + i)} broke" for i in range(30)]
    rows += [f"some kind of {local(8000 + i)} mixed" for i in range(5)] + [f"some kind of +1 (555) 020-{1000 + i} mixed" for i in range(5)]
    rows += [" ".join(rng.choices(["oak", "elm", "ash"], k=4)) + f" 4{i:015d} " + rng.choice(["oak", "elm"]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    marks = [(m.pattern, m.instance, m.kind, m.seed) for r in pii.find(docs).collect() for m in r.marks]
    want = plain_discovery(marks)
    got = {(r.instance, r.kind) for r in pii.discover(spark.createDataFrame(marks, "pattern long, instance long, kind int, seed boolean")).collect()}
    assert got == want
    added = {r.doc_id: len(r.spans) - len(r.base) for r in pii.pii(docs).collect()}
    assert {i for i, n in added.items() if n} == set(range(300, 362))


def test_patterns_reach_over_wide_blanks_and_long_words(spark):
    for gap in (" ", " " * 63, "\n" + " " * 500, "\t" * 5000):
        for long in ("at", "w" * 61, "w" * 3000):
            text = f"some please{gap}{long}{gap}1 555{gap}{long}{gap}end"
            a = text.index("1 555")
            assert pii.words_before(text, a) == text[:a].split()[-2:] and pii.word_after(text, a + 5) == text[a + 5 :].split()[:1]
            assert pii.patterns(text, a, a + 5) == pii.patterns(f"please {long} 1 555 {long}", 8 + len(long), 13 + len(long))
    assert pii.words_before("", 0) == pii.words_before("   ", 3) == pii.word_after(" " * 100, 1) == []
    wide = " " * 90
    rows = [(i, f"please call{wide}+1 (555) 010-{1000 + i}{wide}today") for i in range(20)] + [(100, f"please call{wide}555 010 7777{wide}today")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [(101, pii.PHONE, 113)]


def labelled(seed, n):
    rng = random.Random(seed)
    stems = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "ran", "os") for b in ("den", "vel", "tis", "mor", "ra")]
    out = []
    for i in range(n):
        ws = ["".join(rng.choices(stems, k=rng.choice([1, 1, 2]))) for _ in range(rng.randrange(3, 120))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(rng.choice([1, 2, 4])):
                ws.insert(rng.randrange(len(ws)), rng.choice(["grobble", "snarfs", "zlukden", "zlukra", "zlukvel", "zluktis"]))
        out.append((" ".join(ws), y))
    return out


@pytest.fixture(scope="module")
def net():
    some = labelled(1, 500)
    return train([t for t, _ in some], [y for _, y in some], rounds=4)


def test_the_network_learns_words_and_spellings(net):
    held = labelled(2, 300)
    p = Scorer(net).score([t for t, _ in held]) >= 0.3
    y = np.array([y for _, y in held], dtype=bool)
    assert (p == y).mean() > 0.95
    unseen = Scorer(net).score(["kaden zlukmor mira", "kaden lovel mira"])
    assert unseen[0] > unseen[1]


def test_scores_of_all_windows_and_odd_texts(spark, net):
    long = "kaden " * 5000
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, long + "grobble snarfs"), (5, "kaden"), (None, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = [tuple(r) for r in toxicity(docs, net).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    assert [s for i, s in got if i in (1, 2, 3)] == [0, 0, 0]
    assert got[4][1] > 0.3 > got[3][1]
    kept = clean(docs, net)
    assert kept.columns == docs.columns and 6 == kept.count()
    assert {s for _, s in toxicity(docs, None).collect()} == {0.0}
    assert train(["a", "b"], [1, 1]) is None


def test_masked_model_prefers_the_corpus_to_shuffled_words(spark):
    rng = random.Random(3)
    follows = {w: rng.choices(range(40), k=2) for w in range(40)}
    texts = []
    for _ in range(300):
        w, out = rng.randrange(40), []
        for _ in range(80):
            out.append(f"t{w}")
            w = rng.choice(follows[w])
        texts.append(" ".join(out))
    docs = spark.createDataFrame(list(enumerate(texts[:250])), "doc_id long, text string")
    model = fit(docs, rounds=2)
    shuffled = [" ".join(rng.sample(t.split(), 80)) for t in texts[250:]]
    rows = list(enumerate(texts[250:])) + list(enumerate(shuffled, 100)) + [(200, None), (201, ""), (None, "t1 t2")]
    got = {r.doc_id: r for r in score(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int"), model).collect()}
    assert sum(got[i].log_prob > got[100 + i].log_prob for i in range(50)) > 45
    assert got[200].log_prob == got[201].log_prob == 0 and got[200].mean_log_prob is None and got[None].n_tokens == 2
    assert abs(got[0].mean_log_prob * 80 - got[0].log_prob) < 1e-6


def test_masked_model_tells_words_of_a_shared_id_apart(spark):
    rng = random.Random(4)
    rare = [f"r{i}" for i in range(1500)]
    docs = [(i, " ".join(rng.choices(["a", "b", "c"], k=30) + rng.choices(rare, weights=range(1, 1501), k=30))) for i in range(800)]
    model = fit(spark.createDataFrame(docs, "doc_id long, text string"), rounds=1)
    n = {w: sum(t.split().count(w) for _, t in docs) for w in rare}
    names = [w for w in rare if n[w]] + ["unseen"]
    by_id = {}
    for w, h in zip(names, word_hashes(names), strict=True):
        if h[0] not in model.hashes:
            by_id.setdefault(int(shared_id(h, model.net.ids)[0]), []).append(w)
    ws = next(ws for ws in by_id.values() if len({n.get(w, 0) for w in ws}) > 2)
    got = {r.doc_id: r.log_prob for r in score(spark.createDataFrame([(i, f"a {w} b") for i, w in enumerate(ws)], "doc_id long, text string"), model).collect()}
    for i, w in enumerate(ws):
        assert got[i] - got[0] == pytest.approx(math.log(max(1, n.get(w, 1))) - math.log(max(1, n.get(ws[0], 1))), abs=1e-4)
    for k, ws in by_id.items():
        assert model.shared[k] == sum(n.get(w, 0) for w in ws)


def test_the_masked_models_ids_follow_the_corpus():
    assert size_for(500_000) == 32 and size_for(4_000_000) > 50 and size_for(60_000_000) > 100


def test_digest_of_no_spans(spark):
    from bomscope.llm.pii import as_text

    df = pii.pii(spark.createDataFrame([(1, "a@b.co 1.2.3.4")], "doc_id long, text string"))
    assert df.select(as_text("spans")).first()[0] == "email:0:6,ip:7:14"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
