"""Personal data by bootstrapped contextual extraction.

Seeds are what four plain expressions find. The words around a string of an identifier's shape, and that shape, make its
lexical patterns. Spark scores the bipartite graph of patterns and strings in turns: a pattern is worth the share of its
strings that are believed, reckoned cautiously when they are few, and needs several such strings; patterns of high
confidence make the other strings in them believed. A string believed in one turn induces and supports the patterns of
all its other places in the next, so that what no seed ever stood in is reached too. Seeds always stay. Text is read in
one pass; all that follows works on the few strings that look like identifiers.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, parts, stash, table, texts

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Distinct believed strings a pattern must have, the confidence that patterns and strings must reach, the number of
#: standard deviations by which a share counts as lower than it was met, and turns of scoring.
SEEDS, CONFIDENCE, DEVIATIONS, TURNS = 3, 0.75, 2.0, 4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9@]\S*+")
_NUMBER = re.compile(r"[0-9().\-/]+\Z")
_TRIM = ".,;:!?\"'<>[]{}"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap, found from each @ outwards, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain expressions' matches; those that fail their check are dropped without another try."""
    if not _SOME.search(text):
        return []
    out = [(a, EMAIL, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), PHONE, m.end()))
    out.sort()
    return out


def shape(s: str) -> int | None:
    """The kind that a string outside the plain expressions could be."""
    digits = sum(c.isdigit() for c in s)
    if "@" in s:
        return EMAIL if len(s) > 3 else None
    if s.count(":") >= 3 and all(c in "0123456789abcdefABCDEF:." for c in s):
        return IP
    if not _NUMBER.match(s.replace(" ", "")):
        return None
    if s.count(".") == 3 and not any(c in s for c in " ()-/"):
        return IP
    if 12 <= digits <= 19 and not any(c in s for c in "()./"):
        return CARD
    return PHONE if 7 <= digits <= 15 else None


def others(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings of an identifier's shape that overlap no base span; numbers that blanks part are one string."""
    out: list[tuple[int, int, int]] = []
    end, held = 0, None
    parts: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        number = _NUMBER.match(text[start:end].strip(_TRIM)) is not None
        if number and held and text[held[1] : start] == " ":
            held = (held[0], end)
            parts[-1] = held
        else:
            parts.append((start, end))
            held = (start, end) if number else None
    taken = sorted((x, y) for x, _, y in base)
    ends = list(accumulate((y for _, y in taken), max))
    for a, b in parts:
        before = bisect_left(taken, (b,))  # base spans that start before b; the farthest end of them
        if before and ends[before - 1] > a:
            continue
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        kind = shape(text[a:b])
        if kind is not None:
            out.append((a, kind, b))
    return out


def words_before(text: str, a: int) -> list[str]:
    """The two whole words that end nearest before a, as far off as they are (fewer at the start of the text)."""
    n = 64
    while True:
        low = max(0, a - n)
        words = text[low:a].split()
        if low == 0 or len(words) > 2 or len(words) == 2 and text[low].isspace():
            return words[-2:]
        n *= 4


def word_after(text: str, b: int) -> list[str]:
    """The whole word that begins nearest after b, if there is one."""
    n = 48
    while True:
        words = text[b : b + n].split()
        if b + n >= len(text) or len(words) > 1 or len(words) == 1 and text[b + n - 1].isspace():
            return words[:1]
        n *= 4


def outline(said: str) -> str:
    """A string's shape: digits as 9, runs of letters as a, all else as it is."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", said))


def patterns(text: str, a: int, b: int) -> list[int]:
    """Hashes of the lexical patterns around text[a:b]: the two words before it; the word on each side; one of these with
    its shape."""
    left, right = [w.lower() for w in words_before(text, a)], [w.lower() for w in word_after(text, b)]
    shape_ = outline(text[a:b])
    out = []
    if len(left) == 2:
        out.append(f"two {left[0]} {left[1]}")
    if left and right:
        out.append(f"sides {left[-1]} {right[0]}")
    if left:
        out.append(f"left {left[-1]} {shape_}")
    if right:
        out.append(f"right {right[0]} {shape_}")
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) - 2**63 for p in out]


SPAN = "struct<start:int,kind:int,end:int>"
MARK = "struct<pattern:long,instance:long,start:int,kind:int,end:int,seed:boolean>"


def find(docs: DataFrame) -> DataFrame:
    """Per row: key (hash of doc_id and text), doc_id, base spans, and marks: strings in patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            bases, marks = [], []
            for text in pdf["text"]:
                base = base_spans(text)
                own = []
                for seed, spans in ((True, base), (False, others(text, base) if _SOME.search(text) else [])):
                    for a, kind, b in spans:
                        name = xxhash.xxh3_64_intdigest(text[a:b].lower().encode("utf-8", "surrogatepass")) - 2**63
                        own += [(p, name, a, kind, b, seed) for p in patterns(text, a, b)]
                bases.append(base)
                marks.append(own)
            yield pd.DataFrame({"key": pdf["key"], "doc_id": pdf["doc_id"], "base": bases, "marks": marks})

    keyed = texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    return map_rows(keyed, run, f"key long, doc_id long, base array<{SPAN}>, marks array<{MARK}>")


def cautious(share: Column, n: Column) -> Column:
    """The least share that n cases of which that share is believed still make likely (a score interval's lower end)."""
    z = DEVIATIONS
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - z * spread) / (1 + z * z / n)


def discover(marks: DataFrame) -> DataFrame:
    """marks(pattern, instance, kind, seed) -> (instance, kind) of the strings that are believed without being seeds."""
    edges = marks.groupBy("pattern", "instance", "kind", "seed").agg(F.count("*").alias("n")).drop("n")
    edges = stash(edges, "edges")
    # A pattern of fewer strings can never be trusted in any turn, one of seeds alone discovers nothing; few others are left.
    able = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(~F.col("seed")).alias("new")).where(f"n > {SEEDS}").select("pattern", "n", "new")
    live = stash(edges.join(stash(able.select("pattern"), "able"), "pattern", "left_semi"), "live")
    seeds = stash(live.where("seed").select("instance", "kind", F.lit(1.0).alias("belief")).distinct(), "belief")
    belief, trust = seeds, None
    for _ in range(TURNS):
        known = live.join(belief, ["instance", "kind"], "left").withColumn("belief", F.coalesce("belief", F.lit(0.0)))
        # Every string of a pattern counts against it, those of other kinds too.
        own = [F.sum(F.when(F.col("kind") == k, F.col("belief")).otherwise(0.0)).alias(f"sure{k}") for k in range(len(KINDS))]
        own += [F.count_if((F.col("kind") == k) & (F.col("belief") >= CONFIDENCE)).alias(f"seeds{k}") for k in range(len(KINDS))]
        per = known.groupBy("pattern").agg(F.count("*").alias("n"), *own)
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"sure{k}").alias("sure"), F.col(f"seeds{k}").alias("seeds")) for k in range(len(KINDS))])
        per = per.select("pattern", "n", F.explode(kinds).alias("k")).where(F.col("k.seeds") >= SEEDS)
        per = per.select("pattern", F.col("k.kind").alias("kind"), cautious(F.col("k.sure") / F.col("n"), F.col("n")).alias("trust"))
        old, trust = trust, stash(per.where(F.col("trust") >= CONFIDENCE), "trust")
        doubt = live.where("not seed").join(trust, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))).alias("doubt"))
        last, belief = belief, stash(seeds.unionByName(doubt.select("instance", "kind", (1 - F.exp("doubt")).alias("belief"))).groupBy("instance", "kind").agg(F.max("belief").alias("belief")), "belief")
        discard(old, last if last is not seeds else None)
    sure = stash(belief.where(F.col("belief") >= CONFIDENCE).select("instance", "kind").join(seeds, ["instance", "kind"], "left_anti"), "sure")
    discard(edges, live, seeds, belief, trust)
    return sure


def pii(docs: DataFrame) -> DataFrame:
    """Per row: key, doc_id, base and spans, arrays of (start, kind number, end) by start, then kind, in code points, end exclusive.

    Null and empty texts have none. Rows that repeat share their spans; null doc_ids pass through. An added span overlaps
    no base span; a string that is believed is added wherever it stands. An empty table gives an empty result; other
    columns are ignored. Rows are known by doc_id and a 64-bit hash of doc_id and text.
    """
    rows = stash(find(docs), "found")
    marks = rows.select("key", "doc_id", F.explode("marks").alias("m")).select("key", "doc_id", "m.*")
    sure = discover(marks.select("pattern", "instance", "kind", "seed"))
    found = marks.where("not seed").join(sure, ["instance", "kind"], "left_semi")
    extra = found.groupBy("key", "doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("extra"))  # spans of one document
    extra = stash(extra.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "extra"), "extra")
    none = F.array().cast(f"array<{SPAN}>")
    out = rows.join(extra, F.expr("key = k and doc_id <=> d"), "left").select("key", "doc_id", "base", F.coalesce("extra", none).alias("extra"))
    return out.select("key", "doc_id", "base", F.array_sort(F.concat("base", "extra")).alias("spans"))


def as_text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The input's rows and columns, every span found replaced by its kind in angle brackets (overlapping spans by the first's).

    Null and empty texts stay as they are, rows that repeat are all redacted alike, null ids too; an empty table stays empty.
    """
    found = pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).where(F.size("spans") > 0)
    own = "pii_key"
    while own in [c.lower() for c in docs.columns]:
        own += "_"
    spans, doc = own + "_spans", own + "_doc"
    found = found.select(F.col("key").alias(own), F.col("doc_id").alias(doc), F.col("spans").alias(spans)).dropDuplicates([own, doc])
    key = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit("")))
    wide = docs.join(found, (key == found[own]) & docs[id_col].cast("long").eqNullSafe(found[doc]), "left")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"])
        said = F.concat(acc["said"], between, F.get(names, s["kind"]))
        return F.when(s["start"] >= acc["at"], F.struct(said.alias("said"), s["end"].alias("at"))).otherwise(F.struct(acc["said"].alias("said"), F.greatest(acc["at"], s["end"]).alias("at")))

    start = F.struct(F.lit("").alias("said"), F.lit(0).alias("at"))
    new = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["said"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(new)
    return wide.select(*[text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
