"""Exact connectivity from shared buckets: which ids are linked, where links only occur between ids of one bucket.

Buckets may be of any size. What is alone in its bucket goes after one shuffle, for which every task sends one of the many
entries that it holds of a bucket. A bucket is compared in blocks of bounded size. Pairs already known to be connected are
skipped, so a group of near copies costs about one comparison a member. In the first phase every bucket is dealt into
blocks at random, independently, and compared inside the blocks; in the second, one member of each component of a bucket
is compared in the same way, until that links no more; in the third, only buckets that still hold more than one component
are dealt anew, a large component's members to blocks of their own, and only blocks of different components and of sizes
that can link meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_runs, release, small_batches, stash
from .components import components, few
from .shingles import mix

BLOCK = 192
#: Keys that are sent to all executors at most (8 MB); more are joined by shuffling.
SENT_KEYS = 500_000
#: Of a bucket that a pack has more often than this, one entry stands for all until it is known which buckets are shared.
LOCAL = 512

#: compare(data, side, known): pairs (i, j) that link directly; known[i] == known[j] or equal sides >= 0 need no answer.
Compare = Callable[[list[bytes], np.ndarray, np.ndarray], list[tuple[int, int]]]
#: may(sketches, side, known): which pairs could link and aren't known to be connected, as a matrix.
May = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]
#: pairs(sketches of groups of two, one group after another): whether each pair may link. For many groups at once.
Pairs = Callable[[list[bytes]], np.ndarray]
#: Two functions: what is sent of sketches of one length, bytes (n, length); and which pairs of m groups of s may link by it,
#: (m, s, s) of (m, s, bytes).
Brief = tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]
#: Buckets: settled by brief sketches; of more members, or without such; with entries that were not dealt.
SMALL, LARGE, SURE = 0, 1, 2


def only(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """rows whose key is among the keys (distinct, one column); keys are broadcast only if few, as counted."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT_KEYS else keys, col, "left_semi")


def without(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """rows whose key isn't among the keys; the same two ways."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT_KEYS else keys, col, "left_anti")


def blocks_of(ok: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of m groups of s members, ok (m, s, s) says which pairs of a group may link; ids (m, s). The members that may link with
    another, as (name, place) with place in the flattened ids: those that pairs connect have one name, made of their ids alone,
    so that the same members have the same name in every bucket."""
    m, s = ids.shape
    of = np.broadcast_to(np.arange(s, dtype=np.int16), (m, s))
    while True:
        least = np.minimum(of, np.where(ok, of[:, None, :], np.int16(s)).min(axis=2))
        if (least == of).all():
            break
        of = least
    own = np.flatnonzero(ok.any(axis=2))
    if not len(own):
        return np.empty(0, dtype=np.int64), own
    group = (np.arange(m)[:, None] * s + of).ravel()[own]
    order = np.argsort(group, kind="stable")
    own, group = own[order], group[order]
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    total = np.add.reduceat(mix(ids.ravel()[own].view(np.uint64)), start)
    return np.repeat(total, np.diff(np.append(start, len(own)))).view(np.int64), own


def _settled(bucket: np.ndarray, id_: np.ndarray, sure: np.ndarray, wide: np.ndarray | None, brief: Brief | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of entries: (bucket, id, LARGE or SURE) of shared buckets; with brief, buckets up to BLOCK as (name, id, SMALL)."""
    order = np.argsort(bucket)
    like = bucket[order[1:]] == bucket[order[:-1]]
    order = order[np.append(False, like) | np.append(like, False) | sure[order]]
    if not len(order):
        return
    order = order[np.lexsort((id_[order], bucket[order]))]
    b, i = bucket[order], id_[order]
    last = np.append((b[1:] != b[:-1]) | (i[1:] != i[:-1]), True)  # of equal rows
    s = np.logical_or.reduceat(sure[order], np.flatnonzero(np.append(True, last[:-1])))
    order, b, i = order[last], b[last], i[last]
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    size = np.diff(np.append(first, len(b)))
    hot = np.logical_or.reduceat(s, first)
    large = ~hot & (size > (BLOCK if brief else 1))
    for kind, which in ((SURE, hot), (LARGE, large)):
        own = np.repeat(which, size)
        if own.any():
            yield b[own], i[own], kind
    if not brief:
        return
    for n in np.unique(size[~hot & ~large & (size > 1)]).tolist():
        at = first[~hot & ~large & (size == n)]
        step = max(1, 500_000 // (n * n))
        for lo in range(0, len(at), step):
            place = at[lo : lo + step, None] + np.arange(n)
            ok = brief[1](wide[order[place]])
            some = ok.any(axis=(1, 2))
            if some.any():
                name, own = blocks_of(ok[some], i[place[some]])
                yield name, i[place[some]].ravel()[own], SMALL


def _bytes_of(values: pa.Array) -> np.ndarray:
    """Binary values of one length as an array's rows, without making an object of each."""
    at = np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(values.type) else np.int32)
    at = at[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].reshape(len(values), -1)


def shared(signed: DataFrame, brief: Brief | None = None) -> DataFrame:
    """signed(id long, buckets array<long>) -> (bucket, id, kind) of the buckets that more than one id has.

    With brief, rows are (id array<long>, buckets array<long>, sketch array<binary>), each id with as many buckets, and
    buckets up to BLOCK are SMALL: their members that may link with another, under the name of blocks_of in place of the
    bucket. One shuffle: entries are dealt by bucket, many packed into one row. Of what a pack has more than LOCAL times, one
    entry goes that way, and of SURE buckets the others follow.
    """
    spark = signed.sparkSession
    small_batches(spark)
    deals = max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def flat(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        parts = []
        for batch in batches:
            buckets, ids, wide = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1), None
            if brief:
                ids = ids.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ids)), len(buckets) // max(1, len(ids)))
                wide = np.ascontiguousarray(brief[0](_bytes_of(batch.column(2).flatten())))
                wide = wide.view(f"V{wide.shape[1]}").ravel().take(row)
            else:
                ids = ids.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ids)), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            parts.append((buckets, ids[row], wide))
        b, i, w = zip(*parts, strict=True)
        return np.concatenate(b), np.concatenate(i), np.concatenate(w) if brief else None

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        held, n = [], 0
        for batch in batches:
            if size := len(batch.column(0).flatten()):
                held.append(batch)
                n += size
            if n > 500_000:
                yield flat(held)
                held, n = [], 0
        if n:
            yield flat(held)

    def entries(hot: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, id_, wide in packs(batches):
                place = mix(bucket.view(np.uint64))  # one for each bucket; the upper half deals
                order = np.argsort(place)
                bucket, id_, deal = bucket[order], id_[order], ((place[order] >> np.uint64(32)) * np.uint64(deals) >> np.uint64(32)).astype(np.int32)
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                size = np.diff(np.append(first, len(bucket)))
                many, one = np.repeat(size > LOCAL, size), first.copy()
                for k in np.flatnonzero(size > LOCAL).tolist():
                    one[k] += id_[first[k] : first[k] + size[k]].argmin()
                if hot:
                    many[one] = False
                    for lo in range(0, int(many.sum()), 100_000):
                        at = np.flatnonzero(many)[lo : lo + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(id_[at]), pa.array(np.full(len(at), SURE, dtype=np.int32))], names=["bucket", "id", "kind"])
                    continue
                sure = np.zeros(len(bucket), dtype=bool)
                sure[one] = size > LOCAL
                own = np.flatnonzero(~many | sure)
                start = np.flatnonzero(np.append(True, deal[own][1:] != deal[own][:-1]))
                rows = [own[a:b] for a, b in zip(start, [*start[1:], len(own)], strict=True)]
                columns = [pa.array([int(deal[r[0]]) for r in rows], pa.int32())]
                columns += [pa.array([x[r].tobytes() for r in rows], pa.binary()) for x in (bucket, id_, sure)]
                wide = wide.take(order) if brief else None
                columns.append(pa.array([wide[r].tobytes() if brief else b"" for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["deal", "bucket", "id", "sure", "brief"])
            release()

        schema = "bucket long, id long, kind int" if hot else "deal int, bucket binary, id binary, sure binary, brief binary"
        return signed.select("buckets", "id", *["sketch"] * bool(brief)).mapInArrow(run, schema)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        whole = lambda k, kind: np.frombuffer(b"".join(x[k] for x in held), dtype=kind)
        bucket = whole(0, np.int64)
        wide = whole(3, np.uint8).reshape(len(bucket), -1) if brief else None
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for name, id_, kind in _settled(bucket, whole(1, np.int64), whole(2, bool), wide, brief):
            if kind == SMALL:
                seen.append((name, id_))
            else:
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(id_), pa.array(np.full(len(id_), kind, dtype=np.int32))], names=["bucket", "id", "kind"])
        if seen:
            name, id_ = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.lexsort((id_, name))
            name, id_ = name[order], id_[order]
            own = np.append(True, (name[1:] != name[:-1]) | (id_[1:] != id_[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(name[own]), pa.array(id_[own]), pa.array(np.full(int(own.sum()), SMALL, dtype=np.int32))], names=["bucket", "id", "kind"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for deal, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and deal != last:
                    yield from settle(held)
                    held = []
                held.append(row)
                last = deal
        if held:
            yield from settle(held)
        release()

    dealt = entries(False).repartition("deal").sortWithinPartitions("deal").mapInArrow(each, "bucket long, id long, kind int")
    dealt = stash(dealt, "members")
    hot = dealt.where(F.col("kind") == SURE)
    if hot.isEmpty():
        return dealt
    out = stash(dealt.where(F.col("kind") != SURE).unionByName(hot.unionByName(entries(True)).distinct()), "members")
    discard(dealt)
    return out


def _edges(members: DataFrame, payload: DataFrame, keys: list[str], compare: Compare, prepare: Callable[[list[bytes]], list] | None = None) -> DataFrame:
    def run(g: dict) -> dict | None:
        ids, side = g["id"], g["side"]
        if len(ids) < 2 or side[0] >= 0 and (side == side[0]).all():
            return None
        got = compare(g["data"].tolist(), side, g["known"])
        return {"a": ids[[i for i, _ in got]], "b": ids[[j for _, j in got]]} if got else None

    return map_runs(members.join(payload, "id").select(*keys, "id", "side", "known", "data"), keys, run, "a long, b long", least=2, prepare=prepare)


def _able(members: DataFrame, sketches: DataFrame | None, keys: list[str], may: May | None, tag: str, may_pairs: Pairs | None = None) -> DataFrame:
    """members without those that, by their sketches, can't link with another of their block. Blocks (bucket, part) fall into
    those that pairs connect, named by blocks_of: what many blocks have in common comes once."""
    if sketches is None:
        return members
    named = keys == ["bucket", "part"]

    def run(g: dict) -> dict | None:
        if len(g["id"]) < 2:
            return None
        ok = may(g["sketch"].tolist(), g["side"], g["known"])
        if not named:
            own = ok.any(axis=1)
            return {c: g[c][own] for c in (*keys, "id", "side", "known")} if own.any() else None
        name, own = blocks_of(ok[None], g["id"][None])
        return {"bucket": name, "part": np.zeros(len(own), dtype=np.int32)} | {c: g[c][own] for c in ("id", "side", "known")} if len(own) else None

    def run_pairs(g: dict) -> dict | None:
        own = (g["known"][::2] != g["known"][1::2]) & ((g["side"][::2] < 0) | (g["side"][::2] != g["side"][1::2]))
        own &= may_pairs(g["sketch"].tolist())
        if not own.any():
            return None
        two = {c: g[c][np.repeat(own, 2)] for c in (*keys, "id", "side", "known")}
        if named:
            name = mix(two["id"].view(np.uint64))
            two |= {"bucket": np.repeat(name[::2] + name[1::2], 2).view(np.int64), "part": np.zeros(len(name), dtype=np.int32)}
        return two

    schema = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in (*keys, "id", "side", "known"))
    out = map_runs(members.join(sketches, "id").select(*keys, "id", "side", "known", "sketch"), keys, run, schema, run_pairs if may_pairs else None, 2)
    return stash(out.distinct() if named else out, tag)


def _across(rest: DataFrame, block: int) -> DataFrame:
    """rest(bucket, id, size, known) -> (bucket, p, q, id, side, known): members beside those of other components in their
    bucket whose sizes can link, block by block. A component of a block or more has blocks of its own, which never meet."""
    kind = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.log(F.lit(1.25))).cast("int")
    own = rest.groupBy("bucket", "known").agg(F.count("*").alias("n")).where(F.col("n") >= block).select("bucket", "known", F.col("known").alias("label"))
    own = stash(own, "large")  # written, so that the join deals both sides itself and Spark can split a large component
    rest = rest.withColumn("kind", kind).join(own, ["bucket", "known"], "left")
    counts = rest.groupBy("bucket", "label", "kind").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    counts = stash(counts, "counts")
    part = lambda no: F.xxhash64("label", "kind", no)
    found = counts.select(F.col("bucket").alias("b"), F.col("label").alias("l"), F.col("kind").alias("k"), "blocks")
    dealt = rest.join(found, F.expr("bucket = b and kind = k and label <=> l"))
    dealt = dealt.select("bucket", "id", "known", part(F.pmod(F.xxhash64("id", "bucket"), "blocks").cast("int")).alias("part"))
    blocks = counts.select("bucket", "label", "kind", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no")).select("bucket", "label", "kind", part("no").alias("part"))
    one, two = (blocks.select("bucket", F.col("label").alias(f"label_{x}"), F.col("kind").alias(f"kind_{x}"), F.col("part").alias(x)) for x in "pq")
    meet = one.join(two, "bucket").where("p <= q and abs(kind_p - kind_q) <= 1 and (label_p is null or label_q is null or label_p <> label_q)").select("bucket", "p", "q")
    meet = stash(meet, "meet")
    ends = meet.select("*", F.col("p").alias("part"), F.when(F.col("p") == F.col("q"), -1).otherwise(0).alias("side"))
    ends = ends.unionByName(meet.where("p <> q").select("*", F.col("q").alias("part"), F.lit(1).alias("side")))
    return dealt.join(ends, ["bucket", "part"]).select("bucket", "p", "q", "id", "side", "known")


def linked(signed: DataFrame, payload_of: Callable[[DataFrame], DataFrame], compare: Compare, block: int = BLOCK, sketches: DataFrame | None = None, may: May | None = None, prepare: Callable[[list[bytes]], list] | None = None, may_pairs: Pairs | None = None, packed: DataFrame | None = None, brief: Brief | None = None) -> DataFrame:
    """signed(id long, size int, buckets array<long>, repeats allowed) -> (id, component) of ids with at least one link.

    Ids link only if the smaller size is at least 0.8 of the larger. payload_of(ids) gives (id, data) of a table of ids, an
    id perhaps more than once. Buckets with the same members are compared once. With sketches (id, sketch) and may(), the
    data of a member is only fetched where its sketch leaves a link possible. prepare: what compare gets of
    data, made for many members at once. may_pairs: may for many groups of two. packed and brief: signed with its sketches as
    shared() takes them; buckets up to a block are then settled where they are found.
    """
    members = shared(packed, brief) if brief else shared(signed)
    large = members.where(F.col("kind") != SMALL)
    mark = large.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    alike = mark.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    alike = stash(alike.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "buckets")
    members_of = large.join(few(alike), "bucket").withColumn("part", F.pmod(F.xxhash64("id", "bucket"), "blocks").cast("int"))
    chosen = stash(members_of.select("bucket", "blocks", "part", "id"), "chosen")
    discard(alike)

    def fetch(rows: DataFrame) -> DataFrame:
        ids = stash(rows.select("id").distinct(), "ids")
        return payload_of(ids)

    small = members.where(F.col("kind") == SMALL).select("bucket", F.lit(0).alias("part"), "id", F.lit(-1).alias("side"), F.col("id").alias("known"))
    first = chosen.select("bucket", "part", "id", F.lit(-1).alias("side"), F.col("id").alias("known"))
    if sketches is not None:
        every = stash(chosen.select("id").unionByName(small.select("id")).distinct(), "every")
        sketches = stash(only(sketches, every, "id").dropDuplicates(["id"]), "sketches")
        first = _able(first, sketches, ["bucket", "part"], may, "able", may_pairs)
    if brief:
        first = stash(first.unionByName(small).distinct(), "able")
    able = first
    discard(members)
    if sketches is None:
        edges = stash(_edges(first, fetch(first), ["bucket", "part"], compare, prepare), "links")
    else:
        # Most links show when every id is compared in one of its buckets alone, which like ids tend to choose alike. Only
        # blocks that then still hold several components are compared as a whole, so that data is hardly sent twice.
        home = first.groupBy("id").agg(F.min("bucket").alias("bucket"))
        alone = first.join(home, ["id", "bucket"], "left_semi").select(*first.columns)
        one = stash(_edges(alone, fetch(alone), ["bucket", "part"], compare, prepare), "links")
        found = stash(components(one), "found")
        again = first.drop("known").join(few(found), "id", "left").withColumn("known", F.coalesce("component", "id")).drop("component")
        apart = again.groupBy("bucket", "part").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high")
        again = again.join(few(stash(apart.select("bucket", "part"), "apart")), ["bucket", "part"], "left_semi").select(*first.columns)
        again = _able(again, sketches, ["bucket", "part"], may, "again", may_pairs)
        edges = stash(one.unionByName(_edges(again, fetch(again), ["bucket", "part"], compare, prepare)), "links")
        discard(one, found, again, able)
    found = components(edges)
    split = chosen.where("blocks > 1")
    if split.isEmpty():
        discard(chosen)
        return found
    keys, turn = ["bucket", "part"], 0
    while True:
        found = stash(found, "found")
        known = split.join(few(found), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("known"))
        open_ = known.groupBy("bucket").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("bucket")
        rest = stash(known.join(few(stash(open_, "open")), "bucket", "left_semi"), "rest")
        # One member of each component first: a block's worth of components becomes one where they are alike, so that what
        # is left for all members to settle is few components, however many members the bucket has.
        some = rest.groupBy("bucket", "known").agg(F.min("id").alias("id"))
        blocks = stash(some.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
        some = some.join(few(blocks), "bucket").select("bucket", F.pmod(F.xxhash64("id", "bucket", F.lit(turn)), "blocks").cast("int").alias("part"), "id", F.lit(-1).alias("side"), "known")
        some = stash(_able(some, sketches, keys, may, "some", may_pairs), "some")
        new = stash(_edges(some, fetch(some), keys, compare, prepare), "links")
        discard(found, some, blocks)
        if new.isEmpty():
            break
        edges = stash(edges.unionByName(new), "links")
        found, turn = components(edges), turn + 1
        discard(rest)
    sizes = only(signed.select("id", "size"), stash(rest.select("id").distinct(), "ids"), "id").dropDuplicates(["id"])
    rest = stash(rest.join(sizes, "id").select("bucket", "id", "size", "known"), "rest")
    discard(chosen)
    keys = ["bucket", "p", "q"]
    across = _able(_across(rest, block), sketches, keys, may, "across", may_pairs)
    # Written, as what components() does with links runs in Python too: in one stage, every task would take two workers at once,
    # which stay.
    more = stash(_edges(across, fetch(across), keys, compare, prepare), "links")
    return components(edges.unionByName(more))
