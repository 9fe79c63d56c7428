"""What the operators of this subpackage share: written intermediate tables, runs of equal keys, input columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: The most bytes of one batch that a Python worker gets: what it makes of a batch stays a small multiple of that.
BATCH_BYTES = 4 << 20
#: For files of local folders (others don't heed it): the file system without checksums. Where Hadoop's native library is
#: missing, a file system starts chmod for every file it makes, and this one does so for half as many.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir. Where that is unset a temporary one serves a single machine;
    on a cluster it is an error, as each executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="bomscope-")
    return _OWN[app]


def small_batches(spark: SparkSession) -> None:
    """From now on this session's batches for Python hold BATCH_BYTES at most (a row more), unless it has a lower bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str(64 << 20)):
        spark.conf.set(key, str(BATCH_BYTES))


def stash(df: DataFrame, tag: str, varied: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives the loss of executors. varied: hardly a
    value comes twice, so that no dictionaries are tried."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bomscope/{tag}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES, **{"parquet.enable.dictionary": "false"} if varied else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def local_table(spark: SparkSession, rows: pa.Table) -> DataFrame:
    """A small table that the driver holds. It goes out as Arrow: of a list Spark makes an RDD of Python's, for which every
    executor starts workers of another kind, which then stay beside those that run the operators."""
    return spark.createDataFrame(rows)


def give_back(spark: SparkSession) -> bool:
    """Give what the driver's JVM has allocated and freed outside its heap (compilers, collectors, buffers) back to the system,
    which the C library keeps otherwise. False where the JVM has no such command."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        # By the interface's method, as the server's own class is not open to others.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def discard(*tables: DataFrame | None) -> None:
    """Delete stashed tables that nothing will read any more, and let Spark's cleaner find the shuffles behind them: it
    removes those that the driver's garbage collector has met."""
    if any(df is not None for df in tables):
        spark = next(df for df in tables if df is not None).sparkSession
        spark._jvm.System.gc()
        give_back(spark)
    for df in tables:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text counts as empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_rows(rows: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas for rows with a doc_id, which Python gets, and returns if the schema has it, as text: a null in a batch of
    numbers would turn them all into floating point, which large ids don't survive."""
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(fn, schema.replace("doc_id long", "doc_id string"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long")) if "doc_id" in out.columns else out


def release() -> None:
    """Give memory that a task no longer needs back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of one C library only
    if trim:
        trim(0)


def parts(batches: Iterator[pd.DataFrame], n: int = 1000) -> Iterator[pd.DataFrame]:
    """The same rows, at most n at a time: what is made of a batch of texts stays small."""
    for pdf in batches:
        for i in range(0, len(pdf), n):
            yield pdf.iloc[i : i + n]
    release()


def runs(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 1, two: bool = False) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
    """(False, a group of equal keys) from a sorted partition, one at a time as arrays by column, whatever the batch borders;
    groups of fewer than least rows may be left out. With two, also (True, groups of two rows one after another)."""
    held: list[dict[str, np.ndarray]] = []
    last = None
    whole = lambda parts: parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    for pdf in batches:
        n = len(pdf)
        if not n:
            continue
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        change = np.zeros(n, dtype=bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        cuts = np.concatenate([[0], change.nonzero()[0], [n]])
        size = np.diff(cuts)
        inner = np.ones(len(size), dtype=bool)
        inner[[0, -1]] = False  # the others are whole
        skip = inner & (size < least)
        if two and (pair := inner & (size == 2)).any():
            at = (cuts[:-1][pair][:, None] + np.arange(2)).ravel()
            yield True, {c: v[at] for c, v in cols.items()}
            skip |= pair
        for i in np.flatnonzero(~skip).tolist():
            a, b = int(cuts[i]), int(cuts[i + 1])
            if i == 0:
                key = tuple(cols[k][0] for k in keys)
                if held and key != last:
                    yield False, whole(held)
                    held = []
            elif held:
                yield False, whole(held)
                held = []
            held.append({c: v[a:b] for c, v in cols.items()})
        last = tuple(cols[k][n - 1] for k in keys)
    if held:
        yield False, whole(held)


def prepared(batches: Iterator[pd.DataFrame], prepare: Callable[[list], list], size: int = 1 << 18) -> Iterator[pd.DataFrame]:
    """The same rows with prepare's values of the column data, some size bytes of it at a time: what is made of data may be
    many times as large."""
    for pdf in batches:
        length = np.cumsum([len(x) for x in pdf["data"]])
        at = 0
        while at < len(pdf):
            end = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + size, side="right")))
            part = pdf.iloc[at:end]
            yield part.assign(data=pd.Series(prepare(part["data"].tolist()), index=part.index, dtype=object))
            at = end


Columns = dict[str, np.ndarray]


def map_runs(df: DataFrame, keys: list[str], fn: Callable[[Columns], Columns | None], schema: str, pairs: Callable[[Columns], Columns | None] | None = None, least: int = 1, prepare: Callable[[list], list] | None = None) -> DataFrame:
    """fn over every group of equal, non-null keys; cheaper than a grouped map when most groups are tiny.

    fn gets the group's columns as arrays and returns columns. pairs, if given, gets many groups of two rows at once, one
    after another. Groups of fewer than least rows may be left out. prepare makes of a batch's column data what fn gets.
    Callers bound the size of a group beforehand.
    """
    small_batches(df.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict[str, np.ndarray]] = []
        n = 0
        batches = prepared(batches, prepare) if prepare else batches
        for two, group in runs(batches, keys, least, pairs is not None):
            got = pairs(group) if two else fn(group)
            if got is not None:
                out.append(got)
                n += len(next(iter(got.values())))
            if n > 20_000:
                yield pd.DataFrame({c: np.concatenate([g[c] for g in out]) for c in out[0]})
                out, n = [], 0
        if out:
            yield pd.DataFrame({c: np.concatenate([g[c] for g in out]) for c in out[0]})
        release()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(each, schema)
