"""Pieces that several operators share: tables, scratch space, seeded fractions, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_SCRATCH: list[str] = []

#: The struct that carries a row's columns through an operator, so that none of them meets the operator's own.
ROW = "row"

#: Bytes of text that one numpy step works on; bounds a task's temporaries.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset the warehouse, or on one machine a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/readloom-scratch"
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="spark-readloom-"))
    return _OWN_SCRATCH[0]


class Scratch:
    """What was written or broadcast since it began, each with how to give it back."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def add(self, thing: Any, give_back: Callable[[], None]) -> None:
        self.made.append((thing, give_back))

    def give_back(self, *stay: Any) -> list[tuple[Any, Callable[[], None]]]:
        """Gives back all but `stay`, and returns the rest."""
        rest = [x for x in self.made if any(x[0] is y for y in stay)]
        for thing, give_back in self.made:
            if not any(thing is y for y in stay):
                give_back()
        self.made = []
        return rest


_OPEN = threading.local()


def _scopes() -> list[Scratch]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


@contextmanager
def giving_back(spark: SparkSession) -> Iterator[list]:
    """What `kept`, `kept_by` and `shared` make within goes at the end: files, tables and broadcasts. Things put on the list stay.

    Whatever stays belongs to the scope around this one. Results that are still to be computed must not need what goes.
    """
    scope, stay = Scratch(spark), []
    _scopes().append(scope)
    try:
        yield stay
    finally:
        _scopes().remove(scope)
        rest = scope.give_back(*stay)
        for thing, give_back in rest if _scopes() else []:
            _scopes()[-1].add(thing, give_back)
        trim(spark)


def _made(thing: Any, give_back: Callable[[], None]) -> None:
    if _scopes():
        _scopes()[-1].add(thing, give_back)


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def trim(spark: SparkSession) -> None:
    """Free memory of the driver goes back to the system, that of its JVM too, where it is one that can."""
    _trim()
    try:
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0))
    except Py4JError:  # a JVM without this command
        pass


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def shared(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of a value of bounded size."""
    out = spark.sparkContext.broadcast(value)
    _made(out, lambda: out.destroy(blocking=False))
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computes df once."""
    spark, path = df.sparkSession, f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _made(out, lambda: _deleted(spark, path))
    return out


def kept_by(df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """The same as a table bucketed by `key`: later joins on it move only their other side.

    dealt: a shuffle has put rows of equal key into one task already, so none is made for it; a task writes a file for each of its buckets.
    """
    spark, made = df.sparkSession, f"readloom_{name}_{uuid.uuid4().hex}"
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{scratch_dir(spark)}/{made}"

    def give_back() -> None:
        spark.sql(f"drop table if exists {made}")
        _deleted(spark, path)

    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(made)
    out = spark.table(made)
    _made(out, give_back)
    return out


def carried(df: DataFrame, *columns: Column | str) -> DataFrame:
    """df's rows as one struct column ROW, beside the columns that an operator needs."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(ROW), *columns)


def beside(df: DataFrame, column: str, without: tuple[str, ...] = ()) -> tuple[DataFrame, list[Column]]:
    """df as (ROW, column), ROW a struct of all other columns but `without`, and the columns that this makes again, in their order."""
    names = [c for c in df.columns if c not in without]
    others = [F.col(quoted(c)) for c in names if c != column]
    back = [F.col(column) if c == column else F.col(ROW).getField(c).alias(c) for c in names]
    return df.select(F.struct(*(others or [F.lit(0).alias("none")])).alias(ROW), column), back


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives freed memory back to the system when a task ends: Python workers live on, idle."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


def doc_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def fraction(*cols: Column | str) -> Column:
    """A fixed pseudorandom number in [0, 1) for the columns' values."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")) / float(1 << 53)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- words as hashes, many texts at a time

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        both = []
        for r in (_R, _R_INV):
            x = np.full(size, r, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts with about `limit` bytes; a null is empty."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the words' bounds of each text (len(off) numbers)."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~white[buf]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cut = off[(off > 0) & (off < len(buf))]
    begins[cut] = solid[cut]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[cut - 1] = solid[cut - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf))
    p = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=p[1:])
    return mix64((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
