"""Shared helpers of the training-data operators: storage that every executor can reach, and bounded batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import importlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
#: Paths that were written here, with the session and the thread that wrote them.
_WRITTEN: dict[str, tuple[SparkSession, int]] = {}
#: How many blocks of shuffles_removed() are open in a session, and its setting before the first.
_REMOVING: dict[SparkSession, tuple[int, str | None]] = {}
_REMOVING_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (tests), a folder of our own that is removed at exit."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tandemlake-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and a lost executor costs a read of files."""
    return df.sparkSession.read.schema(df.schema).parquet(write_stored(df, name))


def write_stored(df: DataFrame, name: str) -> str:
    """What is written here goes by drop_stored(), or else when the driver ends: a result may be read from it until then."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_clean_up)
    _WRITTEN[path] = df.sparkSession, threading.get_ident()
    release(df.sparkSession)
    return path


def _clean_up() -> None:
    with suppress(Exception):  # the driver ends: the engine may be gone already
        for path, (spark, _) in list(_WRITTEN.items()):
            drop_stored(spark, path)


def release(spark: SparkSession) -> None:
    """Let the engine remove shuffle files that nothing refers to any more; it does so when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each execution go when it has ended. release() alone is not certain to remove them: files of
    the execution just before it were seen to stay until garbage was collected again, after the next write."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _REMOVING_LOCK:
        depth, before = _REMOVING.get(spark) or (0, spark.conf.get(key, None))
        _REMOVING[spark] = depth + 1, before
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        with _REMOVING_LOCK:
            depth, before = _REMOVING.pop(spark)
            if depth > 1:
                _REMOVING[spark] = depth - 1, before
            elif before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Remove what write_stored() wrote, by the file system that the path names."""
    _WRITTEN.pop(path, None)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_all_but(spark: SparkSession, before: set[str], keep: set[str] = frozenset()) -> None:
    """Remove what this thread has written since `before` (see written()) and nothing reads any more."""
    for path in written() - before - keep:
        drop_stored(spark, path)


def written() -> set[str]:
    return {path for path, (_, thread) in _WRITTEN.items() if thread == threading.get_ident()}


# ------------------------------------------------------------------ columns and joins


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """The columns of df as one struct: whatever they are called, they can't clash with an operator's own."""
    fields = [quoted(c).alias(c) for c in df.columns if c not in but]
    return F.struct(*fields) if fields else F.struct(F.lit(0).alias("none"))


def field(struct: str, name: str) -> Column:
    return F.col(struct).getField(name).alias(name)


def join_splittable(left: DataFrame, summed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined to `summed`, an aggregate with a row for each of keys (not null on either side).

    Joined by the keys themselves, the aggregate would keep its own partitioning and the engine couldn't split the rows of a
    common key in left. The keys are joined inside a struct, for which both sides are dealt anew and a common key can be split.
    """
    right = summed.select(F.struct(*(quoted(k).alias(k) for k in keys)).alias("_joined_by"), *(quoted(c) for c in summed.columns if c not in keys))
    out = left.withColumn("_joined_by", F.struct(*(quoted(k).alias(k) for k in keys))).join(right, "_joined_by", how)
    return out.drop("_joined_by")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts come to Python in batches of at most so many rows, so that a batch stays in the memory of a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


#: What operators keep in a worker process from task to task: how to let it go, by name.
KEPT: dict[str, Callable[[], None]] = {}


def tidy(work: Callable, keeps: str = "") -> Callable:
    """work for mapInArrow, such that a worker that goes on to other operators doesn't hold on to memory: what others keep
    goes beforehand, and what the allocator holds back is returned afterwards."""

    def run(batches: Iterator) -> Iterator:
        here = importlib.import_module("tandemlake.llm.common")  # the worker's own module: what a closure names would be a copy
        for name, drop in here.KEPT.items():
            if name != keeps:
                drop()
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def runs_by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of neighbours whose sizes sum to at most limit (a single larger one stands alone)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


# ------------------------------------------------------------------ polynomial hashes modulo 2**64

BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(b: int) -> int:
    x = 1
    for _ in range(6):
        x = x * (2 - b * x) % (1 << 64)
    return x


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _forget_powers() -> None:
    _POWERS.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))


KEPT["powers"] = _forget_powers


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if len(_POWERS["up"]) < n:
        for key, b in (("up", int(BASE)), ("down", _inverse(int(BASE)))):
            a = np.full(n, b, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, up): the hash of data[i:j] is (P[j] - P[i]) * up[i], whatever i is."""
    n = len(data)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=prefix[1:])
    return prefix, up


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))
