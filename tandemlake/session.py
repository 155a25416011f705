"""A session with the settings that the operators count on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tandemlake", **conf: str) -> SparkSession:
    """NTZ timestamps, UTC, adaptive execution with skew joins; linear algebra in Python workers stays on one thread each."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.timestampType", "TIMESTAMP_NTZ")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share; a folder of our own only in local mode."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    with _LOCK:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tandemlake-panels-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


_OWN: list[str] = []
_PANELS: dict[tuple, str] = {}
_LOCK = threading.RLock()


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and latest change of what is under a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    files = list(fs.listStatus(p)) if status.isDirectory() else [status]
    return sum(f.getLen() for f in files), max([status.getModificationTime(), *(f.getModificationTime() for f in files)])


def panel(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries read: made once for each application and state of its source files, written to the shared folder, and
    read from there. It goes when the driver ends."""
    key = (spark.sparkContext.applicationId, name, *((s, _stamp(spark, s)) for s in sources))
    with _LOCK:
        path = _PANELS.get(key)
        if path is None:
            path = f"{shared_dir(spark)}/panel-{name}-{uuid.uuid4().hex}"
            make().write.parquet(path)
            if not _PANELS:
                atexit.register(_clean_up, spark)
            _PANELS[key] = path
    return spark.read.parquet(path)


def _clean_up(spark: SparkSession) -> None:
    with suppress(Exception):  # the driver ends: the engine may be gone already
        for path in _PANELS.values():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
