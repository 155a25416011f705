"""A registry of tables that others have written: read once for each session, never written here."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class MissingTable(FileNotFoundError):
    """A table that isn't there yet; the message says who makes it."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class Source:
    name: str
    label: str
    needs: tuple[str, ...]


@dataclass
class Registry:
    """Tables of a folder by name. Each is opened on its first use, with the columns that are asked for, and kept as a plan (cached: in
    memory). Locks are by name, so a slow table holds up nobody who wants another, and a loader may ask for other tables."""

    spark: SparkSession
    folder: str
    makers: dict[str, str] = field(default_factory=dict)
    sources: tuple[Source, ...] = ()
    looks: int = 0

    def __post_init__(self):
        self._guard, self._locks, self._kept = threading.Lock(), {}, {}

    def once(self, key: str, load: Callable[[], object]) -> object:
        with self._guard:
            lock = self._locks.setdefault(key, threading.RLock())
        with lock:
            if key not in self._kept:
                self._kept[key] = load()
            return self._kept[key]

    def table(self, name: str, columns: tuple[str, ...] = (), cached: bool = False) -> DataFrame:
        def load() -> DataFrame:
            path = f"{self.folder}/{name}.parquet"
            if not exists(self.spark, path):
                raise MissingTable(f"{path} isn't there; {self.makers.get(name, 'nobody')} makes it")
            df = self.spark.read.parquet(path)
            df = df.select(*columns) if columns else df
            return df.cache() if cached else df

        return self.once(f"{name}{columns}{cached}", load)

    def ready(self) -> dict[str, bool]:
        """Which sources have all the tables that they need."""
        return {s.name: all(exists(self.spark, f"{self.folder}/{n}.parquet") for n in s.needs) for s in self.sources}

    def look(self) -> int:
        """Count a look at held-out data."""
        with self._guard:
            self.looks += 1
            return self.looks

    def clear(self) -> None:
        with self._guard:
            for kept in self._kept.values():
                if isinstance(kept, DataFrame):
                    kept.unpersist()
            self._kept.clear()


def load_prices(spark: SparkSession, source: str, loaders: dict[str, Callable[..., DataFrame]], **options: object) -> DataFrame:
    """Prices by the loader of a source; an unknown one is refused."""
    if source not in loaders:
        raise ValueError(f"source must be one of {sorted(loaders)}, not {source!r}")
    return loaders[source](spark, **options)
