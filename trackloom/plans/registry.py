"""Where the example queries register themselves, each with its SQL for the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.sources.tables import materialize

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """Lazy access to the given parquet tables: ``t.events`` reads ``events.parquet``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._shared: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def shared(self, name: str, make) -> DataFrame:
        """An intermediate that one query reads several times, checkpointed once."""
        if name not in self._shared:
            self._shared[name] = materialize(make(self))
        return self._shared[name]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def runner(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The tables carry zone-less timestamps; every query reads them as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(Tables(spark, sf_dir))

    return run
