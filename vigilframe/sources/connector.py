"""Extension point for search services: a connector is a Python data source that yields events as JSON text.

The engine runs queries itself; a connector only brings events in.  ``JsonFolder`` is the built-in one and shows
the form: reading is split into partitions that workers read on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import glob

        return [_File(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            for n, line in enumerate(f):
                if line.strip():
                    yield partition.path, n, line.rstrip("\n")


class JsonFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_folder"

    def schema(self) -> str:
        return "path string, line long, event string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


_CONNECTORS: dict[str, type[DataSource]] = {"json_folder": JsonFolder}


def register(source: type[DataSource]) -> None:
    _CONNECTORS[source.name()] = source


def connect(spark: SparkSession, name: str, **options: str):
    """A DataFrame of a connector's events."""
    if name not in _CONNECTORS:
        raise ValueError(f"unknown connector: {name}")
    spark.dataSource.register(_CONNECTORS[name])
    return spark.read.format(name).options(**options).load()
