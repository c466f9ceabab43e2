"""A stream of ticks: one row each time a query asks for data, so that a query can
look at what has no stream of its own. Its offset is the tick's number."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class TickReader(SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"tick": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter([(start["tick"],)]), {"tick": start["tick"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(k,) for k in range(start["tick"], end["tick"])])


class Ticks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_ticks"

    def schema(self) -> str:
        return "tick long"

    def simpleStreamReader(self, schema: object) -> TickReader:
        return TickReader()


def ticks(spark: SparkSession) -> DataFrame:
    spark.dataSource.register(Ticks)
    return spark.readStream.format("tessera_ticks").load()
