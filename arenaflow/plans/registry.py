"""Registry of comparison queries: a Spark plan, its columns and the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenaflow.plans.oracle import compose
from arenaflow.plans.tables import Telemetry

_SPARK = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
_SQL = {"s": "VARCHAR", "i": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Entry:
    build: Callable[[Telemetry], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.shape(self.build(Telemetry(spark, folder)))

    def shape(self, frame: DataFrame) -> DataFrame:
        """Declared columns and types; doubles keep six decimals on both sides."""
        def typed(name: str, kind: str):
            value = F.col(name).cast(_SPARK[kind])
            return (F.round(value, 6) if kind == "d" else value).alias(name)

        return frame.select(*[typed(name, kind) for name, kind in self.columns])

    def statement(self) -> str | None:
        if self.sql is None:
            return None

        def typed(name: str, kind: str) -> str:
            value = f"CAST({name} AS {_SQL[kind]})"
            return f"{f'round({value}, 6)' if kind == 'd' else value} AS {name}"

        return f"SELECT {', '.join(typed(*column) for column in self.columns)} FROM (\n{self.sql}\n) AS answer"


ENTRIES: dict[str, Entry] = {}


def query(columns: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a builder under its function name.

    ``columns`` lists ``name:kind`` with kind s, i, d or b; ``sql`` answers the
    same question over the given tables and the oracle views.
    """
    parsed = tuple((part.split(":")[0], part.split(":")[1]) for part in columns.split())

    def register(build: Callable[[Telemetry], DataFrame]) -> Callable[[Telemetry], DataFrame]:
        statement = compose(sql, views) if sql is not None else None
        ENTRIES[build.__name__] = Entry(build, parsed, statement)
        return build

    return register
