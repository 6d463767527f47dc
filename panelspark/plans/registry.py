"""Registry of the queries, and the small set of SQL spellings that differ between engines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[["Tables"], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, oracle: Callable[["Dialect"], str] | None = None):
    """Register a function of `Tables` under its own name; `covers` lists inventory ids."""

    def register(function):
        name = function.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} is already registered")
        REGISTRY[name] = Query(name, tuple(covers.split()), function, oracle(DUCK) if oracle else None)
        return function

    return register


class Dialect:
    """Spells table names, day numbers and epoch seconds for one engine."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def table(self, name: str) -> str:
        return "{" + name + "}" if self.spark else name

    def day(self, expression: str) -> str:
        """Whole days since 1970-01-01."""
        date = f"cast({expression} as date)"
        return f"cast(unix_date({date}) as bigint)" if self.spark else f"cast(datediff('day', date '1970-01-01', {date}) as bigint)"

    def seconds(self, expression: str) -> str:
        """Whole seconds since 1970-01-01, independent of the session time zone."""
        return f"({self.day(expression)} * 86400 + hour({expression}) * 3600 + minute({expression}) * 60 + cast(floor(second({expression})) as bigint))"

    def from_day(self, expression: str) -> str:
        return f"date_add(date '1970-01-01', cast({expression} as int))" if self.spark else f"(date '1970-01-01' + cast({expression} as integer))"


SPARK, DUCK = Dialect(True), Dialect(False)


class Tables:
    """Lazy access to the parquet tables of one folder, and to adapter SQL over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def sql(self, adapter: Callable[[Dialect], str]) -> DataFrame:
        text = adapter(SPARK)
        used = {t: self.read(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


def micro(column: Column | str) -> Column:
    """Millionths as a whole number: equal on both engines in spite of the last bits."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column * 1000000 + 0.5).cast("bigint")


def micro_sql(expression: str) -> str:
    return f"cast(floor(({expression}) * 1000000 + 0.5) as bigint)"
