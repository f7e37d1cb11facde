"""Query registry: one Spark callable and, where SQL can say it, one independent SQL text per name.

Stand-ins are inputs in the shape the operators expect, derived from the given tables by SQL
that both engines run.  ``@name@`` in a text stands for a table or another stand-in.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from offerlens.session import widen

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

STANDINS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand(sql: str, table: Callable[[str], str]) -> str:
    """Replace ``@name@`` by a table reference or a bracketed stand-in."""

    def one(match: re.Match) -> str:
        name, alias = match.group(1), match.group(2)
        if name in TABLES:
            return table(name) + (alias or "")
        return f"({expand(STANDINS[name], table)})" + (alias or f" AS {name}")

    return re.sub(r"@(\w+)@(\s+AS\s+\w+)?", one, sql)


class Inputs:
    """Tables and stand-ins of one data folder.

    A table of few files comes in few partitions, whatever its rows cost to work on, so such a table is
    spread over all cores first.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return widen(self.spark.read.parquet(self._path(name)))

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def _source(self, name: str) -> str:
        cores = self.spark.sparkContext.defaultParallelism
        if self.spark.read.parquet(self._path(name)).rdd.getNumPartitions() >= cores:
            return f"parquet.`{self._path(name)}`"
        return f"(SELECT /*+ REPARTITION({cores}) */ * FROM parquet.`{self._path(name)}`)"

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(expand(text, lru_cache(maxsize=None)(self._source)))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in STANDINS:
            return self.sql(STANDINS[name])
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with its SQL counterpart."""

    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = expand(sql, lambda n: n)
        return fn

    return add
