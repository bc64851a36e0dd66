"""How modules register named queries with the SQL that DuckDB can be asked for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import TABLES, table

_NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


class Registry:
    """queries: name -> (spark, sf_dir) -> DataFrame; oracles: name -> SQL; covers: name -> operator ids."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}
        self.covers: dict[str, str] = {}

    def query(self, name: str, covers: str, oracle: str | None = None):
        """Register a function of (spark, sf_dir)."""

        def put(f):
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name], self.covers[name] = f, covers
            if oracle:
                self.oracles[name] = oracle
            return f

        return put

    def sql(self, name: str, covers: str, text: str, oracle: str | None = None) -> None:
        """Register a query whose Spark SQL also is (or has beside it) the DuckDB SQL."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run_sql(spark, sf_dir, text)

        run.__doc__ = f"Operators {covers}."
        self.query(name, covers, oracle or text)(run)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the tables of the data directory that it names."""
    for n in set(_NAMES.findall(text)):
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(text)
