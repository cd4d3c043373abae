"""Registered queries: a Spark callable per name and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pactlane.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Expression-heavy stages exceed the size HotSpot compiles in one method; below this limit Spark
# splits them into small methods instead. Only filled in where the session left the default.
SESSION_DEFAULTS = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000")}


def tune(spark: SparkSession) -> None:
    ship(spark)
    for key, (default, value) in SESSION_DEFAULTS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
