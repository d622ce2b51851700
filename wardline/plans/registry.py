"""Queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Points and scores that the queries derive from keys, alike in both dialects.
def lat(key: str) -> Column:
    return (F.col(key) * 37 % 1000) / 1000.0 + 55


def lon(key: str) -> Column:
    return (F.col(key) * 53 % 1000) / 1000.0 + 37


def sql_point(key: str) -> str:
    return f"({key} * 37 % 1000) / 1000.0::DOUBLE + 55 AS lat, ({key} * 53 % 1000) / 1000.0::DOUBLE + 37 AS lon"


def sql_round(value: str, places: int) -> str:
    return f"floor(({value}) * {10**places} + 0.5) / {float(10**places)}::DOUBLE"


SQL_KM = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"
