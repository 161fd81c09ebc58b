"""Indexes kept as Parquet tables, built once and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def kept(spark: SparkSession, uri: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at ``uri``; built and written first if there is none, or always with ``rebuild``."""
    if not rebuild:
        try:
            return spark.read.parquet(uri)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(uri)
    return spark.read.parquet(uri)


def save_index(folder: str, **tables: DataFrame) -> None:
    """Each part of an index (parameters, codes, tables, edges, keys) as a table of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
