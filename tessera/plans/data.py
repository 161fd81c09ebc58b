"""Inputs of the registered queries: the whole embeddings table, plain and with lengths that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec) of embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points, each multiplied by 1 + (id mod 13) / 4, so that norms differ."""
    p = points(spark, sf_dir)
    factor = F.lit(1.0) + (F.col("id") % 13) * F.lit(0.25)
    return p.select("id", F.transform("vec", lambda v: v * factor).alias("vec"))


def queries_of(p: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return p.where("id % 100 = 0")


#: The same in SQL, to put before a query.
POINTS_SQL = "points AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), queries AS (SELECT id AS qid, vec AS qvec FROM points WHERE id % 100 = 0)"
SCALED_SQL = "points AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * (1.0::DOUBLE + (vec_id % 13) * 0.25::DOUBLE)) AS vec FROM embeddings), queries AS (SELECT id AS qid, vec AS qvec FROM points WHERE id % 100 = 0)"
