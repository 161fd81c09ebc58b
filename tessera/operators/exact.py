"""Exact k-nearest joins.  Every block of queries meets every block of points once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import kernels

#: Rows of a block: the distance matrix of two blocks takes 64 MB.
POINTS, QUERIES = 4096, 2048
FOUND = "qid long, id long, dist double"


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def blocks(rows: DataFrame, size: int, extra: str = "") -> tuple[DataFrame, int]:
    """(block, ids, vectors) of rows (id, vec), dealt by id hash; and the number of blocks."""
    n = max(1, -(-rows.count() // size))

    def pack(part: pa.Table) -> pa.Table:
        return pa.table({"block": part["block"][:1], "ids": pa.array([part["id"].to_numpy().tobytes()], pa.binary()), "vectors": pa.array([matrix(part["vec"].combine_chunks()).tobytes()], pa.binary())})

    dealt = rows.select("id", "vec").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, vectors binary"), n


def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors).reshape(len(i), -1)


def top(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, dist): the k best of each query, ties to the smaller id."""
    best = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "ip", self_too: bool = True) -> DataFrame:
    """(qid, rank, id, dist) of the k nearest points (id, vec) of each query (id, vec)."""
    packed_points, n = blocks(points, POINTS)
    packed_queries, _ = blocks(queries, QUERIES)
    sent = packed_queries.select(F.col("ids").alias("qids"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, pi, pv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = kernels.nearest(*unpack(qi, qv), *unpack(pi, pv), k, metric, self_too)
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], ["qid", "id", "dist"])

    met = sent.join(packed_points, "block").select("qids", "queries", "ids", "vectors")
    return top(met.mapInArrow(run, FOUND), k)


def pairs(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Every query (id, vec, ...) with every point: (qid, qvec, id, vec, ...).  For a stated, small query set."""
    q = queries.select(*[F.col(c).alias({"id": "qid", "vec": "qvec"}.get(c, f"q_{c}")) for c in queries.columns])
    return points.crossJoin(q)


def scored(candidates: DataFrame, points: DataFrame, queries: DataFrame, metric: str = "ip") -> DataFrame:
    """(qid, id, dist) of candidate pairs (qid, id); vectors are fetched only for them."""
    p = points.select("id", "vec")
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return candidates.select("qid", "id").join(p, "id").join(q, "qid").select("qid", "id", vector.METRICS[metric]("vec", "qvec").alias("dist"))


def rerank(candidates: DataFrame, points: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    return top(scored(candidates.select("qid", "id").distinct(), points, queries, metric), k)


def sample(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows in the order of a seeded hash: a control set, or a shuffle when n covers all."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def is_query(key: Column) -> Column:
    """The stated query set: ids divisible by 100."""
    return key % 100 == 0
