"""Euclidean LSH: compound keys, Z-order keys, and multi-probe search with the asymmetric lift."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import exact, kernels


def parameters(dim: int, tables: int, k: int, width: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and offsets in [0, width), rounded so that a text holds them exactly."""
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(tables * k, dim)), 6), np.round(rng.uniform(0, width, tables * k), 6)


def project(points: DataFrame, a: np.ndarray, b: np.ndarray, width: float) -> DataFrame:
    """points with ``h``: (<x, a> + b) / width for each direction, not floored."""
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = exact.matrix(batch.column(names.index("vec"))) if batch.num_rows else np.zeros((0, a.shape[1]))
            h = (np.stack([kernels.dot(x, row[None]) for row in a], axis=1) + b) / width
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(b))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(h.ravel()))], [*names, "h"])

    return points.mapInArrow(run, f"{points.schema.toDDL()}, h array<double>")


def bucket_keys(projected: DataFrame, tables: int, k: int) -> DataFrame:
    """(id, tbl, key): the floored values of each table; the whole array is the key, so different values never meet."""
    floors = F.transform("h", lambda v: F.floor(v))
    parts = F.array(*[F.slice(floors, t * k + 1, k) for t in range(tables)])
    return projected.select("id", F.posexplode(parts).alias("tbl", "key"))


def bucket_join(keys: DataFrame, query_keys: DataFrame) -> DataFrame:
    """Distinct (qid, id) that share a key in some table."""
    q = query_keys.select(F.col("id").alias("qid"), "tbl", "key")
    return keys.join(q, ["tbl", "key"]).select("qid", "id").distinct()


def spread(projected: DataFrame) -> DataFrame:
    """(hash, low, high) of each projection."""
    return projected.select(F.posexplode("h").alias("hash", "v")).groupBy("hash").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def normalisation(projected: DataFrame, tables: int, k: int) -> tuple[list[float], list[float], int]:
    """Shift and factor of each projection, and the bits u that all of them then fit in, u * k < 64."""
    rows = sorted(spread(projected).collect(), key=lambda r: r["hash"])
    limit = 2 ** (63 // k) - 1
    shifts = [-math.floor(r["low"]) for r in rows]
    ranges = [math.floor(r["high"]) + s for r, s in zip(rows, shifts, strict=True)]
    factors = [min(1.0, limit / max(r, 1)) for r in ranges]
    top = max([1, *(math.floor(r * f) for r, f in zip(ranges, factors, strict=True))])
    return [float(s) for s in shifts], factors, int(math.log2(top)) + 1


def z_keys(projected: DataFrame, tables: int, k: int, shifts: list[float], factors: list[float], bits: int) -> DataFrame:
    """(id, tbl, z): Morton keys of the shifted, scaled and clipped values."""
    cells = F.array(*[F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor((F.col("h")[i] + F.lit(s)) * F.lit(f)))).cast("bigint") for i, (s, f) in enumerate(zip(shifts, factors, strict=True))])
    out = projected.select("id", cells.alias("cells"))
    keys = []
    for t in range(tables):
        # Bit b of value i stands at place b * k + (k - 1 - i).
        terms = [F.shiftleft(F.shiftright(F.col("cells")[t * k + i], b).bitwiseAND(F.lit(1)), b * k + k - 1 - i) for b in range(bits) for i in range(k)]
        key = terms[0]
        for term in terms[1:]:
            key = key.bitwiseOR(term)
        keys.append(key)
    return out.select("id", F.posexplode(F.array(*keys)).alias("tbl", "z"))


def longest_prefix(keys: DataFrame, query_keys: DataFrame, k: int, least: int) -> DataFrame:
    """(qid, id, llcp): the candidates with the longest common prefix with the query in any table, ``least`` and the ties of the last.

    Rows are met through equal prefixes: of each cut, only those of queries that are
    not yet served at a longer one.
    """
    q = query_keys.select(F.col("id").alias("qid"), "tbl", F.col("z").alias("qz"))
    cuts = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("cut")
    cells = keys.select("tbl", "z", cuts).groupBy("tbl", "cut", F.expr("shiftright(z, cut)").alias("cell")).count()
    sizes = q.select("qid", "tbl", "qz", cuts).withColumn("cell", F.expr("shiftright(qz, cut)")).join(cells, ["tbl", "cut", "cell"]).groupBy("qid", "cut").agg(F.sum("count").alias("n"))
    chosen = sizes.where(F.col("n") >= least).groupBy("qid").agg(F.min("cut").alias("cut"))
    wanted = q.join(chosen, "qid", "left").withColumn("cut", F.coalesce("cut", F.lit(63))).withColumn("cell", F.expr("shiftright(qz, cut)"))
    used = keys.crossJoin(F.broadcast(wanted.select("cut").distinct())).withColumn("cell", F.expr("shiftright(z, cut)"))
    met = used.join(wanted, ["tbl", "cut", "cell"]).select("qid", "id", vector.common_prefix("z", "qz").alias("llcp"))
    return met.groupBy("qid", "id").agg(F.max("llcp").alias("llcp"))


def low_dimension_filter(pairs: DataFrame, bound: Column, k: int, width: float, quantile: float = 5.37302) -> DataFrame:
    """pairs (h, qh, ...) whose projected distance does not rule them out: |h - qh|^2 * (width / quantile)^2 < bound."""
    return pairs.where(vector.l2sqr("h", "qh") * F.lit((width / quantile) ** 2) < bound)


def collision_probability(distance: Column, width: float) -> Column:
    """Chance that two points at this distance fall into one cell of a projection."""
    r = F.lit(width) / F.greatest(distance, F.lit(1e-12))
    # Normal distribution by the logistic approximation of its tail, computed, not looked up.
    cdf = F.lit(1.0) / (1 + F.exp(-(F.lit(1.5976) * r + F.lit(0.07056) * F.pow(r, 3))))
    return 2 * cdf - 1 - F.lit(2.0) / (F.lit(math.sqrt(2 * math.pi)) * r) * (1 - F.exp(-r * r / 2))


def sign_of(key: Column) -> Column:
    """+1 or -1 by a hash that any engine can compute."""
    return F.when((key * 7919 + 13) % 127 % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def lift(chunked: DataFrame, stats: DataFrame) -> DataFrame:
    """chunked with ``lifted``: sign * sqrt(max_norm2 of the chunk - norm2) appended."""
    return chunked.join(F.broadcast(stats.select("chunk_id", "max_norm2")), "chunk_id").withColumn("lifted", vector.lifted("vec", "max_norm2", sign_of(F.col("id"))))
