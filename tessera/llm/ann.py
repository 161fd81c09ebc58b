"""Nearest neighbours by vantage-point trees, one per shard.

Vectors of length one are searched by Euclidean distance, which orders as the cosine
does and obeys the triangle inequality.  Each node splits its points at the median
distance ``mu`` from a vantage point; a query whose k-th best distance so far is
``tau`` skips the inner side if d - mu > tau / factor and the outer side if
mu - d > tau / factor.  ``factor`` 1 is exact search; a larger one visits less.  All
queries of a block walk a tree together, those that still need a node in one product.

Rows with equal vectors can only fill the k places with their smallest ids, so at most
k + 1 of them are indexed; nothing is lost, and a very common vector is no hot group.

Defined results: null, empty or zero vectors and those with null or non-finite
components take no part, neither do rows without id or vectors of another length than
the query's; ties go to the smaller id; a repeated id counts once per distinct vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Points of a leaf, of a shard, queries of a block, and blocks of a lane at most.
LEAF, SHARD, BLOCK, LANE = 128, 16384, 512, 64
#: Tasks below which a shard is copied to more lanes.
TASKS = 32
#: Room for rounding in the comparison of distances: sqrt(2 - 2 x.y) is off by up to about 3e-8 near zero.
SLACK = 1e-7
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding array<double>, dim) of the rows that take part."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    return v.withColumn("dim", F.size("embedding"))


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums along the last axis from left to right, as SQL sums a list."""
    out = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
    for i in range(x.shape[-1]):
        out = out + x[..., i] * y[..., i]
    return out


class VpTree:
    """A shard's tree as arrays; ``order`` deals the points to the leaves."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[by], points[by]
        self.norms = np.sqrt(dot(self.points, self.points))
        scale = np.abs(self.points).max(axis=1, keepdims=True)  # no overflow in the squares
        unit = self.points / scale
        self.units = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # (vantage, mu, inner, outer) or (start, end)
        self._build(0, len(ids))

    def _build(self, a: int, b: int) -> int:
        at = len(self.nodes)
        self.nodes.append((a, b))
        if b - a <= LEAF:
            return at
        some = self.order[a:b]
        # The point furthest from the mean is a vantage point whose distances spread.
        vantage = int(some[np.argmin(self.units[some] @ self.units[some].mean(axis=0))])
        far = self._distance(self.units[vantage][None], self.units[some])[0]
        by = np.argsort(far, kind="stable")
        self.order[a:b] = some[by]
        half = a + (b - a) // 2
        mu = float(far[by[half - a]])
        inner = self._build(a, half)
        outer = self._build(half, b)
        self.nodes[at] = (vantage, mu, inner, outer)
        return at

    @staticmethod
    def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[list[tuple[int, int, float]], int]:
        """(query_id, vec_id, cosine) of each query's k best here, its own id left out, and the distances computed."""
        scale = np.abs(queries).max(axis=1, keepdims=True)
        units = queries / scale
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        n = len(queries)
        best = np.full((n, k), np.inf)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, point, distance
        cost = 0
        # Each query goes to the nearer side first: a first descent to one leaf sets tau, the second visits what is left.
        first_leaf = np.full(n, -1)

        def leaf(a: int, b: int, some: np.ndarray) -> None:
            nonlocal cost
            inside = self.order[a:b]
            far = self._distance(units[some], self.units[inside])
            far[self.ids[inside][None, :] == query_ids[some][:, None]] = np.inf
            cost += far.size
            nearer = np.flatnonzero(far.min(axis=1) <= best[some, -1] + SLACK)
            some, far = some[nearer], far[nearer]
            best[some] = np.sort(np.partition(np.concatenate([best[some], far], axis=1), k - 1, axis=1)[:, :k], axis=1)
            # Rounding may turn ties around: what is as near as the k-th, but for SLACK, is held.
            row, col = np.nonzero((far <= best[some][:, -1:] + SLACK) & np.isfinite(far))
            held.append((some[row], inside[col], far[row, col]))

        def descend(node: int, some: np.ndarray) -> None:
            nonlocal cost
            while len(some):
                entry = self.nodes[node]
                if len(entry) == 2:
                    first_leaf[some] = node
                    leaf(*entry, some)
                    return
                vantage, mu, inner, outer = entry
                d = self._distance(units[some], self.units[vantage][None])[:, 0]
                cost += len(some)
                descend(inner, some[d < mu])
                node, some = outer, some[d >= mu]

        def visit(node: int, some: np.ndarray) -> None:
            nonlocal cost
            if not len(some):
                return
            entry = self.nodes[node]
            if len(entry) == 2:
                left = some[first_leaf[some] != node]
                if len(left):
                    leaf(*entry, left)
                return
            vantage, mu, inner, outer = entry
            d = self._distance(units[some], self.units[vantage][None])[:, 0]
            cost += len(some)
            near = d < mu
            # Both sides in the order that serves most queries; tau is read anew for the second.
            for side in (True, False) if near.mean() >= 0.5 else (False, True):
                gap = d - mu if side else mu - d
                keep = gap <= best[some][:, -1] / factor + SLACK
                visit(inner if side else outer, some[keep])

        everyone = np.arange(n)
        descend(0, everyone)
        visit(0, everyone)
        q, p, far = (np.concatenate(x) for x in zip(*held, strict=True))
        near = far <= best[q, -1] + SLACK
        q, p = q[near], p[near]
        cosine = dot(self.points[p], queries[q]) / (self.norms[p] * np.sqrt(dot(queries, queries))[q])
        by = np.lexsort((self.ids[p], -cosine, q))
        q, p, cosine = q[by], p[by], cosine[by]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return list(zip(query_ids[q[first]].tolist(), self.ids[p[first]].tolist(), cosine[first].tolist(), strict=True)), cost


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def distinct(vectors: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(vec_id, embedding, dim) of usable vectors, at most k + 1 rows of one value and each row once; and the number of shards."""
    # Equal rows share a rank and a dense rank, so one exchange by value serves both.
    few = Window.partitionBy("dim", "embedding").orderBy("vec_id")
    v = vectors.withColumns({"copy": F.dense_rank().over(few), "tie": F.rank().over(few), "place": F.row_number().over(few)})
    v = materialize(v.where((F.col("copy") <= k + 1) & (F.col("tie") == F.col("place"))).select("vec_id", "embedding", "dim"), "ann-vectors")
    return v, max(1, -(-v.count() // SHARD))


def blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """(dim, block, ids, vectors): queries dealt into blocks of about BLOCK; and the number of blocks."""
    n = max(1, -(-queries.count() // BLOCK))

    def pack(rows: pa.Table) -> pa.Table:
        x = _matrix(rows["embedding"].combine_chunks())
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        x = short if (short == x).all() else x
        return pa.table({"dim": rows["dim"][:1], "block": rows["block"][:1], "ids": pa.array([rows["vec_id"].to_numpy().tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary())})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, vectors binary"), n


def unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids and vectors, which are in float32 where that holds them exactly."""
    q = np.frombuffer(ids, np.int64)
    return q, np.frombuffer(vectors, np.float32 if len(vectors) == 4 * dim * len(q) else np.float64).reshape(len(q), dim).astype(float)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the k nearest rows of each query row, its own id left out.

    ``vectors`` has vec_id and embedding.  The points of a shard (dealt by id hash) meet
    the blocks of queries of a lane in one group, where their tree is built and walked.
    Every shard has a copy in every lane, and every block one in every shard.  Groups
    are dealt by exchanges: as a join, the copies could be broadcast on an estimate that
    doesn't count them.
    """
    rows = usable(vectors)
    queries = rows.where(is_query).dropDuplicates(["vec_id"])
    points, n_shards = distinct(rows, k)
    packed, n_blocks = blocks(queries)
    lanes = max(-(-n_blocks // LANE), min(n_blocks, -(-TASKS // n_shards)))

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        got = []
        if some.num_rows and asked.num_rows:
            tree = VpTree(some["vec_id"].to_numpy(), _matrix(some["embedding"].combine_chunks()))
            for ids, x in zip(asked["ids"], asked["vectors"], strict=True):
                got += tree.search(*unpack(ids.as_py(), x.as_py(), some["dim"][0].as_py()), k, factor)[0]
        return pa.table({c: pa.array([g[i] for g in got], t) for i, (c, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")).withColumn("lane", every(lanes))
    sent = packed.select("dim", every(n_shards).alias("shard"), F.pmod("block", F.lit(lanes)).alias("lane"), "ids", "vectors")
    by = ["dim", "shard", "lane"]
    found = dealt.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(run, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
