"""A vector index to build from a DataFrame and search with another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import graph
from tessera.sources import tables


class VectorIndex:
    """Graph index over points (id, vec); ``search`` gives (qid, rank, id, dist).

    ``ef`` trades time for recall: the number of candidates that a search keeps.
    """

    def __init__(self, metric: str = "l2sqr", neighbours: int = 16, ef: int = 80):
        self.metric, self.neighbours, self.ef, self.body = metric, neighbours, ef, None

    def fit(self, points: DataFrame) -> VectorIndex:
        edges = graph.with_reverse(graph.shard_edges(points, self.neighbours, self.metric), 2 * self.neighbours)
        self.body = graph.searchable(points, edges)
        return self

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return graph.search(self.body, queries, None, k, max(k, self.ef), self.metric)

    def neighbours_of(self, ids: DataFrame) -> DataFrame:
        """(id, nbrs) of the listed ids."""
        return self.body.join(ids.select("id"), "id", "left_semi").select("id", "nbrs")

    def save(self, folder: str) -> None:
        tables.save_index(folder, graph=self.body)

    def load(self, spark: SparkSession, folder: str) -> VectorIndex:
        self.body = tables.load_index(spark, folder, "graph")["graph"]
        return self
