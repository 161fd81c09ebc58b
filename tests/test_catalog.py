"""Registered queries against their SQL on the smallest tables, and invariants of those without SQL."""

import math
import random

import duckdb
import pytest

from tessera.index import VectorIndex
from tessera.operators import exact, graph, metrics
from tessera.plans import catalog
from tessera.plans.data import points, queries_of, scaled

DIR = "/root/testdata/sf0.001"
SOME = ["mips_exact_topk", "vec_metrics", "norm_partition", "mips_chunk_pruned", "srp_kjoin", "srp_cross_kjoin", "srp_prefix_candidates", "e2lsh_bucket_join", "zorder_key", "llcp_level", "apg_merge", "nn_descent_round", "ratio"]


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DIR}/embeddings.parquet')")
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_query_is_listed():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) >= 50


def _share(spark, found, metric, p):
    truth = exact.knn(p, queries_of(p), 10, metric)
    return metrics.recall(found.select("qid", "id"), truth, 10).first().recall


def test_searches_reach_their_recall(spark):
    p = points(spark, DIR)
    assert _share(spark, catalog.graph_search_l2(spark, DIR), "l2sqr", p) >= 0.9
    assert _share(spark, catalog.lite_search_seeded(spark, DIR), "ip", p) >= 0.9
    s = scaled(spark, DIR)
    assert _share(spark, catalog.lite_search_normfilter(spark, DIR), "ip", s) >= 0.5


def test_searches_reach_their_recall_over_many_shards(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(3000)]
    p = graph.saved(spark.createDataFrame([(i, [c / math.hypot(*v) for c in v]) for i, v in rows], "id long, vec array<double>"))
    monkeypatch.setattr(graph, "SHARD", 250)
    monkeypatch.setattr(catalog, "points", lambda *_: p)
    assert graph.shards(p).select("shard").distinct().count() >= 10
    for name, metric in (("graph_search_ip", "ip"), ("graph_search_l2", "l2sqr")):
        assert _share(spark, catalog.QUERIES[name](spark, DIR), metric, p) >= 0.9, name
    assert _share(spark, VectorIndex().fit(p).search(queries_of(p)), "l2sqr", p) >= 0.9


def test_built_graphs(spark):
    p = points(spark, DIR)
    truth = exact.knn(p, p, 10, "l2sqr", self_too=False)
    for name, least in (("nn_descent", 0.9), ("rnn_descent", 0.1)):
        rows = catalog.QUERIES[name](spark, DIR).collect()
        edges = {(r.src, r.dst) for r in rows}
        assert len(edges) == len(rows) and all(a != b for a, b in edges)
        assert len(edges & {(r.qid, r.id) for r in truth.collect()}) >= least * len(edges), name
    forest = {(r.src, r.dst) for r in catalog.mst_graph(spark, DIR).collect()}
    assert {(b, a) for a, b in forest} == forest


def test_index_facade(spark, tmp_path):
    p = points(spark, DIR)
    VectorIndex().fit(p).save(str(tmp_path))
    again = VectorIndex().load(spark, str(tmp_path))
    assert _share(spark, again.search(queries_of(p)), "l2sqr", p) >= 0.9
    assert again.neighbours_of(spark.createDataFrame([(3,)], "id long")).first().nbrs


def test_graphs_link_points_of_different_parts(spark, monkeypatch):
    rng = random.Random(6)
    p = graph.saved(spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1500)], "id long, vec array<double>"))
    monkeypatch.setattr(graph, "PART", 75, raising=False)
    truth = {(r.qid, r.id): r["rank"] for r in exact.knn(p, p, 10, "l2sqr", self_too=False).collect()}
    found = {(r.src, r.dst) for r in graph.nn_descent(p, 10).collect()}
    assert len(found & set(truth)) >= 0.9 * len(truth)
    forest = {(r.src, r.dst) for r in graph.mst_graph(p, leaf=30, size=75).collect()}
    assert {(b, a) for a, b in forest} == forest
    assert sum(e in forest for e, rank in truth.items() if rank == 1) >= 0.6 * 1500


def test_copies_split_into_bounded_parts(spark):
    p = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "id long, vec array<double>").selectExpr("id", "vec", "0 AS tree")
    parts = graph.split_by_pivots(p, 50, 7).groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 400 and max(r["count"] for r in parts) <= 50


def test_random_edges_connect_the_whole_table(spark):
    n = 3 * 1024
    p = graph.saved(spark.createDataFrame([(i, [float(i)]) for i in range(n)], "id long, vec array<double>"))
    component = list(range(n))

    def root(x):
        while component[x] != x:
            x = component[x]
        return x

    for r in graph.random_edges(p, 12, 3, "l2sqr").collect():
        component[root(r.src)] = root(r.dst)
    assert len({root(i) for i in range(n)}) == 1


def test_a_descent_in_waves_is_the_same(spark, monkeypatch):
    rng = random.Random(8)
    p = graph.saved(spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)], "id long, vec array<double>"))
    whole = sorted(tuple(r) for r in graph.nn_descent(p, 4, rounds=2).collect())
    monkeypatch.setattr(graph, "ROWS", 2000)
    monkeypatch.setattr(graph, "EACH", 5)
    monkeypatch.setattr(graph, "HOLD", 3000)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(batch)
    spark.conf.set(batch, "7")  # nodes go on in the next batch
    try:
        assert sorted(tuple(r) for r in graph.nn_descent(p, 4, rounds=2).collect()) == whole
    finally:
        spark.conf.set(batch, kept)


def _shuffled(spark):
    """Bytes that each stage so far has written for exchanges."""
    gateway = spark.sparkContext._gateway
    none = spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}


def test_pairs_of_a_descent_carry_no_vectors(spark):
    rng = random.Random(9)
    p = graph.saved(spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(256)]) for i in range(1000)], "id long, vec array<double>"))
    start = graph.saved(graph.random_edges(p, 20, 3, "l2sqr"))
    before, small = _shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(small)
    spark.conf.set(small, "-1")  # as large tables are joined
    try:
        assert graph.descent_round(start, start, p, 20, 15, "l2sqr").count() > 19_000
    finally:
        spark.conf.set(small, kept)
    # 15,000 neighbours of 2 KB, compressed (9 MB); each of the 105,000 pairs carried a vector through an exchange (over 20 MB).
    most = max(v for k, v in _shuffled(spark).items() if k not in before)
    assert 1e6 < most < 15e6
