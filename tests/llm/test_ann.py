import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            cos = [(-float(ann.dot(x, y)) / (math.sqrt(ann.dot(y, y)) * math.sqrt(ann.dot(x, x))), i) for i, y in ok if i != q and len(y) == len(x)]
            out[q] = [(i, -c) for c, i in sorted(cos)[:k]]
    return out


def cases():
    rng = np.random.default_rng(4)
    mid = rng.normal(size=(12, 16))
    rows = [(i, (mid[i % 12] + 0.4 * rng.normal(size=16)).tolist(), 1, "x") for i in range(900)]
    rows += [(2000 + i, [1.0] * 16, 1, "x") for i in range(300)]  # one very common vector
    rows += [(3000, None, 1, "x"), (3010, [], 1, "x"), (3020, [0.0] * 16, 1, "x"), (3030, [float("nan")] * 16, 1, "x"), (3040, [None] + [1.0] * 15, 1, "x"), (3050, [float("inf")] * 16, 1, "x"), (None, [1.0] * 16, 1, "x")]
    rows += [(4000, [1.0, 2.0], 1, "x"), (4001, [2.0, 1.0], 1, "x"), (20, rows[20][1], 1, "x")]
    return rows


def test_exact_with_factor_one(spark):
    rows = cases()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = {q: w for q, w in brute(rows, 10, 5).items() if w}
    assert set(got) == set(want)
    for q in want:
        assert got[q] == want[q], q


def test_factor_trades_recall_for_distances():
    rows = [r for r in cases()[:900]]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    tree, asked = ann.VpTree(ids, x), np.arange(0, 900, 10)
    exact, cost = tree.search(ids[asked], x[asked], 5, 1.0)
    less, cheaper = tree.search(ids[asked], x[asked], 5, 3.0)
    truth = {(q, i) for q, i, _ in exact}
    assert cheaper < cost and len({(q, i) for q, i, _ in less} & truth) >= 0.9 * len(truth)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(10 * i, [1.0, float(i)], 1, "x") for i in range(n)], SCHEMA)
    assert ann.nearest(df, F.lit(True)).count() == n * (n - 1)


def test_copies_of_a_shard_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rows = cases()
    df = spark.createDataFrame(rows, SCHEMA).union(spark.createDataFrame(rows[::7], SCHEMA))
    out = ann.nearest(df, F.col("vec_id") % 10 == 0)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out.collect()}
    assert got == {(q, i + 1): x for q, w in brute(rows, 10, 5).items() for i, x in enumerate(w)}
    # Trees had a copy for each lane; a join's side of few trees was broadcast with all their copies.
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_keep_double_precision(spark):
    rows = [(10 * i, [1.0, 0.1 * i, 1e300], 1, "x") for i in range(1, 9)]
    packed, _ = ann.blocks(ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")))
    block = packed.first()
    ids, x = ann.unpack(block.ids, block.vectors, block.dim)
    assert sorted(zip(ids.tolist(), x.tolist(), strict=True)) == [(i, v) for i, v, *_ in rows]
