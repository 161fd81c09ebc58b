import numpy as np
import pytest

from tessera.sources import binary, tables


@pytest.fixture(scope="module")
def vectors(spark):
    binary.register(spark)
    rng = np.random.default_rng(0)
    return [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(450)]


def rows(df):
    return sorted((r.id, list(r.vec)) for r in df.collect())


@pytest.mark.parametrize("layout", ["fbin", "fvecs"])
def test_round_trip(spark, vectors, tmp_path, layout):
    path = f"{tmp_path}/x.{layout}"
    df = spark.createDataFrame(vectors, "id long, vec array<float>").repartition(3).orderBy("id")
    df.write.format("vectors").mode("append").option("layout", layout).save(path)
    assert rows(spark.read.format("vectors").load(path)) == vectors
    assert len(list(tmp_path.iterdir())) == 1


def test_data_new_splits_queries(spark, vectors, tmp_path):
    path = f"{tmp_path}/x.data_new"
    spark.createDataFrame(vectors, "id long, vec array<float>").orderBy("id").write.format("vectors").mode("append").save(path)
    assert rows(spark.read.format("vectors").option("part", "queries").load(path)) == vectors[:200]
    assert rows(spark.read.format("vectors").load(path)) == [(i - 200, v) for i, v in vectors[200:]]


def test_strided_and_ragged(spark, vectors, tmp_path):
    rows_only = [v for _, v in vectors]
    # dim stands in the gap before the first row, as in fvecs files.
    data = b"".join(np.array([6], "<u4").tobytes() + np.array(v, "<f4").tobytes() for v in rows_only)
    (tmp_path / "s.bin").write_bytes(data)
    got = spark.read.format("vectors").option("layout", "strided").option("gap", 4).load(f"{tmp_path}/s.bin")
    assert rows(got) == vectors
    (tmp_path / "t.bin").write_bytes(np.array([6, 9], "<u4").tobytes() + data)
    got = spark.read.format("vectors").option("layout", "strided").option("skip", 8).option("gap", 4).load(f"{tmp_path}/t.bin")
    assert rows(got) == vectors
    ragged = [(0, [1, 2, 3]), (1, []), (2, [5])]
    spark.createDataFrame(ragged, "id long, vec array<int>").coalesce(1).write.format("vectors").mode("append").save(f"{tmp_path}/r.ivecs")
    assert rows(spark.read.format("vectors").load(f"{tmp_path}/r.ivecs")) == ragged


def test_graph_and_truth_files(spark, tmp_path):
    binary.register(spark)
    nodes = [(0, [1, 2]), (1, []), (2, [0])]
    spark.createDataFrame(nodes, "src long, nbrs array<long>").coalesce(1).write.format("vectors").mode("append").save(f"{tmp_path}/g.knng")
    assert sorted((r.src, r.nbrs) for r in spark.read.format("vectors").load(f"{tmp_path}/g.knng").collect()) == nodes
    truth = [(q, r, 10 * q + r, 0.5 * r) for q in range(3) for r in range(1, 4)]
    binary.write_truth(spark.createDataFrame(truth, "qid long, rank int, id long, ip double"), f"{tmp_path}/t.truth", 3)
    assert sorted(tuple(r) for r in spark.read.format("vectors").load(f"{tmp_path}/t.truth").collect()) == truth


def test_kept_tables(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    for again in (False, False, True):
        assert tables.kept(spark, f"{tmp_path}/t", build, again).count() == 5
    assert len(made) == 2


def test_layout_names():
    assert [binary.layout_of(p) for p in ("a/deep1B/x", "yandex.bin", "x.fvecs", "audio")] == ["fbin", "fbin", "fvecs", "data_new"]


def test_short_files_raise_and_queries_have_their_own_file(spark, vectors, tmp_path):
    whole = np.array([450, 6], "<u4").tobytes() + np.array([v for _, v in vectors], "<f4").tobytes()
    (tmp_path / "short.fbin").write_bytes(whole[:-9])
    with pytest.raises(Exception, match="ends within row 449"):
        spark.read.format("vectors").load(f"{tmp_path}/short.fbin").count()
    (tmp_path / "x.fbin").write_bytes(whole)
    (tmp_path / "x_query.fbin").write_bytes(np.array([2, 6], "<u4").tobytes() + np.array([v for _, v in vectors[5:7]], "<f4").tobytes())
    assert rows(spark.read.format("vectors").option("part", "queries").load(f"{tmp_path}/x.fbin")) == [(0, vectors[5][1]), (1, vectors[6][1])]
    assert len(rows(spark.read.format("vectors").load(f"{tmp_path}/x.fbin"))) == 450


def test_gathered_and_appended(spark):
    points, ids = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, vec array<double>"), spark.createDataFrame([(1,), (3,), (9,)], "id long")
    some = binary.gathered(points, ids)
    assert sorted(r.id for r in some.collect()) == [1, 3] and binary.appended(some, points).count() == 7
