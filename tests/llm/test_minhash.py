import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import closure, minhash
from tessera.llm.common import Bitmap, materialize

SCHEMA = "doc_id long, text string, kept string, signature string"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(ASCII_LOWER)).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(docs):
    sets, parent = [(i, plain_set(t)) for i, t, *_ in docs], {i: i for i, *_ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def corpus():
    rng, out = random.Random(8), []
    vocabulary = [f"word{i}" for i in range(400)]
    for g in range(25):
        base = rng.choices(vocabulary, k=rng.randint(30, 160))
        for _ in range(rng.choice([1, 1, 2, 4, 12])):
            words = list(base)
            for _ in range(rng.randint(0, len(words) // 14)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words) if g % 2 else "\n".join(words).upper())
    hot = " ".join(rng.choices(vocabulary, k=60))
    out += [hot] * 40
    for _ in range(40):  # near copies of the hot text
        words = hot.split()
        words[rng.randrange(60)] = "changed"
        out.append("  ".join(words))
    out += ["", None, "\n\t ", "a b c", "A B C", "a b", "a b c d e", "É b c d e", "é b c d e", "x " * 3000, "x " * 2999]
    rng.shuffle(out)
    return [(3 * i + 1, t, "k", "s") for i, t in enumerate(out)]


def test_classes_equal_brute_force(spark):
    docs = corpus()
    got = minhash.classify(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == brute(docs)


def test_chain_and_kept_rows(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(words[:40] + [f"y{j}" for j in range(3 * i)] + words[40:]), None, None) for i in range(12)]
    df = spark.createDataFrame(docs, SCHEMA)
    want = brute(docs)
    assert sorted(tuple(r) for r in minhash.classify(df).collect()) == want
    left = minhash.keep_one(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [i for i, _, _, kept in want if kept]


def test_signature_distance(spark):
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    x, y = minhash.signature(a[:4500]), minhash.signature(a[500:])
    lanes = lambda v: v.view(np.uint16)
    want = int((lanes(x) != lanes(y)).sum())
    assert 5 <= want <= 32  # similarity 0.8
    row = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<long>, y array<long>").select(F.struct(F.col("x").alias("signature")).alias("x"), F.struct(F.col("y").alias("signature")).alias("y"))
    assert row.select(minhash.differing("x", "y").alias("d")).first().d == want


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f", "", ""), (4, "a b c d e f", "", ""), (4, "a b c d e f", "", ""), (9, None, "", ""), (None, "x y", "", ""), (None, "X  y", "", ""), (None, None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, (tuple(r) for r in minhash.classify(df).collect())))
    assert got == sorted(map(str, [(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]))
    left = sorted(map(str, ((r.doc_id, (r.text or "").lower().split()) for r in minhash.keep_one(df).collect())))
    assert left == sorted(map(str, [(4, ["a", "b", "c", "d", "e", "f"]), (9, []), (None, ["x", "y"]), (None, [])]))
    assert minhash.classify(spark.createDataFrame([], SCHEMA)).count() == 0 and minhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_two_texts_of_one_id(spark):
    rng = random.Random(1)
    a, b = (" ".join(rng.choices([f"u{i}" for i in range(300)], k=60)) for _ in range(2))
    near = lambda t: t.replace(t.split()[30], "changed", 1)
    docs = [(4, a, "", ""), (4, b, "", ""), (9, near(a), "", ""), (11, near(b), "", ""), (12, "by itself", "", "")]
    df = spark.createDataFrame(docs, SCHEMA)
    assert sorted(tuple(r) for r in minhash.classify(df).collect()) == brute(docs)
    assert sorted(r.doc_id for r in minhash.keep_one(df).collect()) == [4, 12]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 300)] + [(1000, i) for i in range(1001, 1100)]
    got = {r.node: r.label for r in closure.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(61), 300]) and got[150] == got[200] == got[100] == 100 and {got[i] for i in range(1000, 1100)} == {1000}
    assert closure.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_lets_all_keys_through(spark):
    rows = spark.range(5000).withColumn("x", F.xxhash64("id"))
    wanted = materialize(rows.where("id % 50 = 0").select("x"), "wanted")
    kept = rows.where(Bitmap(wanted)(F.col("x")))
    assert kept.join(wanted, "x").count() == 100 and kept.count() < 400
    assert rows.where(Bitmap(wanted.limit(0))(F.col("x"))).count() == 0


def test_large_group_makes_few_pairs(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for d in range(600):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1])):
            words[rng.randrange(60)] = f"x{rng.randrange(400)}"
        docs.append((d, " ".join(words), "", ""))
    seen = []
    links = closure.jaccard_links
    closure.jaccard_links = lambda pairs, *rest: seen.append(pairs.count()) or links(pairs, *rest)
    try:
        got = sorted(tuple(r) for r in minhash.classify(spark.createDataFrame(docs, SCHEMA)).collect())
    finally:
        closure.jaccard_links = links
    assert got == brute(docs) and sum(seen) < 12 * 600


def test_components_without_the_driver(spark, monkeypatch):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(140)], "a long, b long").where("a <> b")
    few = {r.node: r.label for r in closure.components(edges).collect()}
    monkeypatch.setattr(closure, "FEW", 0)
    assert few and {r.node: r.label for r in closure.components(edges).collect()} == few


def test_sketches_part_no_alike_sets(spark):
    rng = np.random.default_rng(7)
    rows = []
    for n in (1, 3, 7, 40, 400, 5000):
        for share in (0.0, 0.5, 0.74, 0.75, 0.8, 1.0):
            both = rng.integers(1, 1 << 63, 2 * n + 2).astype(np.uint64)
            m = int(np.ceil(2 * n * share / (1 + share)))
            x, y = np.unique(both[:n]), np.unique(np.concatenate([both[:m], both[n : 2 * n - m]]))
            rows.append((len(x), len(y), *(minhash.sketch(s).tolist() for s in (x, y)), 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y))))
    df = spark.createDataFrame(rows, "m int, n int, x array<long>, y array<long>, alike boolean")
    got = df.select("alike", "m", closure.may("m", "n", "x", "y", 75).alias("may")).collect()
    assert all(r.may for r in got if r.alike) and sum(r.alike for r in got) >= 12 and not all(r.may for r in got if not r.alike)


def test_joins_are_small_enough_to_be_compiled(spark, monkeypatch):
    """The JVM interprets methods of more than 8,000 bytes of code; each pair of a bucket then took 20 microseconds."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for d in range(60):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(60)] = f"x{d}"
        docs.append((d, " ".join(words), "", ""))
    sizes, plain, mode = [], closure.materialize, spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")

    def written(df, tag):
        if tag == "pairs":
            sizes.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))))
        return plain(df, tag)

    monkeypatch.setattr(closure, "materialize", written)
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        got = sorted(tuple(r) for r in minhash.classify(spark.createDataFrame(docs, SCHEMA)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute(docs) and sizes and max(sizes) < 8000
