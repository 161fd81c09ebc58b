import itertools
import random
import time

import pytest

from tessera.llm import decontam as dc

SCHEMA = "doc_id long, text string, item_id string, words string"
ITEMS = "item_id long, text string, doc_id string"


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.lower().split(" ") if w]


def brute(docs, items):
    """Every window of every item against every place of every document."""
    out = {}
    for d, text, *_ in docs:
        x = split(text)
        for i, item, *_ in items:
            y = split(item)
            m = len(y)
            size = min(m, dc.WINDOW)
            if not size:
                continue
            need = -(-size * dc.PERCENT // 100) if m >= dc.WHOLE else m
            for shift in range(-m, len(x)):
                same = [0 <= shift + q < len(x) and x[shift + q] == y[q] for q in range(m)]
                for start in range(m - size + 1):
                    if (n := sum(same[start : start + size])) >= need:
                        best = out.get((d, i), (0, size, shift + start))
                        out[d, i] = (max(n, best[0]), size, min(shift + start, best[2]))
    return sorted((d, i, *v) for (d, i), v in out.items())


@pytest.mark.parametrize(("masks", "n", "k"), [(dc.LONG, 15, 3), (dc.LONG, 16, 3), (dc.MIDDLE, 10, 2), (dc.MIDDLE, 14, 2)])
def test_masks_are_lossless(masks, n, k):
    assert 100 * (n - k) >= dc.PERCENT * n > 100 * (n - k - 1)
    for gone in itertools.combinations(range(n), k):
        assert any(not any(s + o in gone for o in mask) for mask in masks for s in range(n - mask[-1])), gone


def tables():
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([10, 12, 14, 15, 16, 17, 30, 59])), "x") for i in range(14)]
    items += [(50, "three short words", "x"), (51, "One", "x"), (52, "", "x"), (53, None, "x"), (0, items[0][1], "x"), (54, items[0][1], "x")]
    docs = []
    for k in range(60):
        words = text(rng.randint(0, 80)).split()
        passage = split(items[k % 14][1])
        for _ in range(k % 5):
            passage[rng.randrange(len(passage))] = "changed"
        if k % 3:
            at = rng.randint(0, len(words))
            words[at:at] = passage if k % 2 else passage[rng.randrange(6) :]
        docs.append((k, (" " if k % 2 else "\n").join(words).title(), "x", "y"))
    docs += [(100, None, "x", "y"), (101, "", "x", "y"), (102, "THREE  short\twords", "x", "y"), (103, "and one more", "x", "y"), (1, docs[1][1], "x", "y"), (104, " ".join([text(3000), items[4][1], text(3000)]), "x", "y")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert len(want) > 20
    assert sorted(tuple(r) for r in dc.overlaps(d, b).collect()) == want
    left = dc.without(d, b)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in docs if r[0] not in {w[0] for w in want})


def test_large_benchmarks_give_the_same(spark, monkeypatch):
    docs, items = tables()
    monkeypatch.setattr(dc, "BLOCK_SEEDS", 90)
    monkeypatch.setattr(dc, "BITS", 1 << 8)
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    assert sorted(tuple(r) for r in dc.overlaps(d, b).collect()) == brute(docs, items)


def test_empty_and_null_ids(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    assert dc.overlaps(d.limit(0), b).count() == 0 and dc.overlaps(d, b.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, items[3][1], "", "")], SCHEMA)
    assert [(r.doc_id, r.item_id) for r in dc.overlaps(odd, b).collect()] == [(None, 3)] and dc.without(odd, b).count() == 1


def test_time_is_linear_in_a_document(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(600_000)]
    items = spark.createDataFrame([(1, " ".join(words[70:110]), "")], ITEMS)

    def seconds(n):
        cut = len(words) // n
        df = spark.createDataFrame([(i, " ".join(words[i * cut : i * cut + cut]), "", "") for i in range(n)], SCHEMA).repartition(1).cache()
        df.count()
        took = []
        for _ in range(2):
            began = time.time()
            assert dc.overlaps(df, items).count() == 1
            took.append(time.time() - began)
        return min(took)

    many, one = seconds(200), seconds(1)
    assert one < 3 * many + 2
