import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm

SCHEMA = "doc_id long, text string, n_tokens string"


def corpus(n=120):
    rng, out = random.Random(5), []
    chain = {f"w{i}": [f"w{(i * 3 + k) % 40}" for k in (1, 2)] for i in range(40)}
    for i in range(n):
        w, words = f"w{rng.randrange(40)}", []
        for _ in range(rng.randint(150, 400)):
            words.append(w)
            w = rng.choice(chain[w])
        out.append((i, " ".join(words).upper() if i % 2 else "\n".join(words), "x"))
    return out


def plain_score(model, words, text):
    ids = [words.index(w) + 1 if w in words else int(lm.TokenIds(words)[w]) for w in (text or "").encode().lower().split()]
    total = 0.0
    for i, t in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else 0 for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.tanh(sum(model["E"][p][c].astype(float) for p, c in enumerate(around)) + model["b"])
        for logits, k in ((h @ model["Wc"] + model["bc"], t // 32), (h @ model["Ww"][t // 32] + model["bw"][t // 32], t % 32)):
            total += logits[k] - math.log(np.exp(logits).sum())
    return total


def test_scores(spark):
    docs = [*corpus(), (500, None, "x"), (501, "", "x"), (502, " \n", "x"), (None, "w1", "x"), (503, "Zz É zz", "x"), (503, "Zz É zz", "x")]
    df = spark.createDataFrame(docs, SCHEMA)
    words = lm.vocabulary(df)
    model = lm.train(df, words)
    got = lm.score(df, words, model).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i in (500, 501, 502):
        assert (by[i].n_tokens, by[i].log_prob, by[i].perplexity) == (0, 0.0, None)
    for i, text, _ in docs[:6] + docs[-3:]:
        assert by[i].log_prob == pytest.approx(plain_score(model, words, text), rel=1e-4)
    # What it learned: held-in order beats shuffled order, and training beats the start.
    rng = random.Random(1)
    ids = lm.TokenIds(words)
    real = [ids.of(t) for _, t, _ in corpus()]
    mixed = [np.array(rng.sample(r.tolist(), len(r)), np.int16) for r in real]
    a, b = (lm.log_probs(model, *lm.windows(x)).mean() for x in (real, mixed))
    assert a > b + 0.1 and a > lm.log_probs(lm.start(), *lm.windows(real)).mean() + 1


def test_gradient_step_lowers_the_loss():
    docs = [lm.TokenIds([b"a", b"b"]).of("a b c " * 50)]
    t, c = lm.windows(docs)
    m, seen = lm.start(), {k: np.zeros(v, np.float32) for k, v in lm.SHAPES.items()}
    before = lm.log_probs(m, t, c).mean()
    for _ in range(20):
        lm.train_batch(m, seen, t, c)
    assert lm.log_probs(m, t, c).mean() > before + 2


def test_empty(spark):
    assert lm.pseudo_likelihood(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_word_is_scored_apart(spark):
    # 40 frequent words and 3000 rare ones, some twice as frequent as others: more than all own and shared ids of a fixed table.
    rng = random.Random(8)
    rare = [f"r{i}" for i in range(3000) for _ in range(1 + i % 2)]
    rng.shuffle(rare)
    docs = [(i, " ".join(w for r in rare[i * 90 : i * 90 + 90] for w in (f"w{rng.randrange(40)}", r)), "x") for i in range(50)]
    df = spark.createDataFrame(docs, SCHEMA)
    words = lm.vocabulary(df)
    model, shared = lm.train(df, words), lm.shared_ids(words)
    seen, by_id = Counter(w for _, t, _ in docs for w in t.encode().split()), Counter()
    for w in seen:
        if w not in words:
            by_id[lm.TokenIds(words)[w]] += seen[w]
    assert len(by_id) == shared[1] and len(seen) > 2 * len(words)
    for r in lm.score(df, words, model).collect():
        text = docs[r.doc_id][1].encode().split()
        apart = sum(math.log(seen[w] / by_id[lm.TokenIds(words)[w]]) for w in text if w not in words)
        assert r.log_prob == pytest.approx(plain_score(model, words, docs[r.doc_id][1]) + apart, rel=1e-4)


def test_the_vocabulary_follows_the_corpus(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    some = lm.vocabulary(spark.createDataFrame([(i, text, "x") for i in range(100)], SCHEMA))
    assert len(some) == 2000
    model = lm.start(some)
    assert model["bw"].size == model["E"].shape[1] >= sum(lm.shared_ids(some))
    assert max(lm.TokenIds(some).of(text + " other words")) < model["bw"].size


def test_large_weights_stay_finite():
    t, c = lm.windows([lm.TokenIds([b"a", b"b"]).of("a b c d " * 40)])
    m = lm.start()
    m["Wc"] *= 300
    m["bc"] += np.arange(lm.CLASSES, dtype=np.float32)
    got = lm.log_probs(m, t, c)
    h = np.tanh(sum(m["E"][p][c[p]].astype(float) for p in range(4)) + m["b"])
    want = np.zeros(len(t))
    for logits, k in ((h @ m["Wc"] + m["bc"], t // 32), (np.einsum("nw,nwk->nk", h, m["Ww"][t // 32]) + m["bw"][t // 32], t % 32)):
        top = logits.max(axis=1)
        want += logits[np.arange(len(t)), k] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))
    assert np.abs(m["Wc"]).sum(axis=0).max() > lm.REACH
    assert got == pytest.approx(np.maximum(want, lm.LEAST), rel=1e-3, abs=1e-3)
    seen = {k: np.zeros(v, np.float32) for k, v in lm.SHAPES.items()}
    lm.train_batch(m, seen, t, c)
    assert all(np.isfinite(v).all() for v in m.values())
