import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": ["the", "ing", "er", "of"], "bb": ["eau", "que", "ment", "é"], "cc": ["der", "sch", "ung", "ü"]}


def corpus(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        out.append((i, " ".join(words), lang, "x"))
    return out


def test_counts_equal_a_plain_loop():
    def plain(text):
        out, m = {}, 0xFFFFFFFF
        s = " "
        for c in (text or "").lower():
            s += c if c.isalpha() else ("" if s[-1] == " " else " ")
        s = s if s[-1] == " " else s + " "
        for n in (2, 3):
            for i in range(len(s) - n + 1):
                if s[i : i + n].strip():
                    h = ord(s[i]) * 0x9E3779B1 & m
                    for c in s[i + 1 : i + n]:
                        h ^= h >> 15
                        h = (h * 0x85EBCA6B + (ord(c) * 0x9E3779B1 & m)) & m
                    h = (h ^ h >> 16) * 0xC2B2AE35 & m
                    out[h >> 19] = out.get(h >> 19, 0) + 1
        return out

    texts = ["The  cat, sat!", None, "", "12 34 !!", "éa ß 語", "a", "x\ny" * 40]
    for text, row in zip(texts, langid.counts(texts), strict=True):
        assert {i: int(v) for i, v in enumerate(row) if v} == plain(text)


def test_held_out_accuracy(spark):
    rows = [*corpus(), (900, None, "aa", "x"), (901, "1 2 3 ?", "aa", "x"), (902, "", None, "x"), (None, "the ing of", None, "x"), (5, corpus()[5][1], "cc", "x")]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in corpus()}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 30 and all(r.lang_pred == truth[r.doc_id] and not r.rejected for r in tested)


def test_prediction_is_the_nearest_centre(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    model = langid.fit(df, F.lit(True))
    assert len(model.names) == 3 * langid.CENTROIDS
    text = corpus()[7][1]
    row = langid.counts([text])[0]
    v = [math.log1p(int(c)) * float(i) for c, i in zip(row, model.idf, strict=True)]
    norm = math.sqrt(sum(x * x for x in v))
    near = [sum(x / norm * float(y) for x, y in zip(v, c, strict=True)) for c in model.rows]
    name, score, _ = model.predict([text])[0]
    assert name == model.names[int(np.argmax(near))] and abs(score - max(near)) < 1e-5


def test_far_text_is_rejected_and_kept_rows_are_whole(spark):
    df = spark.createDataFrame([*corpus(), (700, "жщ ждщ", "aa", "x"), (701, None, None, None)], SCHEMA)
    model = langid.fit(df.where("doc_id < 700"), F.lit(True))
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(240))


def test_random_and_foreign_text_of_the_same_script_is_rejected(spark):
    model = langid.fit(spark.createDataFrame(corpus(), SCHEMA), F.lit(True))
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    foreign = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. "
    for text in (letters(300), letters(3000), "".join(rng.choices("0123456789abcdef ", k=2000)), foreign * 3):
        assert model.predict([text])[0][2], text[:40]
    assert not any(model.predict([t])[0][2] for _, t, _, _ in corpus())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert langid.identify(df).count() == 0
    assert langid.fit(df, F.lit(True)).predict(["abc"]) == [("und", 0.0, True)]
