import hashlib
import random

import corpus_pipeline as cp
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import langid
from tests.llm import test_decontam, test_linededup, test_minhash
from tests.llm.test_langid import SYLLABLES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(items):
    rng, out = random.Random(31), []
    for i in range(150):
        lang = sorted(SYLLABLES)[i % 3]
        word = lambda lang=lang: "".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 4)))
        lines = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(1, 5))]
        if i % 5 == 1 and out:
            words = out[-1][1].split(" ")
            words[rng.randrange(len(words))] = word()
            lines = " ".join(words).split("\n")
        if i % 11 == 0:
            lines.insert(0, "one footer line that all of these share")
        if i % 13 == 0:
            lines.append(items[i % 7][1])
        out.append((2 * i, "\n".join(lines), lang if i % 7 else None, f"s{i % 4}", 0))
    # The same words in other lines: no equal lines, and yet near copies.
    out += [(700 + k, d[1].replace("\n", " "), d[2], d[3], 0) for k, d in enumerate([d for d in out if d[1].count("\n") >= 3][:6])]
    return out + [(901, None, "aa", "s", 0), (902, "", None, "s", 0), (903, "12 345 !", "aa", "s", 0), (904, out[0][1], "aa", "s", 0), (905, out[40][1], None, None, None)]


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    items = [(i, " ".join("".join(rng.choices(SYLLABLES["aa"], k=3)) for _ in range(25))) for i in range(7)]
    docs = documents(items)
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in cp.run(spark, str(tmp_path)).collect()}

    df = spark.createDataFrame(docs, COLUMNS)
    model = langid.fit(df, ~langid.held_out(F.col("doc_id")))
    kept = [d for d in docs if not model.predict([d[1]])[0][2]]
    assert {d[0] for d in docs} - {d[0] for d in kept} == {901, 902, 903}
    gone = {(d, i) for d, i, *_ in test_linededup.brute(kept)}
    lines = [(d[0], "\n".join(x for i, x in enumerate(d[1].split("\n")) if (d[0], i) not in gone)) for d in kept]
    lines = [(d, t) for d, t in lines if t.split()]
    one = {d for d, _, _, k in test_minhash.brute(lines) if k}
    left = [(d, t) for d, t in lines if d in one]
    leaks = {w[0] for w in test_decontam.brute(left, items)}
    assert leaks and len(left) < len(lines) < len(kept)
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for d, t in left:
        if d not in leaks:
            ids = library.encode(t, add_special_tokens=False).ids
            want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want


def test_stages_keep_the_columns(spark):
    df = spark.createDataFrame(documents([(i, "x") for i in range(7)])[:30], COLUMNS)
    for name, stage in cp.STAGES[:3]:
        assert stage(spark, df, "").columns == df.columns, name
