import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokenbin
from tessera.llm.common import shared_dir
from tests.llm.test_bpe import TEXTS

PATH = public_tokenizers.path("word_bpe_49k.json")


def want(docs):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    docs = [(3 * i - 5, t) for i, t in enumerate(TEXTS)] + [(1000 + i, f"Word{i % 7}, the thing number {i}. " * 20) for i in range(300)]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, start string")
    folder = shared_dir(spark, "tokens")
    parts = tokenbin.write(df, PATH, folder)
    rows = tokenbin.read(parts, with_ids=True).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want(docs)
    library = Tokenizer.from_file(PATH)
    files = sorted(glob.glob(folder[len("file://"):] + "/part-*.tkz"))
    assert files
    held = [x for f in files for x in tokenbin.Part("file://" + f).get(1007)]
    assert [x.tolist() for x in held] == [[*library.encode(dict(docs)[1007], add_special_tokens=False).ids, 2]]


def test_other_dictionary_is_refused(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    folder = shared_dir(spark, "tokens")
    file = tokenbin.write(df, PATH, folder).first().file
    with open(folder[len("file://"):] + "/dictionary.zdict", "wb") as f:
        f.write(b"other")
    with pytest.raises(ValueError):
        tokenbin.Part(file)


def test_nulls_ties_and_empty(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, "x"), (4, None), (4, "b"), (4, "b"), (-2, "")], schema)
    rows = tokenbin.archive(spark, df, PATH).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in rows) == [(False, 0, 2), (True, -2, 1), (True, 4, 1), (True, 4, 2), (True, 4, 2)]
    assert sorted(r.start for r in rows)[0] == 0 and sum(r.n_tokens for r in rows) == 8
    assert tokenbin.archive(spark, spark.createDataFrame([], schema), PATH).count() == 0
