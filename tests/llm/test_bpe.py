import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\t", "Hello wörld, it's 123 ok <|endoftext|> áb", "a<|startoftext|>B<|endoftext|>", "x" * 5000,
    "ab" * 700 + "!" * 300, "ΣΑΣ ΟΔΥΣΣΕΥΣ", "é e ́x", "\x1c\x1d a\x85b  c", "日本語 テキスト 🙂👍🏽", "I'LL don't we've", "İstanbul ß ﬁ",
    "The the THE " * 50,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(library, text):
    own = bpe.load(PATH)
    want = library.encode(text or "", add_special_tokens=False).ids
    assert own.encode(text).tolist() == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_frame(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(back) == 2 * len(TEXTS)
    for row in back:
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.decoded == library.decode(row.ids, skip_special_tokens=False)
    rows = bpe.digests(bpe.round_trip(df, PATH)).collect()
    assert {r.n_tokens for r in rows if r.doc_id < 3} == {0}
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
