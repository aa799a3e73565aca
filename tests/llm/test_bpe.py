import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="no vocabulary file")

TEXTS = [
    "", " ", "\n\n\n  x", "Hello world's  tests\t\r\n", "naïve café — déjà vu", "e\u0301 decomposed", "中文没有空格的文本。", "日本語テキスト", "हिन्दी पाठ", "🙂👩‍👩‍👧 emoji\u200d",
    "a" * 3000, "=" * 5000, "x1y2z3 0x1F 3.14e-10", "<|endoftext|> is text", "\u00a0\u2003 odd blanks \u3000", "def f(x):\n    return {'a': [1, 2]}\n" * 50, "ｆｕｌｌｗｉｄｔｈ 𝔣𝔯𝔞𝔨",
]


def test_ids_equal_both_libraries(spark):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, TEXTS[3]), (101, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id")
    got = bpe.encode(df).collect()
    assert len(got) == len(rows)
    ids = {r.doc_id: list(r.ids) for r in got}
    whole = Tokenizer.from_file(bpe.vocabulary_path())
    whole.encode_special_tokens = True
    fast = bpe._counter(bpe.vocabulary_path())
    for i, t in enumerate(TEXTS):
        assert ids[i] == whole.encode(t, add_special_tokens=False).ids == fast.encode_ordinary(t)
    assert ids[100] == []
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS)) and back[100] == ""


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, ids int, words string, key string")
    assert bpe.encode(df).count() == 0
    df = spark.createDataFrame([("a", "one two", 7, "w")], "doc_id string, text string, ids int, words string")
    assert [r.doc_id for r in bpe.encode(df).collect()] == ["a"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_words_equal_a_compiled_encoder(texts):
    import regex

    encoder, fast = _shared(), bpe._counter(bpe.vocabulary_path())
    words = sorted({w for t in texts for w in regex.findall(bpe.PATTERN, t)})
    if words:
        known = encoder.known
        places = encoder.positions(words)
        known = encoder.known.to_pylist()
        assert [known[p] for p in places] == [fast.encode_ordinary(w) for w in words]


_encoder = []


def _shared():
    if not _encoder:
        _encoder.append(bpe.WordEncoder(bpe.vocabulary_path()))
    return _encoder[0]
