import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import encoding

FILE = f"{encoding.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return encoding.PairIndexEncoder(encoding.Merges.load())


def ids(encoder, texts):
    flat, begin = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(begin, begin[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_equals_the_library(library, encoder, texts):
    assert ids(encoder, texts) == [library(t) for t in texts]


def test_repetitions_spaces_and_special_strings(library, encoder):
    texts = ["aaaaaaa", "a" * 3001, " " * 500 + "x", "x\n\n \t y", "<|endoftext|>", "don't we'll I'VE", "\x1c\x1d a\x85b c", "", None, "日本語 👩‍👧 ﷺ"]
    assert ids(encoder, texts) == [library(t) for t in texts]
    assert encoder.counts(texts).tolist() == [len(library(t)) for t in texts]


def test_table(spark, library):
    rows = [(1, "one text"), (2, None), (3, ""), (1, "one text"), (None, "no id"), (4, "x " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as ids")
    out = {r.doc_id: r.ids for r in encoding.encode_texts(df, "doc_id", "text").collect()}
    assert out == {i: library(t) for i, t in rows}
    assert encoding.encode_texts(df.limit(0), "doc_id", "text").count() == 0
