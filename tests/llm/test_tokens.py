import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm.tokens import Encoder, decode_corpus, encode_corpus

ENC = Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIB.encode_special_tokens = True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_ids_equal_the_library_and_decode_back(texts):
    got = ENC.encode(texts)
    assert got == [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]
    assert ENC.decode(got) == texts


def test_special_strings_long_words_and_runs():
    texts = ["<|endoftext|>", "a" * 20_000, "ab" * 3000, " " * 999, "日本語" * 700, "I'll  don't\n\n x", None, ""]
    assert ENC.encode(texts) == [e.ids for e in LIB.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_decoding_keeps_nulls_and_repeats_and_refuses_unknown_ids():
    assert ENC.decode([None, [], [31373], [31373], [220, 220]]) == [None, "", "hello", "hello", "  "]
    with pytest.raises(ValueError):
        ENC.decode([[31373, 10**8]])


def test_corpus(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, " ", 4), (None, "hello hello", 5)], "doc_id long, text string, ids int").drop("ids")
    got = encode_corpus(df, "doc_id", "text")
    assert {(r[0], tuple(r[1])) for r in got.collect()} == {(1, ()), (2, ()), (2, (220,)), (None, (31373, 23748))}
    assert {tuple(r) for r in decode_corpus(got, "doc_id", "ids").collect()} == {(1, ""), (2, ""), (2, " "), (None, "hello hello")}
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
