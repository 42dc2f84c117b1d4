import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coweave.llm.bpe import BytePairs
from coweave.llm.encode import count_tokens, decode, encode, rank_file

pytestmark = pytest.mark.skipif(not os.path.exists(rank_file()), reason="no tokenizer files")


@pytest.fixture(scope="module")
def ours():
    return BytePairs.load(rank_file())


@pytest.fixture(scope="module")
def theirs():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(rank_file().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab1 ½²Ⅷ\t\n\r\x1c\x85　é́ſﬁ'sT_-—“٣中🎉\U0001d400​", max_size=40))
def test_any_text_is_encoded_as_by_the_library(ours, theirs, text):
    ids = ours.encode(text)
    assert ids == theirs(text) and ours.count(text) == len(ids) and ours.decode(ids) == text


def test_edges(ours, theirs):
    assert ours.encode(None) == ours.encode("") == [] and ours.count(None) == 0
    for text in (" ", "\n\n", "<|endoftext|>", "I'll we've it's", "x" * 20_000, "ab" * 9_000 + " 12" * 50, "word " * 5_000):
        assert ours.encode(text) == theirs(text)
    assert ours.decode(ours.encode("Straße ſo")) == "Straße ſo"


def test_every_whole_word_of_the_vocabulary_is_one_token(ours):
    whole = [k for k, s in enumerate(ours.strings) if s.isascii() and s.strip().isalpha() and s.lstrip(b" ").isalpha() and s.count(b" ") <= 1]
    assert len(whole) > 20_000 and all(ours.word(ours.strings[k]) == (k,) for k in whole)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr("coweave.llm.bpe.MEMO_WORDS", 5)
    small = BytePairs.load(rank_file())
    text = " ".join(f"w{i}a" for i in range(100)) + " " + "y" * 100
    assert small.decode(small.encode(text)) == text and len(small.memo) <= 5


def test_frames(spark, ours, rows):
    texts = ["Hello  world\r\nnext", None, "", "   ", "long " * 30_000, "Hello  world\r\nnext"]
    df = spark.createDataFrame([(k, t, "x", [1]) for k, t in enumerate(texts)] + [(None, "a", "y", [2])], "doc_id bigint, text string, _text string, ids array<int>")
    found = {r.doc_id: r.ids for r in encode(df).collect()}
    assert found == {k: ours.encode(t) for k, t in enumerate(texts)} | {None: ours.encode("a")}
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {k: len(v) for k, v in found.items()}
    assert {r.doc_id: r.text for r in decode(encode(df)).collect()} == {k: t or "" for k, t in enumerate(texts)} | {None: "a"}
    assert encode(df.where("false")).count() == 0 and encode(df).schema["ids"].dataType.simpleString() == "array<int>"
