import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ALPHABET = "abehnorstti eE▁ \n\t059Ž日🙂\x00\xa0é.-͸<>"


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.sampled_from(ALPHABET), max_size=60) | st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_same_as_the_library(library, text):
    own = pieces.tokenizer(MODEL)
    ids = own.encode(text)
    assert ids == library.encode(text)
    assert own.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(7)
    own = pieces.tokenizer(MODEL)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(own.size), rng.randrange(3, 259), 0, 1, 2, 259, 28705]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)
    with pytest.raises(ValueError):
        own.decode([-1])


@pytest.mark.parametrize("text", ["ab" * 40000, " " * 30000 + "\n" * 30000, "the" * 20000 + " 日本" * 1000, "ÿ" * 5000])
def test_long_stretches(library, text):
    assert pieces.tokenizer(MODEL).encode(text) == library.encode(text)


def test_pairs_are_compatible_only_if_merging_keeps_them():
    own = pieces.tokenizer(MODEL)
    a, b = own.ids["▁th"], own.ids["e"]
    assert not own.fits(a, b)
    assert own.fits(own.ids["▁the"], own.ids["▁a"])


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    own = pieces.MergeTokenizer(MODEL)
    for text in ["some words that differ", "more of those words", "some again", "x" * 70 + " some"] * 2:
        assert own.encode(text) == library.encode(text)


def test_columns(spark, library):
    texts = ["Hello  world", "", None, "é\n" * 3000, "Hello  world"]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, decoded string")
    rows = pieces.decode_documents(pieces.encode_documents(docs, MODEL), MODEL).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r["ids"] == library.encode(t or "") and r["decoded"] == library.decode(r["ids"])
    assert pieces.encode_documents(docs.limit(0), MODEL).count() == 0
