"""BPE by a queue of merges against the tokenizers library."""

import hashlib
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidyveil.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["a", "B", "Σ", "ς", "İ", "é", "é", "'s", "'S", "1", "²", "中", "՘", "\U00016ea0", " ", "\t", "\x85", "　", "<|endoftext|>", "<|", "_", "ſ", "K", "\x00", "👍🏽", "ing"]


def _ids(text, cut=word_bpe.CUT):
    word_bpe.tokenizer(PATH).encode(text, ids := array("I"), cut)
    return ids.tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=40).map("".join) | st.text(max_size=40), st.sampled_from([2, 7, 1000]))
def test_ids_are_those_of_the_library(text, cut):
    assert _ids(text, cut) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_characters_one_by_one():
    """Every character between two letters, so that tables of another Unicode version show."""
    known = word_bpe.tokenizer(PATH)
    letters = {c: b for b, c in enumerate(word_bpe.byte_letters())}
    for first in range(0, 0x20000, 61):
        text = " ".join(f"a{chr(c)}1!" for c in range(first, first + 61) if not 0xD800 <= c < 0xE000)
        normal = LIBRARY.normalizer.normalize_str(text)
        words = [bytes(letters[c] for c in w).decode() for w, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(normal)]
        assert known._split(text) == words, first


def test_only_unassigned_characters_are_left_to_the_library():
    assert word_bpe.unassigned().sum() == sum(unicodedata.category(chr(c)) == "Cn" for c in range(0x110000))


@pytest.mark.parametrize("word", ["a" * 50_000, "ab" * 20_000 + "c", "é" * 9_000, "x"])
def test_long_words(word):
    assert _ids(word) == LIBRARY.encode(word, add_special_tokens=False).ids


def test_by_document(spark):
    texts = [None, "", " ", "Hello  wörld's ΣΑΣ <|endoftext|>x", "word " * 60_000, "same", "same"]
    rows = [(i if i < 5 else 5, t, "x", "y") for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string, ids_sha256 string")
    found = word_bpe.tokens_by_document(df, PATH).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        row = by_id[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert word_bpe.tokens_by_document(df.limit(0), PATH).collect() == []
    kept = word_bpe.encode(df, PATH, ["doc_id", "ids_sha256"], out="ids")
    assert kept.columns == ["doc_id", "ids_sha256", "ids"]
    assert [r["text"] for r in word_bpe.decode(kept.limit(0), PATH, ["doc_id"], "ids").collect()] == []
    none = spark.createDataFrame([(1, None)], "doc_id long, tokens binary")
    assert word_bpe.decode(none, PATH, ["doc_id"]).first()["text"] == ""


def test_other_kinds_of_files_are_refused():
    with pytest.raises((ValueError, KeyError, AttributeError)):
        word_bpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
