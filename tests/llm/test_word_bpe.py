"""The lexicon coder against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import word_bpe

PATH = P.path(word_bpe.TOKENIZER)
LETTERS = " \n\t\xa0\x85\x0b\x1c\x1fab1'sStTÉéßñÖÿŸ$,.|_-　ſKİΣςǅ字é​<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def due(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids


def texts(n=300):
    rng = random.Random(11)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) + rng.choice(["", "", "<|endoftext|>", " <|startoftext|><|endoftext|>x"]) for _ in range(n)]
    return [*made, "<|endoftext|>", "<|endoftext|><|endoftext|>", "don't DON'T we'LL", "x" * 3000 + "".join(rng.choice("abcdeé") for _ in range(30_000))]


def test_exact_merging(library):
    bpe = word_bpe.load(PATH)
    for text in [*texts(), "Straße ÀÉÎ×÷ÿ a1b22c ABC-def. x--y __z__ 3.14"]:
        for chunk in text.replace("<|", "").encode().split():
            words = word_bpe.words_of(chunk)
            assert [i for w in words for i in bpe.word(w)] == library.encode(chunk.decode(), add_special_tokens=False).ids
        data = np.frombuffer(text.encode() + b" ", np.uint8)
        starts, ends, small = word_bpe.cut(data)
        raw = small.tobytes()
        assert [raw[s:e] for s, e in zip(starts, ends)] == [w for chunk in text.encode().split() for w in word_bpe.words_of(chunk)]


def test_merging_side_by_side():
    bpe, rng = word_bpe.load(PATH), random.Random(5)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 40))).encode() for _ in range(500)]
    words += [b"a", b"9", b"!!", "é".encode() * 15, "Éàß".lower().encode(), b"the", b"inininininin", b"aaaaaaaa"]
    assert bpe.merge_all(words) == [bpe.word(w) for w in words]
    assert bpe.merge_all([b"x"]) == [bpe.word(b"x")]


@pytest.mark.parametrize("most", [0, 20, word_bpe.MOST])
def test_documents(spark, odd, small, library, most):
    """Whatever the lexicon holds, the result is the library's."""
    mixed = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    for docs in (odd, mixed, small):
        got = word_bpe.encode_documents(docs, PATH, most=most, longest=16).collect()
        if "text" in docs.columns:
            for r in got:
                assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) == due(library, r["text"])
        assert len(got) == docs.count()


def test_round_trip_and_odd_tables(odd, nothing, library):
    got = word_bpe.encode_documents(odd, PATH)
    assert "score" in got.columns and got.columns.count("n_tokens") == 1
    back = word_bpe.decode_documents(got.select("doc_id", "ids", F.lit("old").alias("text")), PATH).collect()
    assert sorted(r["text"] for r in back) == sorted(library.decode(due(library, r["text"])[3], skip_special_tokens=False) for r in odd.collect())
    assert word_bpe.encode_documents(nothing, PATH).count() == 0
    plain = word_bpe.encode_documents(odd, PATH, ["doc_id"], False)
    assert plain.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and plain.count() == odd.count()


def test_frequent_words(spark):
    docs = spark.createDataFrame([("a a A b b, b c c d",), (" a\tb\n c " + "z" * 70 + " " + "z" * 70,), (None,)], "text string")
    held = {r["word"].decode() for r in word_bpe.frequent_words(docs).collect()}
    assert held == {"a", "b", "c"}
    assert {r["word"].decode() for r in word_bpe.frequent_words(docs, 2).collect()} == {"a", "b"}
    assert word_bpe.frequent_words(docs, 1).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        word_bpe.load(P.path("byte_bpe_50k.json"))
