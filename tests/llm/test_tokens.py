"""Token counts, byte-level BPE and token files against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer

from riskloom.llm import byte_bpe, token_counts, token_files

LETTERS = " \n\t\xa0\x85\x0b\x1c\x1fab1'sStTÉéßñÖÿŸ$,.|_-　ſKİΣςǅ字<|endoftext|>"


def samples(n=400):
    rng = random.Random(3)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) + "<|endoftext|>" * (i % 50 == 0) for i in range(n)]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_tiktoken(tik):
    bpe = byte_bpe.load(P.path(byte_bpe.RANKS), P.PATTERN)
    rng = random.Random(4)
    for text in [*samples(), "aaaaaaaaaaaaaaaaaaa", "".join(rng.choice("abcdeé") for _ in range(50_000))]:
        ids = bpe.encode(text)
        assert ids == tik.encode_ordinary(text)
        assert bpe.decode(ids).decode() == text
    assert not any(bpe.words)


def test_bpe_rows(odd, nothing, tik):
    got = byte_bpe.encode_documents(odd, P.path(byte_bpe.RANKS))
    assert got.columns[-1] == "ids" and "n_tokens" in got.columns and "score" in got.columns
    for r in got.collect():
        text = r["text"] or ""
        assert r["ids"] == tik.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decode_documents(got.select("doc_id", "ids"), P.path(byte_bpe.RANKS)).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in odd.collect())
    assert byte_bpe.encode_documents(nothing, P.path(byte_bpe.RANKS)).count() == 0


def test_counts_and_cache(spark, odd, nothing, tmp_path):
    path, cache = P.path(token_counts.TOKENIZER), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    for text in samples():
        assert token_counts.load(path).count(text) == len(library.encode(text, add_special_tokens=False))
    due = sorted(
        (str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False)))
        for r in odd.collect()
    )
    for _ in range(2):
        got = token_counts.count_tokens(odd, path, cache).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == due
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
        assert spark.read.parquet(cache).count() == len({r["text"] or "" for r in odd.collect()})  # misses only, once
    assert token_counts.count_tokens(nothing, path, cache).count() == 0
    spark.read.parquet(cache).write.mode("append").parquet(cache + "2")
    spark.read.parquet(cache).write.mode("append").parquet(cache + "2")  # as two writers would
    assert token_counts.count_tokens(odd, path, cache + "2").count() == len(due)


@pytest.mark.parametrize("filled", [False, True])
def test_copies_meet_before_the_shuffle(spark, tmp_path, capsys, filled):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([("one",)] * 40 + [(None,)] * 20 + [("",)] * 20 + [("two",)], "text string").repartition(4)
    if filled:
        known = hashlib.sha256(b"two").hexdigest()
        spark.createDataFrame([("t", known, 1), ("other", hashlib.sha256(b"one").hexdigest(), 1)], token_counts.SCHEMA).write.parquet(cache)
    misses = token_counts.distinct_misses(docs, token_counts.read_cache(spark, cache, "t"))
    assert sorted(r["text"] for r in misses.collect()) == ["", "one", *["two"] * (not filled)]
    at = str(tmp_path / "docs")
    docs.write.parquet(at)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a cache of many texts
    try:
        capsys.readouterr()
        token_counts.distinct_misses(spark.read.parquet(at), token_counts.read_cache(spark, cache, "t")).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out.splitlines()
    read = next(i for i, line in enumerate(plan) if "FileScan parquet [text" in line)
    dealt = max(i for i, line in enumerate(plan[:read]) if "Exchange hashpartitioning(content_digest" in line)
    assert "partial_first" in plan[dealt + 1]
    assert filled or not any("ExistingRDD" in line for line in plan)  # no Python workers for a cache that is not there


def test_files_round_trip(spark, odd, nothing, small, tmp_path):
    path = P.path(token_files.TOKENIZER)
    library = Tokenizer.from_file(path)
    encoder = token_files.load(path)
    for text in samples():
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for name, docs in (("odd", odd), ("small", small), ("none", nothing)):
        folder = str(tmp_path / name)
        token_files.write_files(docs, folder, path)
        got = sorted(token_files.read_files(spark, folder, ids=True).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] is None for r in got] == sorted((r["doc_id"] is None for r in docs.collect()), reverse=True)
        known = [r["doc_id"] for r in got if r["doc_id"] is not None]
        assert known == sorted(known)
        at = 0
        for r in got:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["n_tokens"]
        due = sorted(library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect())
        assert sorted(r["ids"] for r in got) == due
    assert token_files.read_document(spark, str(tmp_path / "odd"), 3) == [1]
    assert token_files.read_document(spark, str(tmp_path / "odd"), 99) == []


def test_wrong_dictionary_is_refused(spark, small, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    token_files.write_files(small, one, P.path(token_files.TOKENIZER))
    spark.read.parquet(f"{one}/blocks").write.parquet(f"{two}/blocks")
    spark.read.parquet(f"{one}/parts").write.parquet(f"{two}/parts")
    spark.createDataFrame([(spark.read.parquet(f"{one}/dictionary").first()["hash"], b"other")], "hash string, bytes binary").write.parquet(f"{two}/dictionary")
    first = small.agg({"doc_id": "min"}).first()[0]
    assert token_files.read_document(spark, one, first)
    with pytest.raises(ValueError):
        token_files.read_document(spark, two, first)
    with pytest.raises(Exception, match="needs dictionary"):
        token_files.read_files(spark, two).collect()


def test_token_files_cut_each_new_chunk_once(monkeypatch):
    texts = ["Apples and pears-apples,", "and pears-apples, ÄÖ 12", None, ""]
    encoder, cut = token_files.Encoder(P.path(token_files.TOKENIZER)), []
    words_of = token_files.word_bpe.words_of
    monkeypatch.setattr(token_files.word_bpe, "words_of", lambda chunk: cut.append(chunk) or words_of(chunk))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(range(4), pa.int64()), pa.array(texts)], names=["doc_id", "__tie", "text"])
    (got,) = token_files.frames_of([batch], encoder, zstandard.ZstdCompressor(), 1)
    library = Tokenizer.from_file(P.path(token_files.TOKENIZER))
    for text, n, frame in zip(texts, got["n_tokens"].to_pylist(), got["frame"].to_pylist()):
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), "<u4").tolist()
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 1] and n == len(ids)
    assert len(cut) == len(set(cut)) == 5
