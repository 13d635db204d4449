"""Token counts of whole texts through a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, tokens). Texts are normalised to what the
tokenizer sees (null: empty), digested, and joined to the cache; only distinct texts that it does not hold are
encoded, and their counts are appended. A later run over the same texts encodes nothing.

The tokenizer digest covers the tokenizer's file and the version of its library, so another tokenizer or
version never meets old counts. Two writers may append the same digest; reading keeps one row of it. Copies of
one text meet combined before the shuffle, and the join back carries digests only. Repeated rows and ids keep
their rows, null texts count 0 bytes and 0 tokens, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import public_tokenizers
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import Memo, documents, pieces_of, with_columns_from_text
from riskloom.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "tokenizer_digest string, content_digest string, n_tokens long"


class Counter:
    """Numbers of tokens as `Tokenizer.encode` gives them, without the tokens that it would add at the ends.

    A byte-level tokenizer without normaliser treats what stands between two runs of white space on its own, so
    each such piece is encoded by the library once and remembered. Texts that hold the string of an added token,
    and all texts of other kinds of tokenizer, go to the library whole.
    """

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        kind = type(self.library.pre_tokenizer).__name__
        self.by_piece = kind == "ByteLevel" and not self.library.pre_tokenizer.add_prefix_space and self.library.normalizer is None
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = Memo(self.whole)

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))

    def count(self, text: str) -> int:
        if not self.by_piece or any(a in text for a in self.added):
            return self.whole(text)
        return sum(map(self.memo.__getitem__, pieces_of(text)))


@functools.lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(path)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def read_cache(spark, cache: str, digest: str) -> DataFrame:
    """Counts of one tokenizer, one row per content digest."""
    try:
        stored = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException:  # no cache yet; nothing of it is ever run
        stored = spark.createDataFrame([], SCHEMA).where(F.lit(False))
    return stored.where(F.col("tokenizer_digest") == digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def distinct_misses(docs: DataFrame, stored: DataFrame, text: str = "text") -> DataFrame:
    """Digest and text of each text that `stored` has no digest of, once.

    Copies are put together before the join, so in front of the shuffle: after it a text has a row per input partition at most.
    """
    content = F.coalesce(docs[text], F.lit(""))
    texts = docs.select(F.sha2(content, 256).alias("content_digest"), content.alias("text"))
    return texts.groupBy("content_digest").agg(F.first("text").alias("text")).join(stored, "content_digest", "left_anti")


def count_tokens(
    docs: DataFrame, path: str, cache: str, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each row; fills the cache at once."""
    spark, digest = docs.sparkSession, tokenizer_digest(path)
    content = F.coalesce(docs[text], F.lit(""))
    keyed = docs.select(
        docs[key], F.sha2(content, 256).alias("content_digest"), F.octet_length(content).cast("long").alias("n_bytes")
    )
    misses = distinct_misses(docs, read_cache(spark, cache, digest), text)

    def make():
        counter = load(path)
        return lambda t: (counter.count(t),)

    counted = with_columns_from_text(misses, make, "n_tokens long", ["content_digest"])
    counted.select(F.lit(digest).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode("append").parquet(cache)
    return (
        keyed.join(read_cache(spark, cache, digest), "content_digest")
        .select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that nothing is found in it that this run did not encode."""
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), scratch_path(spark, "token-cache"))
