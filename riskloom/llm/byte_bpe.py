"""Byte-level BPE encoding and decoding by a rank file.

Every match of the pattern is merged on its own: always the adjacent pair of lowest rank, the leftmost
one on ties. Positions wait in one bucket per merge rank, and a two-level bitmap tells the lowest bucket
in use by find-first-set, so a piece of n bytes takes O(n log n) steps however long it is. An entry whose
pair has changed meanwhile is stale and skipped.

Null texts count as empty: no ids, the hash of nothing. Rows are independent of each other, so repeated
rows and ids give repeated results, an empty table an empty one, and other columns do not matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable
from heapq import heappop, heappush

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import Memo, documents, with_columns_from_text

RANKS = "byte_bpe_multi_50k.tiktoken"


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)  # all 0 between two pieces
        self.bytes_of = {str(i): b for b, i in ranks.items()}
        self.memo = Memo(lambda match: ",".join(map(str, self.merge(match.encode()))), 400_000)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern.

        `after` and `before` link the positions where tokens start, `pair[i]` is the rank of the token at i
        with the next one. Bit r of the bitmap (its words hold 256 ranks, `top` tells which words are not
        empty) is set while bucket r holds positions.
        """
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        words, top, buckets = self.words, 0, {}
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, hence a heap
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            a = (top & -top).bit_length() - 1
            word = words[a]
            rank = a << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[a] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue
            gone = after[i]
            pair[gone] = None
            after[i] = end = after[gone]
            found = []
            if end < n:
                before[end] = i
                pair[i] = new = rank_of(piece[i : after[end]])
                if new is not None:
                    found.append((new, i))
            else:
                pair[i] = None
            left = before[i]
            if left >= 0:
                pair[left] = new = rank_of(piece[left:end])
                if new is not None:
                    found.append((new, left))
            for new, at in found:
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    words[new >> 8] |= 1 << (new & 255)
                    top |= 1 << (new >> 8)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.memo.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(i) for i in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, joined.split(","))) if joined else b""

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_joined(",".join(map(str, ids)))


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """One per Python worker, with its memo."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def encode_documents(
    docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None, ids: bool = True
) -> DataFrame:
    """`docs` (columns `keep`, default all) with `ids` (optional), their number and hash, and the hash of the bytes
    that they decode to."""

    def make():
        bpe = load(path, pattern)

        def work(text: str) -> tuple:
            joined = bpe.encode_joined(text)
            found = (
                joined.count(",") + 1 if joined else 0,
                hashlib.sha256(joined.encode()).hexdigest(),
                hashlib.sha256(bpe.decode_joined(joined)).hexdigest(),
            )
            return (*found, [int(i) for i in joined.split(",")] if joined else []) if ids else found

        return work

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return with_columns_from_text(docs, make, fields, keep)


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`encoded` with the column `text` that its `ids` decode to; bytes that are no UTF-8 become U+FFFD."""
    joined = encoded.withColumn("__ids", F.array_join(encoded["ids"].cast("array<string>"), ","))

    def make():
        bpe = load(path, pattern)
        return lambda text: (bpe.decode_joined(text).decode("utf-8", "replace"),)

    return with_columns_from_text(joined, make, "text string", encoded.columns, text="__ids")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path(RANKS), keep=["doc_id"], ids=False)
