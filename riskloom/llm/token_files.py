"""Token ids in a binary format for short-document access.

A file set is a folder of Parquet tables whose binary columns hold the format:

* `dictionary`: one row, the shared zstandard dictionary and its SHA-256. It is trained on the serialized ids
  (little-endian unsigned 32-bit) of a bounded sample of documents (`sample` of them, by hash of the id).
* `blocks`: rows of at most `BLOCK` bytes of consecutive documents. `payload` holds one zstandard frame per
  document, `index` one entry per document: (id, tokens before it in its part, tokens, place and length of its
  frame). Each block names the hash of its dictionary.
* `parts`: per part (range of ids), tokens in all parts before it. One small row per part.

Documents stand in ascending order of id (nulls first; equal ids in order of a hash of their text), so a
document's first token is the number of tokens of all documents before it. One document can be read by its
block's row and the dictionary alone. Null texts count as empty: they hold the end id only. An empty table
gives a file set without blocks. A reader that meets another dictionary than the one a block names fails.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm import word_bpe
from riskloom.llm.rows import Memo, documents, with_columns_from_text
from riskloom.session import freeze, scratch_path

TOKENIZER = "word_bpe_49k.json"
END = 1
BLOCK = 1 << 20
ENTRY = "struct<id: bigint, start: bigint, n_tokens: bigint, at: bigint, n_bytes: bigint>"
BLOCKS = f"part int, block int, first_id bigint, last_id bigint, tokens bigint, dictionary string, index array<{ENTRY}>, payload binary"


class Encoder:
    """Ids as `Tokenizer.encode` gives them, serialized, for a tokenizer that drops white space.

    ASCII white space always parts tokens there, so what stands between is encoded once and remembered, and so are
    the words that it is cut into (`word_bpe.words_of`). Plain words, which the normaliser only lower-cases, go to the
    library's model directly; odd ones, and texts with the string of an added token, go to the library whole.
    """

    def __init__(self, path: str):
        self.library, self.bpe = tokenizers.Tokenizer.from_file(path), word_bpe.load(path)
        self.model, self.letters, self.added = self.library.model.tokenize, self.bpe.spelt, list(self.bpe.added)
        self.words, self.chunks = Memo(self._word), Memo(self._chunk, 800_000)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        letters = self.letters(word)
        if letters is None:
            return self.whole(word.decode())
        ids = [t.id for t in self.model(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, word_bpe.words_of(chunk)))

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))


@functools.lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(docs: DataFrame, path: str, end: int, size: int = 32_768, sample: int = 500, longest: int = 65_536) -> bytes:
    """Dictionary from the ids of `sample` documents, the first `longest` bytes of each; empty if they are too few.

    The sample only shapes the compression; every id of every document is stored whatever it holds.
    """
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()

    def make():
        encoder = load(path)
        return lambda t: ((encoder.encode(t) + np.array([end], "<u4").tobytes())[:longest],)

    few = docs.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("__r", F.xxhash64("text"))
    few = few.orderBy("__r").limit(sample)
    samples = [bytes(r[0]) for r in with_columns_from_text(few, make, "ids binary", []).collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def frames_of(batches, encoder: Encoder, packer: zstandard.ZstdCompressor, end: int):
    """Batches of id, tie and text as batches of id, tie, tokens and frame, a lot of texts at a time."""
    tail = np.array([end], "<u4").tobytes()
    for batch in batches:
        for at, texts in word_bpe.lots(batch.column(2)):
            ids = [encoder.encode(t) + tail for t in texts]
            made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(packer.compress, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[:2], *made], names=["doc_id", "__tie", "n_tokens", "frame"])


def write_files(docs: DataFrame, folder: str, path: str, end: int = END) -> None:
    """Write `docs` (doc_id, text) as a file set."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    raw = train_dictionary(docs, path, end)
    name = hashlib.sha256(raw).hexdigest()

    def compress(batches):
        return frames_of(batches, load(path), zstandard.ZstdCompressor(dict_data=_dictionary(raw)), end)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("__tie"), "text")
    frames = keyed.mapInArrow(compress, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __tie long, n_tokens long, frame binary")
    frames = freeze(frames, "frames")  # cutting the ranges reads it once more
    laid_out = frames.repartitionByRange(F.col("doc_id").asc_nulls_first(), "__tie").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "__tie"
    )

    def pack(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        index, frames, size = [], [], 0

        def row():
            ids = [e["id"] for e in index if e["id"] is not None]
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "part": part, "block": block, "first_id": min(ids, default=None), "last_id": max(ids, default=None),
                        "tokens": sum(e["n_tokens"] for e in index), "dictionary": name, "index": index,
                        "payload": b"".join(frames),
                    }
                ],
                schema=arrow,
            )

        for batch in batches:
            for doc_id, _, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if frames and size + len(frame) > BLOCK:
                    yield row()
                    index, frames, size, block = [], [], 0, block + 1
                index.append({"id": doc_id, "start": before, "n_tokens": n, "at": size, "n_bytes": len(frame)})
                frames.append(frame)
                size += len(frame)
                before += n
        if frames:
            yield row()

    arrow = _arrow(BLOCKS)
    laid_out.mapInArrow(pack, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    spark.createDataFrame([(name, raw)], "hash string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    totals = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    totals.select("part", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{folder}/parts")


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def read_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 of the ids as stored and, if asked for, the ids."""
    stored = spark.read.parquet(f"{folder}/dictionary").first()
    raw = bytes(stored["bytes"])
    name = hashlib.sha256(raw).hexdigest()
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/parts"), "part")
    blocks = blocks.select("before", "dictionary", "index", "payload")

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    arrow = _arrow(schema)

    def unpack(batches):
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for at in range(batch.num_rows):
                before, used, index, payload = (c[at].as_py() for c in batch.columns)
                if used != name:
                    raise ValueError(f"block needs dictionary {used}, the file set has {name}")
                rows = []
                for e in index:
                    data = reader.decompress(payload[e["at"] : e["at"] + e["n_bytes"]])
                    row = {
                        "doc_id": e["id"], "start": before + e["start"], "n_tokens": len(data) // 4, "ids_crc32": zlib.crc32(data),
                    }
                    if ids:
                        row["ids"] = np.frombuffer(data, "<u4").tolist()
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return blocks.mapInArrow(unpack, schema)


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[int]:
    """The ids of one document, from the block that holds it and nothing else; empty if there is none.

    Raises ValueError if the file set's dictionary is not the one that the block names.
    """
    held = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where(F.lit(doc_id).between(F.col("first_id"), F.col("last_id")))
    for block in held.select("dictionary", "index", "payload").limit(2).collect():
        for e in block["index"]:
            if e["id"] == doc_id:
                raw = bytes(spark.read.parquet(f"{folder}/dictionary").first()["bytes"])
                if hashlib.sha256(raw).hexdigest() != block["dictionary"]:
                    raise ValueError(f"block needs dictionary {block['dictionary']}, the file set has another")
                frame = bytes(block["payload"])[e["at"] : e["at"] + e["n_bytes"]]
                return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress(frame), "<u4").tolist()
    return []


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_files(documents(spark, sf_dir), folder, public_tokenizers.path(TOKENIZER))
    return read_files(spark, folder)
