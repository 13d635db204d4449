"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each pair is.

Each text is encoded by a byte-level BPE (A) and by a piece model (B), both over a blank and the text. Where tokens of
both end at one byte, the tokens are cut into groups; an A token and a B token of one group are linked. A pair's
count is the number of documents (rows) that hold it linked.

Pairs are counted outside memory. A task collects records (pair, document, links) up to `RUN` of them, sorts them by
A id, B id and document, parts them by a hash of the A id (radix), and lets them go as zstandard frames: one run, one
row of a stored table. A frame's head (its pairs, each with the run's number of documents) goes to the task of its
radix; its body (documents and links) stays in the run. So a pair that is in every document is one record per run,
however many documents there are. The radix task merges the heads of all runs with a heap, one A id after the other,
so that the counts of an A id's pairs and their maximum are known at once, and streams them back to the
frames that they came from. There they meet the bodies and are summed per document.

Null and empty texts, and texts whose A or B tokens do not spell out a blank and the text (such as those with U+2581), have no
tokens: zeros and ''. Repeated rows and ids are documents of their own. An empty table gives an empty result. Other
columns do not matter. A very long text is held whole, and a very long group as its different ids and how often each
occurs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.rows import Memo, documents, pieces_of
from riskloom.llm.word_bpe import lots
from riskloom.session import freeze

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
RUN = 1_500_000  # records of a run, about
_DOCUMENT_BITS = 20  # documents of a run

_TEXT = 1 << 19  # characters aligned at one time
_LARGE = 1024  # links of a group from which on its different ids are paired instead of all tokens
RESULT = ["n_a", "n_b", "n_groups", "n_links"]


class Aligner:
    """Aligns both tokenizations of batches of texts.

    A's pattern takes white space in front of other characters only, so what stands between the starts of runs of white
    space is encoded once and remembered. B is encoded whole.
    """

    def __init__(self, first: str, second: str):
        self.a = tokenizers.Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        kind = self.a.pre_tokenizer
        if type(kind).__name__ != "ByteLevel" or kind.add_prefix_space or self.a.normalizer:
            raise ValueError("a tokenizer of another kind")
        letters = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        spelt = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocabulary.items()}
        self.a_bytes = _objects([spelt.get(i, b"") for i in range(max(spelt) + 1)])
        self.b_bytes = _objects([bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.a_size, self.b_size = (np.array(list(map(len, side)), np.int64) for side in (self.a_bytes, self.b_bytes))
        # Ids as they stand in the text of the groups, with what follows them.
        self.a_text = {end: _objects([f"{i}{end}" for i in range(len(self.a_bytes))]) for end in ",|"}
        self.b_text = {end: _objects([f"{i}{end}" for i in range(len(names))]) for end in (",", ";", "")}
        self.bits, self.a_bits = (len(names) - 1).bit_length(), (len(self.a_bytes) - 1).bit_length()
        if self.bits + self.a_bits + _DOCUMENT_BITS > 63:
            raise ValueError("vocabularies too large")
        self.memo = Memo(lambda piece: np.array(self.a.encode(piece, add_special_tokens=False).ids, "<i4").tobytes(), 400_000)

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None where there are none or they do not spell the text."""
        if not text:
            return None
        a = np.frombuffer(b"".join(map(self.memo.__getitem__, pieces_of(" " + text))), "<i4")
        b = self.b.encode_as_numpy(text)
        whole = (" " + text).encode()
        if b"".join(self.a_bytes[a].tolist()) != whole or b"".join(self.b_bytes[b].tolist()) != whole:
            return None
        return a, b

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """Per text the numbers of RESULT and the hash of its groups; of all texts the different (place of the text,
        pair) with the number of links."""
        found = [self._encoded(t) for t in texts]
        good = [i for i, f in enumerate(found) if f is not None]
        rows: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
        if not good:
            return rows, *(np.zeros(0, np.int64) for _ in range(3))
        a_sizes, b_sizes = (np.array([len(found[i][side]) for i in good]) for side in (0, 1))
        a, b = (np.concatenate([found[i][side] for i in good]).astype(np.int64) for side in (0, 1))
        # The texts end to end: where one ends, both sides have a token end.
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_last, b_last = b_end[np.searchsorted(b_end, a_end)] == a_end, a_end[np.searchsorted(a_end, b_end)] == b_end
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        n_groups = int(a_group[-1]) + 1
        per_a, per_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        before_a, before_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        document = np.repeat(np.array(good), a_sizes)[a_last]  # of each group
        links = per_a * per_b
        n_of, links_of = np.bincount(document, minlength=len(texts)), np.zeros(len(texts), np.int64)
        np.add.at(links_of, document, links)

        line = np.empty(len(a) + len(b), object)
        line[np.arange(len(a)) + before_b[a_group]] = np.where(a_last, self.a_text["|"][a], self.a_text[","][a])
        ends = np.where(b_last, self.b_text[";"][b], self.b_text[","][b])
        stops = np.cumsum(b_sizes) - 1
        ends[stops] = self.b_text[""][b[stops]]
        line[np.arange(len(b)) + (before_a + per_a)[b_group]] = ends
        line, at = line.tolist(), 0
        for i, n_a, n_b in zip(good, a_sizes.tolist(), b_sizes.tolist()):
            name = hashlib.sha256("".join(line[at : at + n_a + n_b]).encode()).hexdigest()
            rows[i] = (n_a, n_b, int(n_of[i]), int(links_of[i]), name)
            at += n_a + n_b

        few = links <= _LARGE
        mine = np.flatnonzero(few[a_group])
        times = per_b[a_group[mine]]
        first = np.repeat(before_b[a_group[mine]], times)
        second = first + np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
        places = [np.repeat(document[a_group[mine]], times)]
        keys, counts = [np.repeat(a[mine], times) << self.bits | b[second]], [np.ones(len(first), np.int64)]
        for g in np.flatnonzero(~few).tolist():
            one, n = np.unique(a[before_a[g] : before_a[g] + per_a[g]], return_counts=True)
            two, m = np.unique(b[before_b[g] : before_b[g] + per_b[g]], return_counts=True)
            keys.append((one[:, None] << self.bits | two).ravel())
            counts.append((n[:, None] * m).ravel())
            places.append(np.full(len(keys[-1]), document[g]))
        return rows, *_summed(np.concatenate(places), np.concatenate(keys), np.concatenate(counts), self.bits + self.a_bits)


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _summed(places: np.ndarray, keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (place, key) and the sum of their counts."""
    both = places << bits | keys
    order = np.argsort(both, kind="stable")
    both = both[order]
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[at] >> bits, both[at] & ((1 << bits) - 1), np.add.reduceat(counts[order], at)


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def load(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one zstandard frame, their bytes sorted by place so that they compress."""
    parts = [np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()]
    parts += [np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(frame: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(frame)
    count = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", count, 8).tolist()
    at, out = 8 * (count + 1), []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel())
        at += 8 * n
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.int64(0))


def radix_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part of each pair, by a hash of its A id."""
    mixed = (keys >> bits).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


class Run:
    """Records of a task until they are let go."""

    def __init__(self, bits: int, parts: int, limit: int = RUN):
        self.bits, self.parts, self.limit = bits, parts, limit
        self.documents: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.records = 0

    def add(self, names: list, rows: list[tuple], places: np.ndarray, keys: np.ndarray, links: np.ndarray) -> None:
        """Texts with what `Aligner.align` found."""
        self.keys.append(keys << _DOCUMENT_BITS | (places + len(self.documents)))
        self.links.append(links)
        self.documents += [(name, *row) for name, row in zip(names, rows)]
        self.records += len(keys)

    @property
    def full(self) -> bool:
        return self.records >= self.limit or len(self.documents) >= (1 << _DOCUMENT_BITS) // 2

    def frames(self) -> tuple[list[bytes], list[bytes]]:
        """Heads and bodies of each part; empty bytes where a part has no pair."""
        records = np.concatenate([np.zeros(0, np.int64), *self.keys])
        links = np.concatenate([np.zeros(0, np.int64), *self.links])
        part = radix_of(records >> _DOCUMENT_BITS, self.bits, self.parts)
        order = np.lexsort((records, part))
        records, links, part = records[order], links[order], part[order]
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        heads, bodies = [], []
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                heads.append(b"")
                bodies.append(b"")
                continue
            keys, n = np.unique(records[low:high] >> _DOCUMENT_BITS, return_counts=True)
            heads.append(pack(_steps(keys), n))
            bodies.append(pack(n, records[low:high] & ((1 << _DOCUMENT_BITS) - 1), links[low:high]))
        return heads, bodies


def runs(docs: DataFrame, first: str, second: str, parts: int, limit: int = RUN) -> DataFrame:
    """Stored runs: run, documents (with the numbers that need no counts), heads and bodies by part."""
    key = docs.schema["doc_id"]
    fields = [T.StructField("doc_id", key.dataType), *(T.StructField(c, T.LongType()) for c in RESULT), T.StructField("groups_sha256", T.StringType())]
    frames = T.ArrayType(T.BinaryType())
    schema = T.StructType([
        T.StructField("run", T.LongType()), T.StructField("documents", T.ArrayType(T.StructType(fields))),
        T.StructField("heads", frames), T.StructField("bodies", frames),
    ])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(first, second)
        number, run = TaskContext.get().partitionId() << 24, Run(aligner.bits, parts, limit)

        def out() -> pa.RecordBatch:
            heads, bodies = run.frames()
            held = pa.array([dict(zip([f.name for f in fields], d)) for d in run.documents], arrow.field("documents").type.value_type)
            held = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held).cast(arrow.field("documents").type)
            rest = [pa.array([x], arrow.field("heads").type) for x in (heads, bodies)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), held, *rest], schema=arrow)

        for batch in batches:
            for at, texts in lots(batch.column(1), _TEXT):
                run.add(batch.column(0).slice(at, len(texts)).to_pylist(), *aligner.align(texts))
                if run.full:
                    yield out()
                    number, run = number + 1, Run(aligner.bits, parts, limit)
        if run.documents:
            yield out()

    return freeze(docs.select("doc_id", "text").mapInArrow(work, schema), "runs")


def merge(heads: list[tuple[int, bytes]], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per frame of one part: run, and for each of its pairs twice the pair's count, plus one if it is its A id's highest."""
    frames = []
    for run, head in heads:
        steps, n = unpack(head)
        keys = np.cumsum(steps)
        a = keys >> bits
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        frames.append((run, keys, n, a[starts].tolist(), [*starts.tolist(), len(keys)], np.zeros(len(keys), np.int64)))
    heap = [(frame[3][0], i, 0) for i, frame in enumerate(frames)]
    heapify(heap)
    while heap:
        a, met = heap[0][0], []
        while heap and heap[0][0] == a:
            _, i, at = heap[0]
            frame = frames[i]
            met.append((frame, slice(frame[4][at], frame[4][at + 1])))
            if at + 1 < len(frame[3]):
                heapreplace(heap, (frame[3][at + 1], i, at + 1))
            else:
                heappop(heap)
        keys, place = np.unique(np.concatenate([f[1][cut] for f, cut in met]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, place, np.concatenate([f[2][cut] for f, cut in met]))
        back = (counts << 1 | (counts == counts.max()))[place]
        at = 0
        for f, cut in met:
            n = cut.stop - cut.start
            f[5][cut] = back[at : at + n]
            at += n
    for run, *_, back in frames:
        yield run, back


def counts_back(stored: DataFrame, bits: int) -> DataFrame:
    """run, parts: for each part of a run the counts of its pairs, as `merge` gives them, in a frame."""
    heads = stored.select("run", F.posexplode("heads").alias("part", "head")).where(F.octet_length("head") > 0)
    dealt = heads.repartition("part").sortWithinPartitions("part", "run").select("part", "run", "head")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for run, back in merge(held, bits):
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([at], pa.int32()), pa.array([pack(back)], pa.binary())], names=["run", "part", "back"])

        for batch in batches:
            for part, run, head in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at and held:
                    yield from out()
                    held = []
                at = part
                held.append((run, head))
        if held:
            yield from out()

    found = dealt.mapInArrow(work, "run long, part int, back binary")
    return found.groupBy("run").agg(F.collect_list(F.struct("part", "back")).alias("parts"))


def align_documents(docs: DataFrame, first: str, second: str, parts: int | None = None, limit: int = RUN) -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the module's head)."""
    spark, bits = docs.sparkSession, load(first, second).bits
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = runs(docs, first, second, parts, limit)
    back = counts_back(stored, bits)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in [*RESULT, "n_best", "count_sum"]),
        T.StructField("groups_sha256", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                held, bodies, frames = (c[at] for c in batch.columns)
                known = held.values
                best, total = np.zeros((2, len(known)), np.int64)
                for frame in frames.as_py() or ():
                    n, document, links = unpack(bodies[frame["part"]].as_py())
                    (count,) = unpack(frame["back"])
                    count = np.repeat(count, n)
                    np.add.at(best, document, links * (count & 1))
                    np.add.at(total, document, links * (count >> 1))
                columns = [known.field("doc_id"), *(known.field(c) for c in RESULT), pa.array(best), pa.array(total), known.field("groups_sha256")]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return stored.select("run", "documents", "bodies").join(back, "run", "left").select("documents", "bodies", "parts").mapInArrow(work, schema)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(documents(spark, sf_dir), public_tokenizers.path(FIRST), public_tokenizers.path(SECOND))
