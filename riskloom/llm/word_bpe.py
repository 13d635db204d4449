"""BPE encoding and decoding with a lexicon of frequent words.

ASCII white space always parts tokens of this kind of tokenizer (one that drops white space; `Bpe` refuses others).
What stands between is cut into words as its pre-tokenizer would: runs of Latin letters (A to Z, and those of U+00C0 to
U+00FF), single digits, runs of other marks; an odd one, with an apostrophe or any other character, stays whole and
is left to the library's normaliser and pre-tokenizer. The frequent words of the corpus are compiled, with their
ids, into a minimal acyclic transducer: words share prefixes and suffixes, a word's ordinal finds its ids. The image
is mapped into the worker's memory and read in place; whole batches of text are cut and walked through it at one
time. All other words are merged exactly: pair by pair, always the lowest rank, the leftmost on ties; those of a batch side
by side, as the rows of a matrix.

The lexicon holds at most about `most` words of at most `longest` bytes, so it does not grow with the table; what
it holds changes the time, never the result. Strings of added tokens inside a text become these tokens, as the
library's default is, and part the text. Decoding joins the tokens' strings by blanks (there is no decoder in the
file; `Bpe` refuses files with one).

Null texts count as empty: no ids, the hash of nothing. Rows are independent of each other, so repeated rows and ids
give repeated results, an empty table an empty one (with an empty lexicon), and other columns do not matter. Very
long texts are walked whole; very long words are merged with a heap.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.rows import Memo, documents
from riskloom.llm.transducer import Transducer, build, find, hashed, mapped
from riskloom.session import freeze

TOKENIZER = "word_bpe_49k.json"
MOST = 200_000  # words in the lexicon, about
LONGEST = 64  # bytes of a word in the lexicon
_HELD = 400_000  # counts that a task keeps before it lets them go
_TEXT_BYTES = 1 << 20  # text walked at one time
_SHORT = 40  # tokens merged without a heap
_NEVER = 1 << 62

# Kinds of bytes: what parts words, letters, digits, other marks, and what makes a word odd.
_NOTHING, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KINDS = np.full(256, _ODD, np.uint8)
_KINDS[33:127] = _MARK
_KINDS[[9, 10, 11, 12, 13, 32]] = _NOTHING
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_KINDS[39] = _ODD  # the apostrophe
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_PLAIN = re.compile(rb"(?:[!-&(-~]|" + _LATIN + rb")*")
_WORD = re.compile(rb"(?:[a-z]|" + _LATIN + rb")+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def words_of(chunk: bytes) -> list[bytes]:
    """The words of what stands between white space."""
    return _WORD.findall(chunk.lower()) if _PLAIN.fullmatch(chunk) else [chunk]


def is_short(word: bytes) -> bool:
    """A plain word that `Bpe.merge_all` takes, once its letters are small."""
    return len(word) <= _SHORT and _PLAIN.fullmatch(word) is not None


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words_of` for a whole batch: where words begin and end, and the bytes with the letters of plain ones small.

    `data` ends in a blank.
    """
    kind = _KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    odd = np.flatnonzero(kind == _ODD)
    small = _SMALL[data]
    if len(odd):
        edges = np.flatnonzero((kind[1:] == _NOTHING) != (kind[:-1] == _NOTHING)) + 1
        if kind[0] != _NOTHING:
            edges = np.concatenate([[0], edges])
        within = np.unique(np.searchsorted(edges[::2], odd, "right") - 1)
        starts, ends = edges[::2][within], edges[1::2][within]
        step = np.zeros(len(data) + 1, np.int8)
        step[starts], step[ends] = 1, -1
        whole = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        kind[whole] = _ODD
        small[whole] = data[whole]
    edges = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1
    edges = np.concatenate([[0], edges])
    real = kind[edges] != _NOTHING
    ends = np.concatenate([edges[1:], [len(data)]])
    return edges[real], ends[real], small


class Bpe:
    """Exact merging by a tokenizer file: ids of any word, and strings of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.file = json.load(file)
        model = self.file["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain or self.file["decoder"] or self.file["post_processor"] or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in self.file["added_tokens"]):
            raise ValueError("a tokenizer of another kind")
        library = tokenizers.Tokenizer.from_file(path)
        self.letters = {b: self._letter(library, b) for b in range(256)}
        self.normal, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        if self.cut("a b") != self.cut("a") + [(p, (s + 2, e + 2)) for p, (s, e) in self.cut("b")]:
            raise ValueError("a tokenizer that keeps white space")
        vocabulary = model["vocab"]
        self.id_of, self.end = vocabulary.get, model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in self.file["added_tokens"]}
        self.find_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.string = {i: t.encode() for t, i in [*vocabulary.items(), *self.added.items()]}
        # Of a pair of ids, packed: rank of its merge and the id made, packed as well.
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocabulary[a] << 32 | vocabulary[b]] = rank << 32 | vocabulary[a + b]
        self.pieces = Memo(self.merge, 200_000)
        keys = np.array(sorted(self.merges), np.int64)
        self.bits = (3 * len(keys)).bit_length()
        self.pairs = hashed(keys, self.bits)
        self.made = np.array([self.merges[k] for k in keys.tolist()], np.int64)
        # Ids of the bytes of plain words, inside and at the end; -1 for none.
        self.inside, self.last = (
            np.array([-1 if not c or (i := self.id_of(c + end)) is None else i for c in self.letters.values()], np.int64)
            for end in ("", self.end)
        )

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of a word, in the letters of the vocabulary."""
        ids = [i for i in [*map(self.id_of, piece[:-1]), self.id_of(piece[-1:] + self.end)] if i is not None]
        return self._merge_long(ids) if len(ids) > _SHORT else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> tuple[int, ...]:
        """The least of all pairs each time: quicker than a heap for few."""
        made = self.merges.get
        found = [made(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) < _NEVER:
            i = found.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = made(ids[i] << 32 | ids[i + 1], _NEVER)
            if i:
                found[i - 1] = made(ids[i - 1] << 32 | ids[i], _NEVER)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        n, made = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        # Rank in front, place behind: the smallest entry is the next merge.
        heap = [(m >> 32 << 32) | i for i in range(n - 1) if (m := made(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = made(ids[i] << 32 | ids[j])
            if m is None or m >> 32 != entry >> 32:
                continue  # the pair has changed meanwhile
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            after[i] = end = after[j]
            before[end] = i
            if end < n and (m := made(ids[i] << 32 | ids[end])) is not None:
                heappush(heap, (m >> 32 << 32) | i)
            left = before[i]
            if left >= 0 and (m := made(ids[left] << 32 | ids[i])) is not None:
                heappush(heap, (m >> 32 << 32) | left)
        return tuple(i for i in ids if i >= 0)

    @staticmethod
    def _letter(library, byte: int) -> str:
        """What stands for a byte in the vocabulary; asked for those of Latin letters and ASCII marks only."""
        if byte < 128:
            return chr(byte)
        first, second = (chr(0xC0), 0) if byte == 0xC3 else (bytes([0xC3, byte]).decode(), 1) if byte < 0xC0 else ("", 0)
        return library.pre_tokenizer.pre_tokenize_str(first)[0][0][second] if first not in ("", "×", "÷") else ""

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What `merges` has for each pair, _NEVER where it has nothing or an id is missing."""
        known, place = find(*self.pairs, self.bits, left << 32 | right)
        return np.where(known & (left >= 0) & (right >= 0), self.made[place % max(len(self.made), 1)], _NEVER)

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of plain words in small letters, none longer than _SHORT: one merge in each per round."""
        sizes = np.array(list(map(len, words)))
        ids = np.full((len(words), sizes.max()), -1, np.int64)
        inside = np.arange(sizes.max()) < sizes[:, None]
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids[inside] = self.inside[raw]
        ids[np.arange(len(words)), sizes - 1] = self.last[raw[np.cumsum(sizes) - 1]]
        ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), -1)
        out: list = [None] * len(words)
        row = np.arange(len(words))
        while len(row):
            best = ranks.min(axis=1, initial=_NEVER)
            over = best == _NEVER
            if over.any():
                for r, found in zip(row[over].tolist(), ids[over].tolist()):
                    out[r] = tuple(i for i in found if i >= 0)
                on = ~over
                row, ids, ranks, best = row[on], ids[on], ranks[on], best[on]
                continue
            lines, at, width = np.arange(len(row)), ranks.argmin(axis=1), ids.shape[1]
            ids[lines, at] = best & 0xFFFFFFFF
            stay = np.ones(ids.shape, bool)
            stay[lines, at + 1] = False
            ids = ids[stay].reshape(len(row), width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[lines, at] = False
            ranks = ranks[stay].reshape(len(row), width - 2)
            for place in (at, at - 1):
                mine = np.flatnonzero((place >= 0) & (place < width - 2))
                p = place[mine]
                ranks[mine, p] = self._ranks(ids[mine, p], ids[mine, p + 1])
        return out

    def spelt(self, word: bytes) -> str | None:
        """A plain word in the letters of the vocabulary, small ones; None for an odd one."""
        return "".join([self.letters[b] for b in word.decode().lower().encode()]) if _PLAIN.fullmatch(word) else None

    def word(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word."""
        if (letters := self.spelt(word)) is not None:
            return self.merge(letters)
        return tuple(i for piece, _ in self.cut(self.normal(word.decode())) for i in self.pieces[piece])

    def rendered(self, ids) -> tuple[bytes, bytes]:
        """Decimal ids and the tokens' strings, joined by blanks."""
        return " ".join(map(str, ids)).encode(), b" ".join([self.string[i] for i in ids])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def word_counts(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """word, n: occurrences of the words of at most `longest` bytes over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept: Counter = Counter()
            for chunk, n in counts.items():
                for word in words_of(chunk):
                    if len(word) <= longest:
                        kept[word] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").encode().split())
                if len(counts) > _HELD:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int = MOST, longest: int = LONGEST) -> DataFrame:
    """The words that occur most often and more than once: `most` of them, or fewer where equal or near counts straddle that.

    Where to cut is read off a small table of how many words there are per size of the count, so nothing is sorted.
    """
    counts = freeze(word_counts(docs, longest).where("n > 1"), "word-counts")
    counts = counts.withColumn("size", F.floor(F.log2("n") * 16).cast("int"))
    least, room = 1 << 30, most
    for size, n in sorted(map(tuple, counts.groupBy("size").count().collect()), reverse=True):
        if n > room:
            break
        least, room = size, room - n
    return counts.where(F.col("size") >= least).select("word")


def lexicon(docs: DataFrame, path: str, most: int = MOST, longest: int = LONGEST) -> bytes:
    """Image of the lexicon: the transducer, where the ids of each ordinal begin, and the ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [list(bpe.word(w)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    def compile_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            ids += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([_image(words, ids)], pa.binary())], names=["image"])

    encoded = frequent_words(docs, most, longest).mapInArrow(encode, "word binary, ids array<int>")
    # About `most` words at most, whatever the table's size: one task compiles them.
    built = encoded.repartition(1).sortWithinPartitions("word").mapInArrow(compile_, "image binary")
    row = built.first()  # none if no word is frequent
    return bytes(row["image"]) if row else _image([], [])


def _image(words: list[bytes], ids: list[list[int]]) -> bytes:
    ends = np.cumsum([0, *map(len, ids)]).astype("<i8")
    flat = np.array([i for held in ids for i in held], "<i8")
    return build(words) + ends.tobytes() + flat.tobytes()


class Coder:
    """Encodes and decodes batches of texts by a lexicon and exact merging."""

    def __init__(self, image: bytes, path: str):
        self.bpe, held = load(path), mapped(image)
        self.automaton = Transducer(held)
        n, at = self.automaton.keys, self.automaton.size
        ends = np.frombuffer(held, "<i8", n + 1, at)
        ids = np.frombuffer(held, "<i8", int(ends[-1]), at + 8 * (n + 1))
        # What a known word adds to a document's two strings, made when it is first met.
        self.ends, self.ids, self.ready = ends, ids, np.zeros(n, bool)
        self.numbers, self.strings = np.full(n, None, object), np.full(n, None, object)
        self.unseen = Memo(lambda word: self.bpe.rendered(self.bpe.word(word)), 200_000)

    def joined(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Per text the decimal ids and the tokens' strings, each joined by blanks."""
        whole = [t.encode() for t in texts]
        data = np.frombuffer(b" ".join(whole) + b" ", np.uint8)
        starts, ends, small = cut(data)
        ordinals = self.automaton.ordinals(small, starts, ends)
        known = ordinals >= 0
        for o in np.unique(ordinals[known][~self.ready[ordinals[known]]]).tolist():
            self.numbers[o], self.strings[o] = self.bpe.rendered(self.ids[self.ends[o] : self.ends[o + 1]].tolist())
            self.ready[o] = True
        numbers, strings = np.full(len(starts), None, object), np.full(len(starts), None, object)
        numbers[known], strings[known] = self.numbers[ordinals[known]], self.strings[ordinals[known]]
        raw = small.tobytes()
        unknown = np.flatnonzero(~known)
        words = [raw[s:e] for s, e in zip(starts[unknown].tolist(), ends[unknown].tolist())]
        self._learn(set(words))
        for i, word in zip(unknown.tolist(), words):
            numbers[i], strings[i] = self.unseen[word]
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in whole)])).tolist()
        numbers, strings = numbers.tolist(), strings.tolist()
        return [(b" ".join(filter(None, numbers[s:e])), b" ".join(filter(None, strings[s:e]))) for s, e in zip(cuts, cuts[1:])]

    def _learn(self, words: set[bytes]) -> None:
        """Merge those of the plain words that are not remembered, all at one time."""
        held, older = self.unseen, self.unseen.older
        new = [w for w in words if w not in held and w not in older and is_short(w)]
        if new:
            for word, ids in zip(new, self.bpe.merge_all([w.decode().lower().encode() for w in new])):
                held.put(word, self.bpe.rendered(ids))

    def parted(self, text: str) -> tuple[bytes, bytes]:
        """As `joined`, for one text with strings of added tokens inside."""
        parts = self.bpe.find_added.split(text)
        found = self.joined(parts[::2])
        for i, token in enumerate(parts[1::2]):
            found.insert(2 * i + 1, self.bpe.rendered([self.bpe.added[token]]))
        return tuple(b" ".join(filter(None, side)) for side in zip(*found))

    def all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        special = [bool(self.bpe.find_added and self.bpe.find_added.search(t)) for t in texts]
        plain = iter(self.joined([t for t, s in zip(texts, special) if not s]) if not all(special) else ())
        return [self.parted(t) if s else next(plain) for t, s in zip(texts, special)]


_coders: dict[str, Coder] = {}


def _coder(name: str, image: bytes, path: str) -> Coder:
    """The worker's coder; a new lexicon takes the place of the last one."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(image, path)
    return _coders[name]


def _digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None, ids: bool = True, most: int = MOST, longest: int = LONGEST) -> DataFrame:
    """`docs` (columns `keep`, default all) with `ids` (optional), their number and hash, and the hash of the text
    that they decode to. Kept columns that bear the name of a new one are replaced by it."""
    new = T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
    image = lexicon(docs, path, most, longest)
    name = _digest(image + path.encode())
    shared = docs.sparkSession.sparkContext.broadcast(image)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    arrow = list(to_arrow_schema(new))

    def row(numbers: bytes, strings: bytes) -> tuple:
        n = numbers.count(b" ") + 1 if numbers else 0
        found = n, _digest(numbers), _digest(strings)
        return (*found, [int(i) for i in numbers.split()]) if ids else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared.value, path)
        for batch in batches:
            for at, texts in lots(batch.column(len(kept))):
                rows = [row(*found) for found in coder.all(texts)]
                part = batch.slice(at, len(texts))
                made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
                fields = [*list(part.schema)[: len(kept)], *arrow]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], schema=pa.schema(fields))

    source = docs.select(*kept, docs["text"].alias("__text"))
    return source.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *new.fields]))


def lots(texts: pa.Array, limit: int = _TEXT_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `limit` characters, with the place of the first."""
    lot, size, first = [], 0, 0
    for at, text in enumerate(texts):
        lot.append(text.as_py() or "")
        size += len(lot[-1])
        if size >= limit:
            yield first, lot
            lot, size, first = [], 0, at + 1
    if lot:
        yield first, lot


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with the column `text` that its `ids` decode to (null: empty)."""
    kept = [c for c in encoded.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string = load(path).string
        for batch in batches:
            texts = [b" ".join([string[i] for i in held.as_py() or ()]).decode() for held in batch.column(len(kept))]
            fields = [*list(batch.schema)[: len(kept)], pa.field("text", pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], schema=pa.schema(fields))

    source = encoded.select(*kept, encoded["ids"].alias("__ids"))
    return source.mapInArrow(run, T.StructType([*(encoded.schema[c] for c in kept), T.StructField("text", T.StringType())]))


def op12_word_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), keep=["doc_id"], ids=False)
