"""Benchmark decontamination: BM25 retrieval of test items by training passages, then overlap.

The index is over the test items: per term and block of items the largest BM25 weight, and the weights themselves.
Every passage of a training text is a query, its different words the terms. Passages are windows of twice the
longest item's words, one such item apart, so that every stretch as long as an item lies inside one. The upper
bound from the block maxima is taken for the whole text first (no passage of it can score more), then per passage;
only blocks whose bound reaches their lowest threshold are opened, as in block-max WAND, and every item at or above
its threshold is retrieved, however many they are.

The threshold of an item is what a passage scores that holds the item but for the words that it may lack at the
asked overlap, these being the heaviest. An item whose overlap suffices therefore always reaches it, and retrieval
loses nothing. Retrieved pairs are verified: the share of the item's 5-word shingles that the passage holds is at
least 0.8, and so is the share of those inside its question, and at least 0.5 of those that reach into its answer
(its last sentence; an item of one sentence is all question). An item below five words is one shingle.

Words are runs of letters and digits in lower case. Null and empty texts and items match nothing, repeated items are
reported each, repeated rows each; an empty benchmark or table gives an empty result. Items are read in groups of
`ITEMS`, with one pass over the documents for each group. Only one group's items and index are on the driver or in a task
at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import documents, table, with_columns_from_text
from riskloom.session import freeze

WORDS = 5
OVERLAP = 0.8
ANSWER = 0.5
ITEMS = 20_000
BLOCKS, BLOCK = 64, 16  # blocks at most, items in one at least
_K1, _B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.?!]+\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], size: int = WORDS) -> list[str]:
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Item:
    """A test item: its words, and its shingles in the question and in (or into) the answer."""

    def __init__(self, item_id: int, text: str):
        self.item_id, self.words = item_id, words_of(text)
        ends = [m.end() for m in _END.finditer(text.strip())]
        question = len(words_of(text.strip()[: ends[-1]])) if ends else len(self.words)
        every = shingles(self.words)
        asked = max(0, question - WORDS + 1)
        self.question, self.answer = set(every[:asked]), set(every[asked:])
        if not self.question:
            self.question, self.answer = self.answer, set()
        self.shingles = self.question | self.answer

    def overlaps(self, found: set[str]) -> tuple[float, float, float]:
        share = lambda part: len(part & found) / len(part) if part else 1.0
        return share(self.shingles), share(self.question), share(self.answer)


class Index:
    """BM25 weights of the items, per term, in at most `BLOCKS` blocks.

    The weights are kept as flat lists, a term's from `first[term]` to `first[term + 1]`, so that they take as much
    room as the items' texts; only the block maxima are a matrix. Both are bounded by `ITEMS`.
    """

    def __init__(self, items: list[Item], overlap: float = OVERLAP):
        self.items = sorted((i for i in items if i.words), key=lambda i: (len(i.words), str(i.item_id)))
        self.overlap = overlap
        self.longest = max((len(i.words) for i in self.items), default=1)
        counts = [Counter(i.words) for i in self.items]
        self.number = {t: n for n, t in enumerate(sorted({t for c in counts for t in c}), 1)}  # 0: no item holds it
        n, mean = len(self.items), sum(len(i.words) for i in self.items) / max(1, len(self.items))
        holds = Counter(t for c in counts for t in c)
        self.threshold = np.zeros(n)
        self.block = max(BLOCK, -(-n // BLOCKS))
        self.largest = np.zeros((len(self.number) + 1, -(-n // self.block)))
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(self.number) + 1)]
        for j, (item, count) in enumerate(zip(self.items, counts)):
            norm = _K1 * (1 - _B + _B * len(item.words) / mean)
            own = []
            for t, f in count.items():
                idf = math.log(1 + (n - holds[t] + 0.5) / (holds[t] + 0.5))
                own.append(idf * f * (_K1 + 1) / (f + norm))
                postings[self.number[t]].append((j, own[-1]))
                top = self.largest[self.number[t]]
                top[j // self.block] = max(own[-1], top[j // self.block])
            lacking = math.floor((1 - overlap) * len(item.shingles) + 1e-9) if len(item.words) >= WORDS else 0
            lacking += max(0, len(shingles(item.words)) - len(item.shingles))  # repeated shingles may go together
            own.sort()
            self.threshold[j] = sum(own[: max(0, len(own) - lacking)]) - 1e-9
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in postings])]).astype(np.int64)
        self.place = np.array([j for x in postings for j, _ in x], np.int64)
        self.weight = np.array([w for x in postings for _, w in x], float)
        self.lowest = np.array([self.threshold[b : b + self.block].min() for b in range(0, n, self.block)])

    def _blocks(self, terms: np.ndarray) -> np.ndarray:
        """Which blocks to open: those whose bound for `terms` reaches their lowest threshold."""
        return self.largest[terms].sum(axis=0) >= self.lowest

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(item, BM25) of every item at or above its threshold for the different `terms`."""
        opened = self._blocks(terms)
        if not opened.any():
            return []
        lengths = self.first[terms + 1] - self.first[terms]
        at = np.arange(lengths.sum()) + np.repeat(self.first[terms] - np.cumsum(lengths) + lengths, lengths)
        at = at[opened[self.place[at] // self.block]]
        scores = np.bincount(self.place[at], weights=self.weight[at], minlength=len(self.items))
        # An item without any weight (all its words may lack) is no find of an index.
        return [(int(j), float(scores[j])) for j in np.flatnonzero((scores > 0) & (scores >= self.threshold))]

    def matches(self, text: str) -> list[tuple]:
        """(item_id, passage, bm25, overlap, question_overlap, answer_overlap) of the verified items, best passage each."""
        words = words_of(text)
        number = self.number.get
        terms = np.fromiter((number(w, 0) for w in words), np.int32, len(words))
        if not len(words) or not self.items or not self._blocks(_different(terms)).any():
            return []
        best: dict[int, tuple] = {}
        span = self.longest
        for at in range(0, max(1, len(words) - span), span):
            mine = _different(terms[at : at + 2 * span])
            near = self.retrieve(mine)
            if near:
                found = set(shingles(words[at : at + 2 * span]))
                if len(words) < WORDS or any(len(self.items[j].words) < WORDS for j, _ in near):
                    found |= {" ".join(words[i : i + n]) for n in range(1, WORDS) for i in range(at, min(at + 2 * span, len(words)) - n + 1)}
                for j, score in near:
                    all_, question, answer = self.items[j].overlaps(found)
                    if all_ >= self.overlap and question >= self.overlap and answer >= min(ANSWER, self.overlap):
                        row = (self.items[j].item_id, at // span, score, all_, question, answer)
                        if j not in best or (all_, score) > (best[j][3], best[j][2]):
                            best[j] = row
        return [best[j] for j in sorted(best)]


def _different(terms: np.ndarray) -> np.ndarray:
    terms = np.unique(terms)
    return terms[terms > 0]


def n_groups(benchmark: DataFrame, most: int = ITEMS) -> int:
    """Groups that the items are dealt into, of about `most` each."""
    return -(-benchmark.where("text is not null").count() // most)


def index_of(benchmark: DataFrame, group: int, groups: int, overlap: float = OVERLAP) -> Index:
    """The index of one group of items."""
    items = benchmark.where("text is not null").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group)
    return Index([Item(r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()], overlap)


MATCH = "struct<item_id: bigint, passage: int, bm25: double, overlap: double, question_overlap: double, answer_overlap: double>"


def with_matches(docs: DataFrame, shared: Broadcast, keep: list[str] | None = None) -> DataFrame:
    """`docs` with `matches`, the verified items of the broadcast index."""

    def make():
        found = shared.value
        return lambda text: ([dict(zip(_NAMES, m)) for m in found.matches(text)],)

    return with_columns_from_text(docs, make, f"matches array<{MATCH}>", keep)




_NAMES = ("item_id", "passage", "bm25", "overlap", "question_overlap", "answer_overlap")


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, most: int = ITEMS) -> DataFrame:
    """One row per document and test item that it holds, with the best passage's number, score and overlaps.

    A pass over `docs` for each `most` items; a pass's rows are stored before the next index is built.
    """
    found, groups = None, n_groups(benchmark, most)
    for g in range(groups):
        shared = docs.sparkSession.sparkContext.broadcast(index_of(benchmark, g, groups, overlap))
        part = with_matches(docs, shared, ["doc_id"]).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
        if groups > 1:
            part = freeze(part, "matches")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = F.from_json(F.lit("[]"), f"array<{MATCH}>")
        return docs.select("doc_id", F.explode(none).alias("m")).select("doc_id", "m.*")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, most: int = ITEMS) -> DataFrame:
    """`docs`, columns and values as they are, without the rows that hold a test item.

    A pass for each `most` items; what a pass leaves is stored before the next index is built.
    """
    kept, groups = docs.columns, n_groups(benchmark, most)
    for g in range(groups):
        shared = docs.sparkSession.sparkContext.broadcast(index_of(benchmark, g, groups, overlap))

        def make(shared=shared):
            found = shared.value
            return lambda text: (not found.matches(text),)

        docs = with_columns_from_text(docs, make, "__clean boolean").where("__clean").select(*kept)
        if g + 1 < groups:
            docs = freeze(docs, "decontaminated")
            shared.unpersist()
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
