"""Source divergence audit: how far the sources of a language differ in their use of words.

Terms are runs of letters A to Z (lower-cased) and of all characters beyond U+007F. A language keeps the terms that
stand in at least `least` of its documents. Each group (lang, source) and each language gives every kept term a
share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two shares differ by f = floor((p - q)^2 / (p + q)), all in
whole numbers.

The kept terms, sorted by (lang, term), get their ordinals from minimal acyclic transducers (one per `PART` terms,
built in tasks). Texts are streamed through these a second time and leave counts per group and ordinal; from
there on a term is its ordinal, also for breaking ties, and only the few reported terms are turned back into
words. A pass over the texts holds at most `PASS_BYTES` of transducers (one, if that alone is larger), so the
broadcast does not grow with the table, but the number of passes with the vocabulary.

Pairs of sources are summed in tiles of `TILE` ordinals by two times `SOURCES` sources, from the counts that are
there: what a term adds beyond the value of two zero counts. The zero counts of all kept terms are added at the end.

Nulls in text, lang and source count as ''. Rows are documents, whatever their ids; repeated rows count each. A
language without kept terms has pairs of value 0 and no terms. An empty table gives an empty result. A very long
text is held whole, in bytes; its words leave the task as counts only. Other columns do not matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.rows import documents
from riskloom.llm.transducer import Transducer, build
from riskloom.operators.ordered import numbered
from riskloom.session import freeze

LEAST = 10
TOP = 10
PART = 1_000_000  # terms in one transducer
PASS_BYTES = 96 << 20
TILE = 2048
SOURCES = 64
_HELD = 400_000  # counts that a task keeps before it lets them go
_TEXT_BYTES = 1 << 20  # text walked at one time

# What is no part of a term becomes a blank, letters become small.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

GROUP = ["lang", "source"]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, n: how many documents of the language hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            langs = [lang for lang, held in counts.items() for _ in held]
            terms = [t for held in counts.values() for t in held]
            n = [n for held in counts.values() for n in held.values()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "term", "n"])

        for batch in batches:
            held = 0
            for lang, text in zip(*batch.columns):
                counts[lang.as_py()].update(set(text.as_py().encode().translate(_LETTERS).split()))
                held += 1
                if held % 64 == 0 and sum(map(len, counts.values())) > _HELD:
                    yield out()
        yield out()

    found = _plain(docs).select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, key, ordinal of the kept terms, stored. Keys are lang, a zero character, term; ordinals follow them."""
    key = F.concat_ws("\0", "lang", "term").alias("key")  # no term holds a zero, so the last one parts the two
    kept = freeze(document_counts(docs).where(F.col("n") >= least).select("lang", key), "kept")
    return freeze(numbered(kept, [], ["key"], "ordinal"), "vocabulary")


def transducers(kept: DataFrame, part: int = PART) -> DataFrame:
    """part, image: a transducer of each `part` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([build(keys)], pa.binary())], names=["part", "image"])

        for batch in batches:
            for number, key in zip(*(c.to_pylist() for c in batch.columns)):
                if number != at and keys:
                    yield out()
                    keys = []
                at = number
                keys.append(key.encode())
        if keys:
            yield out()

    dealt = kept.select(F.floor(F.col("ordinal") / part).alias("part"), "key", "ordinal").repartition("part")
    dealt = dealt.sortWithinPartitions("part", "ordinal").select("part", "key")
    return freeze(dealt.mapInArrow(run, "part long, image binary"), "transducers")


def _passes(images: DataFrame, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The transducers with their part numbers, as many at a time as the limit allows."""
    sizes = images.select("part", F.octet_length("image").alias("n")).orderBy("part").collect()
    groups, room = [], 0
    for part, n in sizes:
        if not groups or n > room:
            groups.append([])
            room = limit
        groups[-1].append(part)
        room -= n
    for group in groups:
        yield [(r["part"], bytes(r["image"])) for r in images.where(F.col("part").isin(group)).collect()]


class Streamer:
    """Walks texts through the transducers of one pass and counts ordinals by group."""

    def __init__(self, images: list[tuple[int, bytes]], part: int):
        self.parts = [(number * part, Transducer(image)) for number, image in images]
        self.roots: dict[str, list] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open: list[np.ndarray] = []

    def _root(self, lang: str) -> list:
        if lang not in self.roots:
            self.roots[lang] = [automaton.walk(lang.encode() + b"\0") for _, automaton in self.parts]
        return self.roots[lang]

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        """Count the terms of texts, which are letters and blanks already."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = data == 32
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[::2], edges[1::2]
        last = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(last, starts, "right")
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)])[doc]
        for i, (first, automaton) in enumerate(self.parts):
            roots = np.array([self._root(lang)[i] for lang in langs])[doc]
            ordinal = automaton.ordinals(data, starts, ends, roots[:, 0], roots[:, 1])
            known = np.flatnonzero(ordinal >= 0)
            self.open.append(group[known] << 40 | (ordinal[known] + first))
        if sum(map(len, self.open)) > _HELD:
            self.settle()

    def settle(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.open]), return_counts=True)
        keys = np.concatenate([self.keys, new])
        self.keys, back = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, n]), len(self.keys)).astype(np.int64)
        self.open = []

    def out(self) -> pa.RecordBatch:
        self.settle()
        groups = list(self.groups)
        at = pa.array(self.keys >> 40)
        arrays = [pa.array([g[i] for g in groups], pa.string()).take(at) for i in (0, 1)]
        batch = pa.RecordBatch.from_arrays([*arrays, pa.array(self.keys & ((1 << 40) - 1)), pa.array(self.counts)], names=[*GROUP, "ordinal", "n"])
        self.groups, self.keys, self.counts = {}, self.keys[:0], self.counts[:0]
        return batch


def term_counts(docs: DataFrame, images: DataFrame, part: int = PART, limit: int = PASS_BYTES) -> DataFrame:
    """lang, source, ordinal, n: occurrences of the kept terms in each group that has any."""
    context, docs = docs.sparkSession.sparkContext, _plain(docs)
    schema = "lang string, source string, ordinal long, n long"
    found = None
    for held in _passes(images, limit):
        shared = context.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            streamer = Streamer(shared.value, part)
            for batch in batches:
                lot: list[tuple] = []
                size = 0
                for lang, source, text in zip(*batch.columns):
                    lot.append((lang.as_py(), source.as_py(), text.as_py().encode().translate(_LETTERS)))
                    size += len(lot[-1][2]) + 1
                    if size >= _TEXT_BYTES:
                        streamer.add(*map(list, zip(*lot)))
                        lot, size = [], 0
                if lot:
                    streamer.add(*map(list, zip(*lot)))
                if len(streamer.keys) > _HELD:
                    yield streamer.out()
            yield streamer.out()

        counted = docs.mapInArrow(run, schema).groupBy(*GROUP, "ordinal").agg(F.sum("n").alias("n"))
        counted = freeze(counted, "term-counts")
        shared.unpersist()
        found = counted if found is None else found.unionAll(counted)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def terms_of(rows: DataFrame, images: DataFrame, part: int = PART, limit: int = PASS_BYTES) -> DataFrame:
    """`rows` with `item`, the term of their `ordinal`."""
    context, found = rows.sparkSession.sparkContext, None
    columns = [*rows.columns, "item"]
    for held in _passes(images, limit):
        shared, numbers = context.broadcast(held), [n for n, _ in held]

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automata = {number: Transducer(image) for number, image in shared.value}
            for batch in batches:
                ordinals = batch.column(batch.schema.get_field_index("ordinal")).to_pylist()
                terms = [automata[o // part].key(o % part).rpartition(b"\0")[2].decode() for o in ordinals]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(terms, pa.string())], names=columns)

        mine = rows.where(F.floor(F.col("ordinal") / part).isin(numbers))
        named = mine.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*rows.dtypes, ("item", "string")]))
        found = named if found is None else found.unionAll(named)
    return rows.withColumn("item", F.lit("")) if found is None else found


def _share(count: str, total: str = "total", kept: str = "kept") -> Column:
    """p of a count, in whole numbers of any size."""
    wide = "cast({} as decimal(20, 0))"
    above = f"cast(1000000000 as decimal(10, 0)) * {wide.format(f'{count} + 2')}"
    return F.expr(f"1 + ({above}) div {wide.format(f'{total} + 2 * {kept}')}")


def _difference(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _tile(one: dict, two: dict, same: bool) -> np.ndarray:
    """Rows (source, other, sum): what the terms of a tile add to each pair beyond zero counts.

    A side holds `at` (numbers of its sources), `zero` (their shares of a zero count), and the counts that are there as
    `ordinal`, `source` and `p`.
    """
    terms = np.unique(np.concatenate([one["ordinal"], two["ordinal"]]))

    def dense(side: dict) -> np.ndarray:
        shares = np.repeat(side["zero"][:, None], len(terms), axis=1)
        shares[np.searchsorted(side["at"], side["source"]), np.searchsorted(terms, side["ordinal"])] = side["p"]
        return shares

    left = dense(one)
    right = left if same else dense(two)
    rows = []
    for i, p in enumerate(left):
        others = slice(i + 1, None) if same else slice(None)
        d, z = p - right[others], one["zero"][i] - two["zero"][others]
        beyond = (d * d // (p + right[others])).sum(axis=1) - len(terms) * (z * z // (one["zero"][i] + two["zero"][others]))
        rows.append(np.column_stack([np.full(len(beyond), one["at"][i]), two["at"][others], beyond]))
    return np.concatenate([np.zeros((0, 3), np.int64), *rows])


def _side(sources, cells) -> dict:
    """Arrays of a tile's side from its Arrow values."""
    s, c = sources.values, cells.values
    out = {"at": s.field("at"), "zero": s.field("zero")}
    out |= {k: (c.field(k) if c is not None else pa.array([], pa.int64())) for k in ("ordinal", "source", "p")}
    out = {k: v.to_numpy(zero_copy_only=False).astype(np.int64) for k, v in out.items()}
    order = np.argsort(out["at"])
    return out | {"at": out["at"][order], "zero": out["zero"][order]}


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, beyond for numbers a < b of sources with any kept term in common tiles.

    `shares` holds lang, number, ordinal, p; `groups` holds lang, number and zero.
    """
    block = F.floor(F.col("number") / SOURCES)
    sources = groups.groupBy("lang", block.alias("block")).agg(F.collect_list(F.struct(F.col("number").alias("at"), "zero")).alias("sources"))
    tile = F.floor(F.col("ordinal") / TILE)
    cells = shares.groupBy("lang", tile.alias("tile"), block.alias("block")).agg(
        F.collect_list(F.struct("ordinal", F.col("number").alias("source"), "p")).alias("cells")
    )
    cells = freeze(cells, "cells")
    sides = cells.select("lang", "tile").distinct().join(sources, "lang").join(cells, ["lang", "tile", "block"], "left")
    sides = freeze(sides, "sides")
    left = sides.toDF("lang", "tile", "one", "sources_1", "cells_1")
    right = sides.toDF("lang", "tile", "two", "sources_2", "cells_2")
    pairs = left.join(right, ["lang", "tile"]).where("one <= two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lang, same, *sides = (c[at] for c in batch.columns)
                found = _tile(_side(*sides[:2]), _side(*sides[2:]), same.as_py())
                arrays = [pa.array([lang.as_py()] * len(found), pa.string()), *(pa.array(found[:, i]) for i in range(3))]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "a", "b", "beyond"])

    tiles = pairs.select("lang", F.expr("one = two"), "sources_1", "cells_1", "sources_2", "cells_2")
    return tiles.mapInArrow(run, "lang string, a long, b long, beyond long").groupBy("lang", "a", "b").agg(F.sum("beyond").alias("beyond"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, part: int = PART, limit: int = PASS_BYTES) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module's head."""
    kept = vocabulary(docs, least)
    images = transducers(kept, part)
    counts = term_counts(docs, images, part, limit)
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    totals = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    words = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = _plain(docs).select(*GROUP).distinct().join(totals, GROUP, "left").join(words, "lang", "left").na.fill(0, ["total", "kept"])
    groups = groups.withColumn("number", number.cast("long")).withColumn("zero", F.when(F.col("kept") > 0, _share("0")))
    groups = freeze(groups, "groups")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole"))

    shares = counts.join(groups, GROUP).withColumn("p", _share("n"))
    both = _difference("p", "q")
    in_lang = F.sum("n").over(W.partitionBy("lang", "ordinal"))
    terms = shares.withColumn("all_n", in_lang).join(whole, "lang").withColumn("q", _share("all_n", "whole"))
    place = W.partitionBy(*GROUP).orderBy(F.desc("value"), "ordinal")
    terms = terms.where("p > q").select(*GROUP, "ordinal", both.alias("value")).withColumn("rank", F.row_number().over(place))
    terms = terms_of(freeze(terms.where(F.col("rank") <= top), "terms"), images, part, limit)

    sums = pair_sums(shares.select("lang", "number", "ordinal", "p"), groups.where("kept > 0").select("lang", "number", "zero"))
    one = groups.select("lang", "source", "number", "kept", F.col("zero").alias("p"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("zero").alias("q"))
    pairs = one.join(two, "lang").where("number <> other").withColumns({"a": F.least("number", "other"), "b": F.greatest("number", "other")})
    value = F.coalesce("beyond", F.lit(0)) + F.coalesce(F.col("kept") * both, F.lit(0))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", value)
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))

    def line(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*GROUP, F.lit(name).alias("part"), "item", F.col("value").cast("long"), F.col("rank").cast("int"))

    return line(pairs, "pair").unionAll(line(terms, "term"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


_LARGE, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_LARGE}', '{_SMALL}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
  occ AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
  kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
  v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
  grp AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
  gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
  ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
  p AS (SELECT grp.lang, grp.source, kept.term, coalesce(c.n, 0) AS n,
      1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(gn.total, 0) + 2 * v.v) AS p
    FROM grp JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = grp.lang AND gn.source = grp.source
      LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = kept.term),
  q AS (SELECT c.lang, c.term, 1 + (1000000000 * (sum(c.n) + 2)) // (any_value(ln.total) + 2 * any_value(v.v)) AS q
    FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY c.lang, c.term),
  t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term)
    WHERE n > 0 AND p > q),
  s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
