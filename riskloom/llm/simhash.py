"""SimHash near-dedup by tiled exact comparison.

A fingerprint has bit i set if more than half of the hashes of the text's word shingles have it. Different
fingerprints (copies meet in one row first) are dealt into tiles whose members have the same population counts
in each of several lanes of bits. The counts of two fingerprints differ by no more than their bits do, so a pair of
tiles whose counts differ by more than the radius, summed over the lanes, is skipped. Four lanes leave about 1.4 %
of all pairs to be compared, eight 0.03 %, sixteen 0.00003 %, but each doubling gives a tile more than three times the
neighbours; so the number of lanes follows the number of different fingerprints (`lanes_for`). It changes what is
skipped, never what is found. All others are compared
exactly: numpy exclusive-or and bit counts, in blocks. Of the links inside a pair of tiles a spanning forest is
kept, which loses no connection; so neither all pairs of a group nor its members ever stand in one row.

A tile holds about `TILE` fingerprints; fuller cells are split by hash into several tiles, and every pair of
these is compared. Null and word-less texts have fingerprint zero, which is linked like any other. Repeated rows
and ids fall into one component; rows without id take part, and their component is the smallest id in it
(null if it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.graph import components
from riskloom.llm.rows import documents, with_columns_from_text
from riskloom.session import freeze

WORDS = 3
RADIUS = 2
SEED = 42
TILE = 4096
_RUN = 65_536  # shingles hashed at one time


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text; 0 without words.

    Bytes methods split at exactly U+0020 and U+0009 to U+000D and lower exactly A to Z.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _RUN):
        cuts = zip(starts[at : at + _RUN].tolist(), ends[at : at + _RUN].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in cuts], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """`docs` with `fp`, the fingerprint as a signed long."""

    def make():
        def work(text: str) -> tuple:
            value = fingerprint(text, words)
            return (value - (1 << 64) if value >> 63 else value,)

        return work

    return with_columns_from_text(docs, make, "fp long", keep)


def lanes_for(n: int) -> int:
    """Lanes for `n` fingerprints: more once a cell of the present ones holds more than a few hundred on average."""
    return 4 if n < 4_000_000 else 8 if n < 4_000_000_000 else 16


def _steps(radius: int, lanes: int) -> list[int]:
    """Differences of two cells, as packed numbers, that tiles within the radius can have; one of each pair of signs."""
    units = [sign * _base(radius, lanes) ** i for i in range(lanes) for sign in (1, -1)]
    reached = {0}
    for _ in range(radius):
        reached |= {at + unit for at in reached for unit in units}
    return sorted(step for step in reached if step >= 0)


def _base(radius: int, lanes: int) -> int:
    """Base in which the counts of the lanes are packed into a number, with room for a step in either direction."""
    return 64 // lanes + 2 * radius + 1


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two arrays of fingerprints (or within one, given twice)."""
    edges: list[tuple[int, int]] = []
    label = np.arange(len(left) + len(right))
    if left is right:
        label[len(left) :] = label[: len(left)]
    for at in range(0, len(left), 256):
        near = np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            found = np.flatnonzero(near[i])
            mine = label[at + i]
            others, first = np.unique(label[len(left) + found], return_index=True)
            new = others != mine
            if new.any():
                edges += [(int(left[at + i]), int(right[found[k]])) for k in first[new]]
                label[np.isin(label, others[new])] = mine
    return edges


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, lanes: int | None = None) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints `fp` connected by steps of at most `radius` bits."""
    lanes = lanes or lanes_for(prints.count())
    width = 64 // lanes
    ones = F.lit((1 << width) - 1 if width < 64 else -1)
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(ones)) for i in range(lanes)]
    cell = sum((count.cast("long") * _base(radius, lanes) ** i for i, count in enumerate(counts)), F.lit(0))
    prints = prints.select("fp", cell.alias("cell"))
    filled = prints.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = (
        prints.join(filled, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), "parts").alias("part"))
        .agg(F.collect_list("fp").alias("prints"))
    )
    tiles = freeze(tiles, "tiles")
    steps = F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(radius, lanes)]))
    left = tiles.select(F.col("cell").alias("own"), F.col("part").alias("a"), F.col("prints").alias("left"), steps.alias("step"))
    pairs = left.withColumn("cell", F.col("own") + F.col("step")).join(tiles, "cell")
    pairs = pairs.where("step > 0 or a <= part")

    def compare(batches):
        for batch in batches:
            edges = []
            for at in range(batch.num_rows):
                same, one, two = (c[at] for c in batch.columns)
                x = one.values.to_numpy().view(np.uint64)
                y = x if same.as_py() else two.values.to_numpy().view(np.uint64)
                edges += _forest(x, y, radius)
            flat = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

    return pairs.select((F.col("step") == 0) & (F.col("a") == F.col("part")), "left", "prints").mapInArrow(compare, "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): the root fingerprint of each one in `prints` (different ones) that has a link to another."""
    return components(links(prints, radius), "a", "b").select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    prints = freeze(with_fingerprint(docs, ["doc_id"], words), "fingerprints")
    heads = freeze(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    roots = heads.join(groups(heads.select("fp"), radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("head").alias("component_id"))
    classes = roots.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """`docs` with one row of each group: that with the smallest id (rows without id last, then by content)."""
    kept = docs.columns
    keys = [F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id")]
    marked = docs.select(*kept, *keys, F.xxhash64(*kept).alias("__row"))
    prints = freeze(with_fingerprint(marked, ["__none", "__id", "__row"], words), "fingerprints")
    heads = freeze(prints.groupBy("fp").agg(F.min(F.struct("__none", "__id", "__row")).alias("head")), "heads")
    roots = heads.join(groups(heads.select("fp"), radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stay = roots.groupBy("root").agg(F.min("head").alias("head")).select("head.*")
    left = marked.join(stay, ["__none", "__id", "__row"], "left_semi")
    return left.dropDuplicates(["__none", "__id", "__row"]).select(*kept)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
