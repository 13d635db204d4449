"""Embedding near-dedup by a robust-pruned flat graph.

Vectors (equal ones meet in one row first) are assigned to their `overlap` nearest of a set of centres, so that the
clusters overlap; a cluster of more than `shard` vectors is dealt by hash into several shards. In each shard every
vector gets as neighbours a robustly pruned choice from its nearest and some other vectors of the shard: a nearer
neighbour drops those that are nearer to it than to the vector by the factor `alpha`. A vector's lists from all its
shards are united to the flat graph, which is laid out by shard again together with the vectors.

Searching, all vectors of a cluster look through each shard of it: a greedy search of beam `beam` from the shard's
medoid that, once inside the radius, goes on as long as it finds further vectors there. What it finds is verified
by the cosine in double precision. A pair that shares several shards is counted in the first of them only, so degrees
add up, and of the links of a shard a spanning forest is kept: no row ever holds a group's pairs.

The audit searches bounded samples of vectors (of all, and of linked ones with few and with many links) by brute force
through all rows; while the mean recall is below `recall`, the whole is done again with one more cluster per vector
and a wider beam. If the widest settings do not reach it either, that is an error: no result goes out unaudited.

Vectors that are null, of length zero or hold null or non-finite components link with nothing. Vectors of different dimensions
do not link; each dimension is searched by itself, one after the other. Null ids count as larger than all others; repeated rows of an id are
rows of their own that link with each other. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.graph import components
from riskloom.llm.rows import table
from riskloom.session import freeze


@dataclasses.dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    shard: int = 1500  # vectors in a shard, about
    overlap: int = 3  # clusters of a vector
    sample: int = 8192  # vectors that centres are found from; also bounds their number to an eighth of it
    degree: int = 24  # neighbours of a vector in a shard
    pool: int = 64  # candidates that they are chosen from
    alpha: float = 1.2
    beam: int = 24
    audit: int = 100
    recall: float = 0.97


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(vec, head, n): different valid vectors as bytes of unit-length doubles, the smallest id and number of rows of each."""
    plain = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def pack(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                e = batch.column(1)[i]
                v = None
                if e.is_valid and e.values.null_count == 0 and len(e):
                    v = e.values.to_numpy(zero_copy_only=False)
                    length = np.sqrt(v @ v) if np.isfinite(v).all() else 0.0
                    if np.isinf(length) or 0 < length < 1e-150:  # squares leave the range of doubles
                        v = v / np.abs(v).max()
                        length = np.sqrt(v @ v)
                    v = (v / length + 0.0).astype("<f8").tobytes() if length > 0 else None
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return plain.mapInArrow(pack, "vec_id long, vec binary")


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    centres = sample[:k].copy()
    for _ in range(4):
        near = np.argmax(sample @ centres.T, axis=1)
        for c in range(k):
            mine = sample[near == c]
            if len(mine):
                mean = mine.mean(axis=0)
                centres[c] = mean / (np.linalg.norm(mean) or 1.0)
    return centres


def _assign(vectors: np.ndarray, centres: np.ndarray, overlap: int) -> list[list[int]]:
    near = vectors @ centres.T
    return np.sort(np.argsort(-near, axis=1, kind="stable")[:, :overlap], axis=1).tolist()


def prune(vectors: np.ndarray, settings: Settings) -> list[np.ndarray]:
    """Robustly pruned neighbours (places) of every vector of a shard, made mutual."""
    n = len(vectors)
    lists: list[set[int]] = [set() for _ in range(n)]
    rng = np.random.default_rng(n)
    size = min(settings.pool, n - 1)
    for at in range(0, n if size > 0 else 0, 128):
        rows = np.arange(at, min(at + 128, n))
        near = vectors[rows] @ vectors.T
        near[np.arange(len(rows)), rows] = -9
        pool = np.argpartition(-near, size - 1, axis=1)[:, :size]
        others = rng.integers(0, n, (len(rows), 16))  # far vectors, so that the graph hangs together
        pool = np.concatenate([pool, others], axis=1)
        to_me = 1 - np.take_along_axis(near, pool, axis=1)
        to_me[pool == rows[:, None]] = np.inf
        among = 1 - np.einsum("rid,rjd->rij", vectors[pool], vectors[pool])
        for _ in range(settings.degree):
            best = np.argmin(to_me, axis=1)
            r = np.arange(len(rows))
            mine = to_me[r, best]
            for i in np.flatnonzero(np.isfinite(mine)):
                lists[rows[i]].add(int(pool[i, best[i]]))
            if not np.isfinite(mine).any():
                break
            dropped = settings.alpha * among[r, best] <= to_me
            to_me[dropped] = np.inf
            to_me[r, best] = np.inf
    for i in range(n):
        for j in list(lists[i]):
            lists[j].add(i)
    return [np.array(sorted(x), np.int64) for x in lists]


def search(queries: np.ndarray, vectors: np.ndarray, lists: list[np.ndarray], beam: int, least: float) -> list[np.ndarray]:
    """Places of the vectors with at least the cosine `least` to each query, found over the graph from the medoid."""
    n, m = len(vectors), len(queries)
    widest = max((len(x) for x in lists), default=0)
    near_to = np.full((n + 1, max(1, widest)), n)
    for i, x in enumerate(lists):
        near_to[i, : len(x)] = x
    padded = np.vstack([vectors, np.zeros(vectors.shape[1])])
    medoid = int(np.argmax(vectors @ vectors.mean(axis=0)))
    near = np.full((m, n + 1), -2.0)  # cosine where seen
    open_ = np.full((m, n + 1), -2.0)  # the same, until expanded
    near[:, medoid] = open_[:, medoid] = queries @ vectors[medoid]
    live = np.arange(m)
    width = min(beam, n)
    while len(live):
        part = open_[live]
        step = min(8, n)
        best = np.argpartition(-part, step - 1, axis=1)[:, :step]
        worth = np.take_along_axis(part, best, axis=1)
        floor = -np.partition(-near[live, :n], width - 1, axis=1)[:, width - 1]
        go = (worth > -2) & ((worth >= floor[:, None]) | (worth >= least))
        top = worth.max(axis=1, keepdims=True)
        go &= (worth >= least) | (worth == top)  # greedy outside the radius, all at once inside it
        some = go.any(axis=1)
        live, best, go = live[some], best[some], go[some]
        if not len(live):
            break
        q, k = np.nonzero(go)
        open_[live[q], best[q, k]] = -2
        to = near_to[best[q, k]]
        who = np.repeat(live[q], to.shape[1])
        to = to.ravel()
        fresh = (to < n) & (near[who, to] == -2)
        who, to = who[fresh], to[fresh]
        code = np.unique(who * (n + 1) + to)
        who, to = code // (n + 1), code % (n + 1)
        cosine = np.einsum("id,id->i", queries[who], padded[to])
        near[who, to] = open_[who, to] = cosine
    return [np.flatnonzero(near[i, :n] >= least) for i in range(m)]


def links(vectors: DataFrame, settings: Settings) -> DataFrame:
    """(a, degree, b): for each vector `head`, rows whose degrees sum to its linked rows, and edges that connect it.

    `vectors`: stored (vec, head, n), `head` unique.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    few = vectors.select("vec").orderBy(F.xxhash64("head")).limit(settings.sample).collect()
    if not few:
        return spark.createDataFrame([], "a long, degree long, b long")
    sample = np.frombuffer(b"".join(bytes(r[0]) for r in few), "<f8").reshape(len(few), -1)
    k = max(1, min(-(-total * settings.overlap // settings.shard), -(-len(few) // 8)))
    shared = spark.sparkContext.broadcast(_centres(sample, k))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                clusters = _assign(_matrix(batch.column(0)), shared.value, settings.overlap)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(clusters, pa.list_(pa.int32()))], names=["vec", "head", "n", "clusters"]
                )

    assigned = vectors.select("vec", "head", "n").mapInArrow(assign, "vec binary, head long, n long, clusters array<int>")
    members = assigned.withColumn("cluster", F.explode("clusters"))
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / settings.shard).alias("parts"))
    members = members.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("head"), "parts"))
    members = freeze(members, "members")

    def build(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(2)[i].values
                heads = shard.field("head").to_numpy()
                lists = prune(_matrix(shard.field("vec")), settings)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(heads), pa.array([heads[x] for x in lists], pa.list_(pa.int64()))], names=["head", "to"]
                )

    entries = F.array_sort(F.collect_list(F.struct("head", "vec", "n", "clusters"))).alias("entries")
    shards = members.groupBy("cluster", "part").agg(entries)
    flat = shards.mapInArrow(build, "head long, to array<long>").groupBy("head").agg(
        F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")
    )
    graph = freeze(
        members.join(flat, "head").groupBy("cluster", "part").agg(
            F.array_sort(F.collect_list(F.struct("head", "vec", "n", "clusters", "to"))).alias("nodes")
        ),
        "graph",
    )
    # All vectors of a cluster against each of its shards: blocks of queries, the shard's own vectors among them.
    blocks = graph.select("cluster", F.transform("nodes", lambda x: x.dropFields("to")).alias("queries"))
    pairs = graph.join(blocks, "cluster").select("cluster", "nodes", "queries")

    def find(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                out += _linked(batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].values, settings)
            flat = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["a", "degree", "b"])

    return pairs.mapInArrow(find, "a long, degree long, b long")


def _linked(cluster: int, nodes: pa.Array, queries: pa.Array, settings: Settings) -> list[tuple[int, int, int]]:
    vectors, heads, n = _matrix(nodes.field("vec")), nodes.field("head").to_numpy(), nodes.field("n").to_numpy()
    place = {h: i for i, h in enumerate(heads.tolist())}
    lists = [np.array([place[t] for t in to if t in place], np.int64) for to in nodes.field("to").to_pylist()]
    clusters = nodes.field("clusters").to_pylist()
    asked, own = _matrix(queries.field("vec")), queries.field("head").to_numpy()
    mine = queries.field("clusters").to_pylist()
    # Where this is the first cluster that two vectors share, their pair is counted here.
    before = [frozenset(c for c in x if c < cluster) for x in clusters]
    group: dict[int, int] = {}  # component by node and by query of this block
    out = []

    def root(x):
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    for at in range(0, len(asked), 256):
        part = asked[at : at + 256]
        for i, found in enumerate(search(part, vectors, lists, settings.beam, settings.cosine - 1e-9), at):
            exact = vectors[found] @ asked[i]
            found = found[(exact >= settings.cosine) & (heads[found] != own[i])]
            earlier = {c for c in mine[i] if c < cluster}
            counted = [j for j in found.tolist() if not earlier or earlier.isdisjoint(before[j])]
            degree, a = int(n[counted].sum()), int(own[i])
            if not len(found):
                continue
            edges = []
            for j in found.tolist():
                x, y = root(a), root(int(heads[j]))
                if x != y:
                    group[max(x, y)] = min(x, y)
                    edges.append(int(heads[j]))
            out += [(a, degree if e == 0 else 0, b) for e, b in enumerate(edges or [a])]
    return out


def audited_recall(vectors: DataFrame, degrees: DataFrame, settings: Settings) -> float:
    """Mean over vectors of the share of their links that was found, against brute force over all rows.

    Two samples of at most `Settings.audit` vectors each are asked about: of all, and of those for which links were found, half of
    these with few links and half with many, so that neither one large group nor the unlinked mass hides the rest. 1 if
    none of them has a link.
    """
    order = F.xxhash64("head", F.lit(1))
    linked = vectors.join(degrees.where("degree > 0"), "head").select("vec", "head", "degree")
    middle = linked.agg(F.percentile_approx("degree", 0.5)).first()[0] or 0
    parts = [vectors.select("vec", "head").orderBy(order).limit(settings.audit)]
    for side in (F.col("degree") <= middle, F.col("degree") > middle):
        parts.append(linked.where(side).select("vec", "head").orderBy(order).limit(settings.audit // 2))
    few = list({r["head"]: r for part in parts for r in part.collect()}.values())
    if not few:
        return 1.0
    heads = np.array([r["head"] for r in few])
    asked = vectors.sparkSession.sparkContext.broadcast(
        np.frombuffer(b"".join(bytes(r["vec"]) for r in few), "<f8").reshape(len(few), -1)
    )

    def compare(batches):
        total = np.zeros(len(heads), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(0)) @ asked.value.T >= settings.cosine
                near &= batch.column(1).to_numpy()[:, None] != heads[None, :]
                total += near.T @ batch.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(total)], names=["head", "due"])

    due = vectors.select("vec", "head", "n").mapInArrow(compare, "head long, due long").groupBy("head").agg(F.sum("due").alias("due"))
    share = F.least(F.coalesce("degree", F.lit(0)) / F.col("due"), F.lit(1.0))
    mean = due.where("due > 0").join(degrees, "head", "left").agg(F.avg(share)).first()[0]
    return 1.0 if mean is None else mean


def _audited_links(groups: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Links and degrees of vectors of one dimension; with wider settings until the audit is content.

    Raises RuntimeError if it is not at the widest (eight shards per vector).
    """
    while True:
        found = freeze(links(groups.select("vec", "head", "n"), settings), "links")
        degrees = found.groupBy(F.col("a").alias("head")).agg(F.sum("degree").alias("degree"))
        recall = audited_recall(groups, degrees, settings)
        if recall >= settings.recall:
            return found, degrees
        if settings.overlap >= 8:
            raise RuntimeError(f"recall of {recall:.3f} instead of {settings.recall}; give larger settings")
        settings = dataclasses.replace(settings, overlap=settings.overlap + 1, beam=settings.beam * 2)


def near_duplicates(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of `rows` (vec_id, embedding)."""
    packed = freeze(distinct_vectors(rows), "packed")
    valid = packed.where("vec is not null")
    groups = valid.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    groups = freeze(groups.withColumn("head", F.xxhash64("vec", "least")), "vectors")
    # Vectors of different dimensions have no cosine; each dimension (mostly there is one) is searched by itself.
    size = F.octet_length("vec")
    sizes = [r["size"] for r in groups.groupBy(size.alias("size")).count().where("count > 1").orderBy("size").collect()]
    parts = [_audited_links(groups.where(size == n), settings) for n in sizes] or [_audited_links(groups.limit(0), settings)]
    found, degrees = (reduce(DataFrame.unionAll, side) for side in zip(*parts))
    roots = components(found, "a", "b").withColumnRenamed("node", "head")
    named = groups.join(degrees, "head", "left").join(roots, "head", "left").withColumn("root", F.coalesce("root", "head"))
    named = freeze(named.select("vec", "n", "least", "root", "degree"), "named")
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_vector = named.join(classes, "root").select(
        "vec", "component_id", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    out = packed.join(per_vector, "vec", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_graph(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP2_SQL = """
  WITH RECURSIVE valid AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
      ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
  reach AS (SELECT a AS v, a AS r FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
  SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least_id, vec_id) AS component_id,
    vec_id = coalesce(least_id, vec_id) AS kept
  FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON vec_id = d.a
    LEFT JOIN (SELECT v, min(r) AS least_id FROM reach GROUP BY v) c ON vec_id = c.v"""
