"""SimHash, embeddings and their components against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import embedding_graph, graph, simhash


def classes(ids, linked):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i, x in enumerate(ids):
        members.setdefault(root(i), []).append(x)
    return [min((x for x in members[root(i)] if x is not None), default=None) for i in range(len(ids))]


def plain_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("which", ["odd", "small", "nothing"])
def test_simhash(which, request):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_print(r["text"]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    due = classes([r["doc_id"] for r in rows], linked)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(str, got)) == sorted(
        f"Row(doc_id={r['doc_id']}, fingerprint='{p:016x}', component_id={c})" for r, p, c in zip(rows, prints, due)
    )
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(due))
    assert Counter(map(tuple, kept.collect())) <= Counter(map(tuple, docs.collect()))  # whole rows, as they came


@pytest.mark.parametrize("lanes", [1, 4, 8, 16])
def test_small_tiles_and_planted_bits(spark, lanes):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    flips = [int(b) ^ (1 << int(i)) for b in base[:30] for i in rng.integers(0, 63, 3)]
    prints = sorted({*map(int, base), *flips, 0, -1})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["fp"]: r["root"] for r in graph.components(simhash.links(df, tile=3, lanes=lanes), "a", "b").toDF("fp", "root").collect()}
    n = [p & (2**64 - 1) for p in prints]
    linked = [(i, j) for i in range(len(n)) for j in range(i) if (n[i] ^ n[j]).bit_count() <= 2]
    due = classes(prints, linked)
    assert [got.get(p, p) for p in prints] == due


def test_pipeline_keeps_one_of_each_group(spark, small):
    """The stage against brute force, with edited copies: those within two bits go, the others stay."""
    rng = np.random.default_rng(6)
    rows, k = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()], 10**6
    for _, text in rows[:100]:
        words = (text or "").split()
        if len(words) >= 50:
            words[rng.integers(len(words))] = f"changed{k}"
            rows.append((k := k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    prints = [plain_print(t) for _, t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert any(rows[i][0] >= 10**6 for i, _ in close)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(classes([i for i, _ in rows], close)))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 50), (None, 1), (61, 60)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 60: 60, 61: 60}
    assert graph.components(edges.where("false"), "a", "b").count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    near = np.repeat(base[:1], 80, axis=0) + rng.normal(size=(80, 16)) * 0.03
    rows = [list(map(float, v)) for v in [*base, *near, base[1], base[1], base[2] * 5]]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [], [1.0, 2.0], [2.0, 4.1], [2.0, -1.0], [1.0], [5.0], [1.0] * 3]
    ids = [*range(len(rows)), *range(1000, 1000 + len(odd)), None]
    rows = [*rows, *odd, rows[3]]
    df = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, rows)], "vec_id long, embedding array<double>, n_links string")
    unit = []
    for v in rows:
        a = np.array(v if v and None not in v else [0.0])
        n = np.linalg.norm(a) if np.isfinite(a).all() else 0
        unit.append(a / n if n > 0 else None)
    linked = [(i, j) for i, a in enumerate(unit) for j, b in enumerate(unit[:i]) if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95]
    degree = [sum(i in pair for pair in linked) for i in range(len(rows))]
    due = {(i, d, c, i == c) for i, d, c in zip(ids, degree, classes(ids, linked))}
    for settings in (embedding_graph.Settings(), embedding_graph.Settings(shard=60, sample=128, audit=400, recall=1.0)):
        got = embedding_graph.near_duplicates(df.select("vec_id", "embedding", "n_links"), settings)
        assert {tuple(r) for r in got.collect()} == due
    assert embedding_graph.near_duplicates(df.where("false")).count() == 0


def test_an_audit_that_fails_is_an_error(spark):
    rows = [(i, [1.0, i / 1000]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        embedding_graph.near_duplicates(df, embedding_graph.Settings(overlap=8, recall=1.1))


def test_search_finds_what_brute_force_finds():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(500, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lists = embedding_graph.prune(v, embedding_graph.Settings())
    found = embedding_graph.search(v, v, lists, 24, 0.8)
    due = v @ v.T >= 0.8
    assert sum(len(f) for f in found) >= 0.99 * due.sum() and all(due[i, f].all() for i, f in enumerate(found))
