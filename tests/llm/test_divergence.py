"""The source divergence audit against plain counting."""

import re
from collections import Counter

import pytest

from riskloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top):
    docs = [(lang or "", source or "", [lower(t) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= least)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        whole = Counter(t for d in mine for t in d[2])

        def shares(held):
            total = sum(held[t] for t in kept)
            return [1 + 10**9 * (held[t] + 2) // (total + 2 * len(kept)) for t in kept]

        for s in counts:
            p = shares(counts[s])
            pairs = [(sum((x - y) ** 2 // (x + y) for x, y in zip(p, shares(counts[o]))), o) for o in counts if o != s]
            terms = [((x - y) ** 2 // (x + y), t) for x, y, t in zip(p, shares(whole), kept) if counts[s][t] and x > y]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:n]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def rows_of(docs):
    return [(r["lang"], r["source"], r["text"]) for r in docs.select("lang", "source", "text").collect()]


@pytest.mark.parametrize("part, limit", [(1_000_000, divergence.PASS_BYTES), (150, 1), (400, 300_000)])
def test_audit(small, part, limit, monkeypatch):
    if part == 150:
        small = small.limit(40)
        monkeypatch.setattr(divergence, "SOURCES", 2)
        monkeypatch.setattr(divergence, "TILE", 16)
    least = 3 if part == 150 else 10
    got = divergence.audit(small, least, 5, part, limit).collect()
    assert sorted(map(tuple, got)) == plain(rows_of(small), least, 5)
    assert len(got) > 100


def test_odd_tables(spark, odd, nothing):
    assert divergence.audit(nothing).collect() == []
    got = divergence.audit(odd, least=2)
    assert [f.name for f in got.schema] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows_of(odd), 2, 10)
    rows = [
        ("x", "a", "Éa bÀ 字 tie tie tied AB ab"), ("x", "a", "tie é 字"), ("x", "b", "ab aB"), ("x", "c", ""), ("x", None, None),
        ("x\0y", "a", "ab y"), ("x\0y", "b", "ab y y"), ("", "", "none"), (None, "b", "none 1 2 3"), ("z", "only", "one\x1c two_two"),
    ]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    for least in (1, 2, 100):
        for part in (2, 10**6):
            assert sorted(map(tuple, divergence.audit(docs, least, 3, part).collect())) == plain(rows, least, 3)


def test_a_task_lets_go_of_its_counts(small, monkeypatch):
    due = {tuple(r) for r in divergence.document_counts(small).collect()}
    monkeypatch.setattr(divergence, "_HELD", 50)
    assert {tuple(r) for r in divergence.document_counts(small).collect()} == due
