"""Decontamination, secrets, licenses, toxicity, archives and the pipeline."""

import base64
import hashlib
import io
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom import session
from riskloom.llm import decontamination, licenses, secrets, toxicity, warc


def test_decontamination_against_brute_force(spark, odd, nothing, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rng = random.Random(8)
    words = items[0][1].split()
    texts = [
        (9001, f"before {items[0][1]} after"),
        (9002, " ".join(words[: len(words) // 2])),
        (9003, " ".join(rng.sample(words, len(words)))),
        (9004, f"{'x ' * 700}{items[1][1].upper()}! {'y ' * 700}"),
    ]
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    more = bench.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "two words")], "item_id long, text string"))
    more = more.unionByName(spark.createDataFrame([(903, items[1][1])], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, more).collect()}
    due = set()
    for r in docs.collect():
        every = set(decontamination.shingles(decontamination.words_of(r["text"] or "")))
        for i, t in items:
            own = set(decontamination.shingles(decontamination.words_of(t)))
            if own and len(own & every) / len(own) >= 0.8:
                due.add((r["doc_id"], i))
    assert {p for p in got if p[1] < 900} == due and {(9001, 0), (9004, 1)} <= {(d, items.index(next(x for x in items if x[0] == i))) for d, i in due}
    assert (9004, 903) in got and not any(i in (900, 901) for _, i in got)
    clean = decontamination.decontaminate(docs, bench)
    assert clean.count() == docs.count() - len([r for r in docs.collect() if r["doc_id"] in {d for d, _ in due}])
    assert decontamination.contaminated(odd, bench).count() == 0 == decontamination.contaminated(nothing, bench).count()
    assert decontamination.decontaminate(odd, bench.where("false")).count() == odd.count()


def plain_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_secrets(odd, nothing, small):
    for docs in (odd, small, nothing):
        model = secrets.fit(docs)
        texts = [r["text"] or "" for r in docs.collect()]
        due = sorted(hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest() for t in texts)
        rows = secrets.scan(docs, model, ["doc_id"]).collect()
        assert sorted(r["base_sha256"] for r in rows) == due
        for r in rows:
            assert sum(s.startswith("assign") for s in r["spans"].split(",")) == r["n_assign"]
        redacted = secrets.redact(docs, model)
        assert redacted.columns == docs.columns and redacted.count() == docs.count()
        for r in redacted.collect():
            assert not plain_spans(r["text"] or "") and (r["text"] is None or r["n_chars"] == len(r["text"]))
    assert plain_spans("ſecret=abcdefgh paſſword:aaaaaaa") == [] == secrets.base_spans("ſecret=abcdefgh paſſword:aaaaaaa")


def test_grammar_tells_formats():
    rng = random.Random(9)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(200)]
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16)) for _ in range(200)]
    plain = ["".join(rng.choice(["ing", "ter", "on", "wa", "le"]) for _ in range(4)) for _ in range(200)]
    model = secrets.Model({"hex": hexes, "access": keys}, plain, secrets.Settings())
    automaton = model.kinds["access"][0]
    assert automaton.log_likelihood(keys[0]) > automaton.log_likelihood(keys[0][::-1])
    assert model.accepts("0a9b8c7d6e5f4a3b2c1d0e") and not model.accepts("waterleingonterle")
    for state in range(len(automaton.out)):  # the shares of all classes and of the end
        total = sum(automaton.took[state][c] + 0.5 for c in "0agA+/_.=-") + automaton.ended[state] + 0.5
        assert total == pytest.approx(automaton.came[state] + 5.5)
    # A run around a base span, what a base span leaves, short runs and such without digits or letters.
    token, tail = "ghp_" + hexes[0] + "XYZ", "0a9b8c7d6e5f4a3b"
    texts = [f"a {token}, b", f"-{'-' * 400}{hexes[1]}{'-' * 400}{tail}", f"{tail} 0a9b8c", "2024-01-01 0123456789 conversation", hexes[2] + " end"]
    for text in texts:
        base, spans = model.spans(text)
        due = set()
        for m in re.finditer("[A-Za-z0-9+/_.=-]{6,}", text):
            inside = [s for s in base if s[0] < m.end() and s[1] > m.start()]
            if any(s[0] <= m.start() and s[1] >= m.end() for s in inside):
                continue

            def passes(value, alone):
                if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
                    return False
                scores = [(a.log_likelihood(value) - model.plain.log_likelihood(value), least) for a, least in model.kinds.values()]
                return any(x >= 9.2 and x >= (least if alone else 0.5) * len(value) for x, least in scores)

            if passes(m[0], not inside):
                due.add((m.start(), m.end()))
            elif inside:
                free = "".join("\0" if any(s[0] <= i < s[1] for s in inside) else text[i] for i in range(m.start(), m.end()))
                due |= {(m.start() + x.start(), m.start() + x.end()) for x in re.finditer("[^\0]{6,}", free) if passes(x[0], True)}
        assert {s[:2] for s in spans if s[2] == "format"} == due
    assert [s[2] for s in model.spans(texts[0])[1]] == ["format", "hex"] and model.spans(texts[3])[1] == []


def test_licenses(spark, odd, nothing):
    texts = {
        1: "Some words.\nReleased under the MIT License.\nMore words here.",
        2: "licensed under cc by-nc 4.0",
        3: "The license of this dog was under the table.",
        4: "First part. " + licenses.TEMPLATES[4][1],
        5: None,
        6: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = licenses.scan(docs).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "MIT"), (2, "CC-BY-NC-4.0"), (4, "MIT")]
    found = {r["doc_id"]: texts[r["doc_id"]][r["span_start"] : r["span_end"]] for r in got}
    assert found[1] == "Released under the MIT License" and found[2] == texts[2]
    assert licenses.scan(odd).count() == 0 == licenses.scan(nothing).count()


def test_licenses_amid_text():
    """Over lines, amid sentences, cut short; and texts that only sound alike."""
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 300)
    cases = [
        ("The code below was written in a week. Released under\nthe MIT License. It has no tests.", ["MIT"]),
        ("This tool is released under the MIT License and hosted on a server.", ["MIT"]),
        ("X. Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the rest is kept.", ["BSD"]),
        ("so /* This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
         " Public License as published by the Free Software Foundation, either version 3 of the License */ it", ["GPL-3.0"]),
        ("before " + " ".join(mit.split()[:60]) + " after it all, words and words", ["MIT"]),
        ("Released under the MIT License. Licensed under CC BY 4.0.\n" * 3, ["MIT", "CC-BY-4.0"] * 3),
        ("İ ﬁ ẞ " * 5 + "released under the mit license", ["MIT"]),
        ("of the " * 500 + "the terms of the general public and the license under the table", []),
    ]
    held = licenses.Templates()
    for text, due in cases:
        got = held.matches(text)
        assert [m[2] for m in got] == due, text
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    start, end, _, dice = held.matches(cases[1][0])[0]
    assert cases[1][0][start:end] == "released under the MIT License" and dice == 1


def test_windows_against_all_windows():
    rng = random.Random(10)
    templates = [("a", "one two three four"), ("b", "two three two three five six seven"), ("c", "one one one two"), ("d", "solo")]
    held = licenses.Templates(templates)
    bags = [Counter(licenses.bigrams(t)) for _, t in templates]
    for _ in range(400):
        pairs = licenses.bigrams(" ".join(rng.choice("one two three four five six seven".split()) for _ in range(rng.randint(0, 25))))
        best = {}
        for i in range(len(pairs)):
            for k in range(i, len(pairs)):
                window = Counter(pairs[i : k + 1])
                for j, bag in enumerate(bags):
                    dice = 2 * (window & bag).total() / (window.total() + bag.total())
                    if dice >= 0.8 - 1e-12:
                        best[j] = max(best.get(j, 0), dice)
        got = {}
        for dice, first, last, j in held.windows(pairs):
            window = Counter(pairs[first : last + 1])
            assert dice == 2 * (window & bags[j]).total() / (window.total() + bags[j].total())
            got[j] = max(got.get(j, 0), dice)
        assert got == best


def test_toxicity_accuracy_and_edges(spark, odd, nothing):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))
    held = toxicity.score_documents(docs, model, ["doc_id"]).where(toxicity.held_out("doc_id")).join(labels, "doc_id")
    rows = held.select("predicted", "toxic").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.96
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.01 * len(rows)
    for r in toxicity.score_documents(odd, model).collect():
        assert 0 <= r["score"] < 0.5 and r["predicted"] == 0
    assert toxicity.score_documents(nothing, model).count() == 0
    counts = {t: 1 + i % 3 for i, t in enumerate(list(model.idf)[:9])}  # the pruned search is exact
    query = model._vector(counts)
    scores = np.zeros(model.blocks * model.settings.block)
    for t, w in query.items():
        for b, (places, weights) in model.postings.get(t, {}).items():
            scores[b * model.settings.block + places] += w * weights
    best = sorted(((round(float(s), 12), i) for i, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))[: model.settings.k]
    assert model.nearest(counts) == best
    bare = spark.createDataFrame([(1, None), (None, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(odd, toxicity.fit(odd, bare)).collect()} == {0.0}


@pytest.mark.parametrize("share, least", [(1, 86), (10, 54)])
def test_toxic_recall(spark, share, least):
    """Toxic held-out texts found, of 97, learning from all labels and from a tenth of them."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id") & (F.col("doc_id") % share == 0)))
    toxic = docs.join(labels.where(toxicity.held_out("doc_id") & (F.col("toxic") == 1)).select("doc_id"), "doc_id")
    assert toxicity.score_documents(toxic, model, ["doc_id"]).where("predicted = 1").count() >= least


def test_only_copies_count_once(spark):
    """Unlike texts that share their first term stay apart; copies of one label are one row."""
    texts = [" ".join(["0", *(f"w{i}x{k}" for k in range(12))]) for i in range(20)] + ["0 Twice, told."] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    number = {t: i for i, t in enumerate(sorted({t for x in texts for t in toxicity.terms_of(x)}))}
    features = toxicity._features(docs, number, set(number.values()), ["doc_id"]).withColumn("toxic", F.lit(0))
    assert toxicity._one_of_each(features).count() == 21


def test_archives(spark, tmp_path):
    big = "é" * 500_000
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, None, big), (4, "u\r\nx", big), (5, "u", None), (6, "u", ""), (None, None, "only"), (7, "u", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record string")
    folder = str(tmp_path / "warc")
    warc.write(pages, folder)
    got = sorted(map(tuple, warc.read(spark, folder).collect()), key=str)
    last = {"same": 2, big: 4, "": 6, "only": None, "\r\n\r\n": 7}
    due = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = page != last[html or ""]
        due.append(
            (page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[html or ""] if revisit else None)
        )
    assert got == sorted(due, key=str)
    sink = io.BytesIO()
    for archive in [r["archive"] for r in spark.read.parquet(folder).select("archive").distinct().collect()]:
        warc.export(spark, folder, archive, sink)
    data, records = sink.getvalue(), 0
    while data:  # the joined bytes are WARC records
        head, rest = data.split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        data, records = rest[size + 4 :], records + 1
    assert records == len(rows)
    warc.write(pages.where("false"), folder + "0")
    assert warc.read(spark, folder + "0").count() == 0
    warc.write(pages, folder + "1", least=10)
    assert [r["page_id"] for r in warc.read(spark, folder + "1").where("record_type = 'revisit'").collect()] == [3]


@pytest.mark.parametrize("which", ["odd", "small", "nothing"])
def test_pipeline_stages(spark, which, request):
    docs = request.getfixturevalue(which)
    for name in ("score", "predicted", "matches", "text_", "cell", "root"):  # names that operators use
        docs = docs.withColumn(name, F.lit(f"my {name}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        both = [c for c in docs.columns if name != "secret_scan" or c not in ("text", "n_chars")]
        rows = [Counter(map(tuple, df.select(both).collect())) for df in (out, docs)]
        assert rows[0] <= rows[1], name  # whole rows, none made up
        docs = out
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert encoded.count() == docs.count() and {"doc_id", "n_tokens", "ids"} <= set(encoded.columns)


def test_groups_of_items_find_the_same(spark, small):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    n = benchmark.count()
    one = sorted(map(tuple, decontamination.contaminated(small, benchmark).select("doc_id", "item_id").collect()))
    many = decontamination.contaminated(small, benchmark, most=max(1, n // 4)).select("doc_id", "item_id").collect()
    assert one and sorted(map(tuple, many)) == one
    left = sorted(r["doc_id"] for r in decontamination.decontaminate(small, benchmark, most=max(1, n // 3)).collect())
    assert left == sorted({r["doc_id"] for r in small.collect()} - {d for d, _ in one})


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and len(list((tmp_path / "riskloom").iterdir())) == 1
