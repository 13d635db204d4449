"""Token alignment against plain counting with both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import alignment

PATHS = P.path(alignment.FIRST), P.path(alignment.SECOND)
LETTERS = "   \n\t\r\xa0\x85\x0b\x1cab1'sStTÉéñß$,.;)|_-　ſİς字é​\x00<|endoftext|></s><unk><0x41>"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def texts(n=250):
    rng = random.Random(13)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    code = ["if (x) {\r\n  y();\r\n}\r\n", "a;\r \r\n;\r", " ", "  ", "\n", " \n", "a ", "a  ", "\r", "x\r ", "holds ▁ one", "▁", "ﬁ ① ™"]
    return [*made, *made[:20], *code, "many  blanks   here    and\t\ttabs \t mixed", "z" * 700 + "".join(rng.choice("abcde") for _ in range(4000))]


def plain(rows, both):
    a_of, b_of = both
    letters = {c: b for b, c in alignment._byte_letters().items()}
    held = []
    for key, text in rows:
        a = a_of.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        one = [bytes(letters[c] for c in a_of.id_to_token(i)) for i in a]
        two = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(one) != (" " + text).encode() or b"".join(two) != (" " + text).encode():
            held.append((key, None, Counter()))
            continue
        ends = [set(np.cumsum(list(map(len, side))).tolist()) for side in (one, two)]
        cuts = sorted(ends[0] & ends[1])
        place = [np.searchsorted(cuts, np.cumsum(list(map(len, side)))).tolist() for side in (one, two)]
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, g in zip(ids, place[side]):
                groups[g][side].append(i)
        pairs = Counter()
        for x, y in groups:
            cx, cy = Counter(x), Counter(y)
            pairs.update({(i, j): n * m for i, n in cx.items() for j, m in cy.items()})
        held.append((key, (len(a), len(b), groups), pairs))
    counts = Counter(p for _, _, pairs in held for p in pairs)
    highest = {}
    for (i, _), n in counts.items():
        highest[i] = max(highest.get(i, 0), n)
    out = []
    for key, numbers, pairs in held:
        if numbers is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        name = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in numbers[2])
        best = sum(n for p, n in pairs.items() if counts[p] == highest[p[0]])
        total = sum(n * counts[p] for p, n in pairs.items())
        out.append((key, numbers[0], numbers[1], len(numbers[2]), sum(pairs.values()), best, total, hashlib.sha256(name.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("run, parts", [(alignment.RUN, None), (500, 5), (1, 1)])
def test_alignment(spark, odd, small, both, run, parts):
    mixed = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3)
    for docs in (odd, mixed) if run == 1 else (odd, mixed, small):
        got = alignment.align_documents(docs, *PATHS, parts, run)
        assert got.columns == COLUMNS
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, both)


def test_nothing(nothing):
    assert alignment.align_documents(nothing, *PATHS).collect() == []


def test_merge_of_runs():
    """Counts and maxima over frames against one dictionary."""
    rng = random.Random(2)
    frames, counts = [], Counter()
    for run in range(9):
        held = {rng.randint(0, 40) << 4 | rng.randint(0, 15): rng.randint(1, 3) for _ in range(rng.randint(1, 200))}
        counts.update(held)
        keys = np.array(sorted(held))
        frames.append((run, alignment.pack(alignment._steps(keys), np.array([held[k] for k in sorted(held)])), sorted(held)))
    highest = {}
    for k, n in counts.items():
        highest[k >> 4] = max(highest.get(k >> 4, 0), n)
    for (run, back), (_, _, keys) in zip(alignment.merge([f[:2] for f in frames], 4), frames):
        assert back.tolist() == [counts[k] << 1 | (counts[k] == highest[k >> 4]) for k in keys]


def test_frames_round_trip():
    arrays = [np.array([], np.int64), np.array([5, -1, 2**62]), np.arange(1000)]
    assert [a.tolist() for a in alignment.unpack(alignment.pack(*arrays))] == [a.tolist() for a in arrays]
