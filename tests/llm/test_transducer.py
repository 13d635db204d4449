"""The automaton against a sorted list."""

import random

import numpy as np
import pytest

from riskloom.llm import transducer


def words(n, rng):
    return sorted({"".join(rng.choice("abcé字") for _ in range(rng.randint(0, 7))).encode() for _ in range(n)})


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_ordinals_and_keys(n):
    rng = random.Random(n)
    keys = sorted(words(n, rng) + ([b"z" * 5000] if n else []))
    image = transducer.build(keys)
    for held in (image, transducer.mapped(image)):
        automaton = transducer.Transducer(held)
        assert automaton.keys == len(keys) and automaton.size == len(image)
        asked = [*keys, *words(200, rng), b"zz", b"\xff"]
        due = [keys.index(k) if k in keys else -1 for k in asked]
        assert [automaton.ordinal(k) for k in asked] == due
        ends = np.cumsum([len(k) for k in asked])
        data = np.frombuffer(b"".join(asked) + b"\0", np.uint8)
        assert automaton.ordinals(data, ends - [len(k) for k in asked], ends).tolist() == due
        assert [automaton.key(i) for i in range(len(keys))] == keys


def test_suffixes_are_shared():
    many = sorted(f"{a}{b}ation".encode() for a in "abcdefgh" for b in "xyz")
    assert transducer.Transducer(transducer.build(many)).states == 8  # one per depth


def test_order_is_checked():
    for keys in ([b"b", b"a"], [b"a", b"a"]):
        with pytest.raises(ValueError):
            transducer.build(keys)
