"""Minimal acyclic transducers: sorted keys as an automaton with shared suffixes that gives each key its ordinal.

Keys come in ascending byte order. A state that no later key can change is looked up among the finished ones by
its finality and transitions, and shared if it is there, so the automaton is minimal all the while. A transition
carries the number of keys that stand before those behind it; summed along a path this is the ordinal of the key
in lexicographic order, and the walk can be turned round to get the key of an ordinal.

The result is one flat image that is used where it lies, be it bytes or a mapping: transitions as a sorted array
of (state, byte) with target and number, a hash table that tells their places, and the final states. Many words are
walked at one time: each round takes the next byte of all that are still alive.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterable

import numpy as np

HEAD = 5  # numbers in front: keys, states, transitions, root, bits of the hash table
_ODD = np.uint64(0x9E3779B97F4A7C15)


def build(keys: Iterable[bytes]) -> bytes:
    """Image of the automaton of different `keys` in ascending order."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, byte, target, byte, target ...), finished ones, targets first
    path: list[list] = [[False]]  # the states along the last key
    last, n = None, 0

    def finish(depth: int) -> None:
        for at in range(len(path) - 1, depth, -1):
            state = tuple(path.pop())
            known = register.get(state)
            if known is None:
                known = register[state] = len(states)
                states.append(state)
            path[-1][-1] = known

    for key in keys:
        if last is not None:
            if key <= last:
                raise ValueError("keys must be different and in ascending order")
            limit = min(len(key), len(last))
            same = 0
            while same < limit and key[same] == last[same]:
                same += 1
            finish(same)
        else:
            same = 0
        for byte in key[same:]:
            path[-1] += (byte, None)
            path.append([False])
        path[-1][0] = True
        last, n = key, n + 1
    finish(0)
    states.append(tuple(path[0]))
    return _image(states, n)


def _image(states: list[tuple], n: int) -> bytes:
    behind: list[int] = []  # keys from each state on
    steps, targets, before = [], [], []
    for number, state in enumerate(states):
        count = int(state[0])
        for byte, target in zip(state[1::2], state[2::2]):
            steps.append(number << 8 | byte)
            targets.append(target)
            before.append(count)
            count += behind[target]
        behind.append(count)
    final = np.array([s[0] for s in states], np.uint8)
    steps = np.array(steps, "<i8")
    bits = max(4, (3 * len(steps)).bit_length())
    parts = [
        np.array([n, len(states), len(steps), len(states) - 1, bits], "<i8"), steps, np.array(before, "<i8"),
        np.array(targets, "<i8"), *hashed(steps, bits), np.pad(final, (0, -len(final) % 8)),
    ]
    return b"".join(p.tobytes() for p in parts)


def slots(steps: np.ndarray, bits: int) -> np.ndarray:
    return ((steps.view(np.uint64) * _ODD) >> np.uint64(64 - bits)).view(np.int64)


def hashed(steps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Open hash table of `steps`: the step in each slot (-1: none) and its place."""
    held, place = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
    left, slot = np.arange(len(steps)), slots(steps, bits)
    while len(left):
        free = np.flatnonzero(held[slot] < 0)
        mine, first = np.unique(slot[free], return_index=True)
        held[mine], place[mine] = steps[left[free[first]]], left[free[first]]
        on = np.ones(len(left), bool)
        on[free[first]] = False
        left, slot = left[on], (slot[on] + 1) & ((1 << bits) - 1)
    return held, place


def find(held: np.ndarray, place: np.ndarray, bits: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `steps` a table of `hashed` holds, and the places of all (of use for those that it does)."""
    slot = slots(steps, bits)
    there = held[slot]
    on = np.flatnonzero((there != steps) & (there >= 0))
    while len(on):
        slot[on] = following = (slot[on] + 1) & ((1 << bits) - 1)
        there[on] = now = held[following]
        on = on[(now != steps[on]) & (now >= 0)]
    return there == steps, place[slot]


def mapped(image: bytes) -> mmap.mmap:
    """The image as a read-only mapping of a memory file: it is on no disk, and gone with the process."""
    file = os.memfd_create("transducer")
    try:
        view = memoryview(image)
        while view:
            view = view[os.write(file, view) :]
        return mmap.mmap(file, len(image), prot=mmap.PROT_READ)
    finally:
        os.close(file)


class Transducer:
    """An image, read in place."""

    def __init__(self, image):
        self.keys, self.states, moves, self.root, self.bits = (int(x) for x in np.frombuffer(image, "<i8", HEAD))
        at, arrays = 8 * HEAD, []
        for n in (moves, moves, moves, 1 << self.bits, 1 << self.bits):
            arrays.append(np.frombuffer(image, "<i8", n, at))
            at += 8 * n
        self.steps, self.before, self.targets, self.held, self.place = arrays
        self.final = np.frombuffer(image, np.uint8, self.states, at)
        self.size = at + self.states + -self.states % 8

    def _find(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return find(self.held, self.place, self.bits, steps)

    def walk(self, key: bytes) -> tuple[int, int]:
        """State behind `key` (-1 if no key begins so) and the number of keys before it."""
        state, number = self.root, 0
        for byte in key:
            known, (i,) = self._find(np.array([state << 8 | byte]))
            if not known[0]:
                return -1, 0
            state, number = int(self.targets[i]), number + int(self.before[i])
        return state, number

    def ordinal(self, key: bytes) -> int:
        state, number = self.walk(key)
        return number if state >= 0 and self.final[state] else -1

    def key(self, ordinal: int) -> bytes:
        """The key of an ordinal below `keys`."""
        out, state = bytearray(), self.root
        while ordinal >= self.final[state]:
            low, high = np.searchsorted(self.steps, [state << 8, (state + 1) << 8])
            i = low + int(np.searchsorted(self.before[low:high], ordinal, "right")) - 1
            out.append(int(self.steps[i]) & 255)
            ordinal -= int(self.before[i])
            state = int(self.targets[i])
        return bytes(out)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states=None, numbers=None) -> np.ndarray:
        """Ordinals of the words data[starts:ends], -1 for those that are no keys.

        `states` and `numbers` may give each word a state to set out from (-1: no key), as from `walk`.
        """
        out = np.full(len(starts), -1, np.int64)
        state = np.full(len(starts), self.root, np.int64) if states is None else states
        number = np.zeros(len(starts), np.int64) if numbers is None else numbers
        word = np.flatnonzero(state >= 0)
        at, end, state, number = starts[word], ends[word], state[word], number[word]
        while len(word):
            over = at == end
            if over.any():
                good = over & (self.final[state] == 1)
                out[word[good]] = number[good]
                on = np.flatnonzero(~over)
                word, at, end, state, number = word[on], at[on], end[on], state[on], number[on]
                if not len(word):
                    break
            on, i = self._find(state << 8 | data[at])
            if not on.all():
                on = np.flatnonzero(on)
                i, word, at, end, number = i[on], word[on], at[on], end[on], number[on]
            state, number, at = self.targets[i], number + self.before[i], at + 1
        return out
