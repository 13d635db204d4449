"""Secret scans: fixed patterns, and formats learnt by grammar inference.

Three patterns give the base spans: an assignment to a name such as `password`, an access key, a long run of hex
digits. Their values are the labelled credentials (the label is the kind). From a bounded sample of different values
of each kind (`Settings.examples`, by hash) a prefix tree over character classes is built, and states are merged as
long as the Hoeffding bound finds their stop and transition shares compatible (ALERGIA); the result is a probabilistic
automaton per kind. One more, from a sample of ordinary runs of characters, is the background.

Every candidate, a run of `[A-Za-z0-9+/_.=-]` of 6 characters or more (the least that a kind has) with a digit and a
letter in it, is scored by the best kind's log-likelihood less the background's. It becomes a span of kind `format` if
that is, per character, what all but a twentieth of the kind's examples reach, and at least `Settings.margin`; and,
in all, at least `Settings.evidence`, so a short run needs a clearer form than a long one. A run that holds base spans
needs the margin and the evidence only, and if it fails, what the base spans leave of it are candidates. A likelihood depends on the
classes of a run's characters only, so it is worked out once for each sequence of classes.

Offsets count code points, ends are exclusive; spans of one kind never overlap. Null and empty texts have no
spans; without credentials nothing is learnt and the base spans stand alone. Rows are independent of each other
once the model is fitted, and the sample is of different values, so repeated rows change nothing.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import Memo, documents, with_columns_from_text
from riskloom.session import freeze

# Fixed patterns and least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # 20 characters or more
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")

_RUN = re.compile("[A-Za-z0-9+/_.=-]{6,}")
_LEAST = 6
_CLASSES = 10  # of characters: digits, three of letters, six marks
_NAMED = re.compile("passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)


@dataclasses.dataclass(frozen=True)
class Settings:
    examples: int = 400  # different values per kind, and ordinary runs
    longest: int = 256  # characters of an example; longer values are not learnt from
    alpha: float = 0.05  # of the Hoeffding bound
    margin: float = 0.5  # nats per character over the background
    evidence: float = 9.2  # nats over the background in all: odds of ten thousand to one


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind as listed."""
    out = []
    if ("=" in text or ":" in text) and _NAMED.search(text):
        out += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _touching(spans: list[tuple]) -> Callable[[int, int], bool]:
    """Tells whether a stretch overlaps any of `spans`, which stand by start."""
    starts, reach = [s[0] for s in spans], [0, *accumulate((s[1] for s in spans), max)]
    return lambda start, end: reach[bisect_left(starts, end)] > start


# Each character as the first one of its class.
SHAPE = {c: ord("0" if c < 58 else "A" if c < 91 else "a" if c < 103 else "g") for c in [*range(48, 58), *range(65, 91), *range(97, 123)]}


def _rest(start: int, end: int, taken: list[tuple]) -> list[tuple[int, int]]:
    """What the spans in `taken`, which stand by start, leave of a stretch: parts of _LEAST characters or more."""
    out, at = [], start
    for s, e, *_ in taken:
        if e > at and s < end:
            out.append((at, s))
            at = max(at, e)
    return [(s, e) for s, e in [*out, (at, end)] if e - s >= _LEAST]


def _class(c: str) -> tuple[str, int]:
    """Class of a character and number of characters in it."""
    if "0" <= c <= "9":
        return "0", 10
    if "a" <= c <= "f":
        return "a", 6
    if "g" <= c <= "z":
        return "g", 20
    if "A" <= c <= "Z":
        return "A", 26
    return c, 1


class Automaton:
    """Deterministic probabilistic automaton inferred from example strings."""

    def __init__(self, examples: list[str], alpha: float):
        self.out: list[dict[str, int]] = [{}]  # per state: class -> next state
        self.took: list[Counter] = [Counter()]  # per state: class -> examples
        self.ended = [0]
        self.came = [0]
        for text in examples:
            state = 0
            self.came[0] += 1
            for c in text:
                name = _class(c)[0]
                self.took[state][name] += 1
                if name not in self.out[state]:
                    self.out[state][name] = len(self.out)
                    self.out.append({})
                    self.took.append(Counter())
                    self.ended.append(0)
                    self.came.append(0)
                state = self.out[state][name]
                self.came[state] += 1
            self.ended[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self.came[p], self.came[q]
            if self._differ(self.ended[p], n, self.ended[q], m):
                return False
            for name in self.took[p].keys() | self.took[q].keys():
                if self._differ(self.took[p][name], n, self.took[q][name], m):
                    return False
                if name in self.out[p] and name in self.out[q]:
                    todo.append((self.out[p][name], self.out[q][name]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a; b is reached by nothing any more."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.came[p] += self.came[q]
            self.ended[p] += self.ended[q]
            self.took[p].update(self.took[q])
            for name, below in self.out[q].items():
                if name in self.out[p]:
                    todo.append((self.out[p][name], below))
                else:
                    self.out[p][name] = below

    def _merge(self) -> None:
        """Red states are settled; each state next to them is folded into the first compatible one or turns red."""
        red = [0]
        while True:
            settled = set(red)
            edge = next(((p, name, q) for p in red for name, q in sorted(self.out[p].items()) if q not in settled), None)
            if edge is None:
                break
            p, name, q = edge
            for r in red:
                if self._compatible(r, q):
                    self.out[p][name] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
        number = {state: i for i, state in enumerate(red)}
        self.out = [{name: number[q] for name, q in self.out[p].items()} for p in red]
        self.took, self.ended, self.came = ([part[p] for p in red] for part in (self.took, self.ended, self.came))

    def log_likelihood(self, text: str) -> float:
        """Of the string with its end: half an example is added to each class and to the end, so that the shares of all
        add up to one. A step that no example took starts again."""
        state, total = 0, 0.0
        for c in text:
            name, size = _class(c)
            total += math.log((self.took[state][name] + 0.5) / (self.came[state] + (_CLASSES + 1) / 2) / size)
            state = self.out[state].get(name, 0)
        return total + math.log((self.ended[state] + 0.5) / (self.came[state] + (_CLASSES + 1) / 2))


class Model:
    """Automata of the kinds and of the background, and the score from which each kind accepts."""

    def __init__(self, values: dict[str, list[str]], plain: list[str], settings: Settings):
        self.settings = settings
        self.kinds: dict[str, tuple[Automaton, float]] = {}
        self.plain = Automaton(sorted(plain), settings.alpha)
        for kind, texts in sorted(values.items()):
            automaton = Automaton(sorted(texts), settings.alpha)
            scores = sorted(self._score(automaton, t) / len(t) for t in texts)
            self.kinds[kind] = (automaton, max(settings.margin, scores[len(scores) // 20]))
        self.known = Memo(self._accepts, 200_000)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.known = Memo(self._accepts, 200_000)

    def _score(self, automaton: Automaton, value: str) -> float:
        return automaton.log_likelihood(value) - self.plain.log_likelihood(value)

    def _accepts(self, shape: str) -> tuple[bool, bool]:
        """Whether a run is a credential by itself, and whether it is one if it holds a base span."""
        if "0" not in shape or not ("a" in shape or "g" in shape or "A" in shape):
            return False, False
        scores = [(self._score(automaton, shape), least) for automaton, least in self.kinds.values()]
        clear = [(score, least) for score, least in scores if score >= self.settings.evidence]
        return tuple(any(score >= x * len(shape) for score, x in found) for found in (clear, [(s, self.settings.margin) for s, _ in clear]))

    def accepts(self, value: str) -> bool:
        return self.known[value.translate(SHAPE)][0]

    def formats(self, text: str, base: list[tuple]) -> list[tuple]:
        """Spans of kind `format`."""
        if not self.kinds:
            return []
        starts, reach = [s[0] for s in base], [0, *accumulate((s[1] for s in base), max)]
        out = []
        for run in _RUN.finditer(text):
            start, end = run.span()
            # Base spans from the first that may reach into the run to the last that begins in it.
            near = base[max(bisect_right(reach, start) - 1, 0) : bisect_left(starts, end)]
            near = [s for s in near if s[1] > start]
            if not near:
                if self.known[run[0].translate(SHAPE)][0]:
                    out.append((start, end, "format", run[0]))
            elif not any(s[0] <= start and s[1] >= end for s in near):  # else a base span says it all
                whole = self.known[run[0].translate(SHAPE)][1]
                parts = [(start, end)] if whole else [p for p in _rest(start, end, near) if self.accepts(text[slice(*p)])]
                out += [(s, e, "format", text[s:e]) for s, e in parts]
        return out

    def spans(self, text: str) -> tuple[list[tuple], list[tuple]]:
        """Base spans and all spans, (start, end, kind, value) each, by start and kind."""
        base = base_spans(text)
        return base, sorted(base + self.formats(text, base), key=lambda s: (s[0], KINDS.index(s[2])))


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Model from the credentials that the base patterns find in all of `docs` (a bounded sample of their values)."""

    def find():
        return lambda text: ([{"kind": k, "value": v} for _, _, k, v in base_spans(text)],)

    found = with_columns_from_text(docs.select("text"), find, "found array<struct<kind: string, value: string>>", [])
    different = freeze(found.select(F.explode("found").alias("f")).select("f.*").distinct(), "credentials")
    different = different.where(F.length("value") <= settings.longest)
    values: dict[str, list[str]] = {}
    for kind in KINDS[:3]:
        rows = different.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(settings.examples)
        texts = [r["value"] for r in rows.collect()]
        if texts:
            values[kind] = texts
    if not values:
        return Model({}, [], settings)

    def words():
        def work(text: str) -> tuple:
            touched = _touching(base_spans(text))
            runs = {m[0] for m in _RUN.finditer(text) if not touched(*m.span())}
            return (sorted(runs, key=lambda r: hashlib.md5(r.encode()).digest())[:20],)

        return work

    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.examples).distinct()
    few = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    plain = with_columns_from_text(few, words, "runs array<string>", []).select(F.explode("runs").alias("run")).distinct()
    plain = plain.where(F.length("run") <= settings.longest).orderBy(F.xxhash64("run"), "run").limit(settings.examples)
    return Model(values, [r[0] for r in plain.collect()], settings)


def scan(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`docs` with the number of base spans of each kind, a digest of these, and all spans as text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = shared.value

        def work(text: str) -> tuple:
            base, spans = found.spans(text)
            counts = Counter(s[2] for s in base)
            line = ",".join(f"{k}:{s}:{e}" for s, e, k, _ in base)
            every = ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)
            return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(line.encode()).hexdigest(), every

        return work

    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return with_columns_from_text(docs, make, fields, keep)


def redact(docs: DataFrame, model: Model, mark: str = "[secret]") -> DataFrame:
    """`docs` with every span in the text replaced by `mark` (overlapping spans by one); n_chars follows if present."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = shared.value

        def work(text: str) -> tuple:
            out, at = [], 0
            for start, end, _, _ in found.spans(text)[1]:
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return ("".join([*out, text[at:]]),)

        return work

    out = with_columns_from_text(docs, make, "__clean string")
    clean = F.when(F.col("text").isNotNull(), F.col("__clean"))
    changed = ~F.col("text").eqNullSafe(clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", clean).select(*docs.columns)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, fit(docs), ["doc_id"])
