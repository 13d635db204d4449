"""Toxicity scores from the nearest labelled examples.

`fit` learns in Spark: a bounded sample of labelled texts (`Settings.examples` per label, by hash of the id) gives
the candidate terms (with half the lift below) and the examples. Over all labelled training rows (copies, of the
same terms in the same order and of one label, count once) each candidate term is counted by label, over all
documents for its document frequency; a term is used if a lower confidence bound of its lift (how many times as often
toxic rows hold it) reaches `Settings.lift`. The bound nears the lift itself as rows grow, so neither do small tables need
more than their rows can show, nor will any common word do in large ones. Examples become TF-IDF vectors of unit length over these terms.

Scoring finds the `k` examples of highest cosine exactly. Example numbers are cut into blocks; the index holds, per
term and block, the postings and their largest weight. Blocks are visited in falling order of the bound that these
give for the query, until the bound is below the k-th cosine found. Ties go to the smaller example. Each neighbour
votes for its label with its cosine, times the number of training rows that it stands for (so the sample's balance
of labels does not matter), and a prior vote is added: score = (toxic votes + w p) / (all votes + w), p being the
toxic share among training rows without any used term. A text without used terms, an empty or a null one has no
neighbours and scores p. The evidence is the ids of the nearest examples and the terms that the text shares.

Only rows of `labels` that pass the training filter are learnt from; a repeated id counts once (toxic if any row
says so), null labels are left out. Ids, languages and sources are no inputs of a score. Without training rows of
both labels every score is 0. Hash collisions and layouts play no part, so repeated rows get equal scores.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import Memo, documents, table, with_columns_from_text
from riskloom.session import freeze

_TERM = re.compile(r"[^\W_]+")


@dataclasses.dataclass(frozen=True)
class Settings:
    examples: int = 1500  # labelled texts per label at most
    least: int = 2  # a candidate term is in so many of them
    lift: float = 4.0  # lower bound of how many times as often toxic rows hold a term
    deviations: float = 2.0  # standard deviations from the estimate down to that bound
    k: int = 15
    prior_weight: float = 1.0
    block: int = 64


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def held_out(doc_id) -> F.Column:
    """The fifth of the ids that labels are never learnt from (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


class Model:
    """Examples' TF-IDF vectors in a block-max inverted index. Bounded by `Settings.examples`; fit for broadcast."""

    def __init__(self, settings: Settings, idf: dict[str, float], rows: list, weight: tuple[float, float], prior: float):
        """rows: (id, toxic, {term: count}) of each example; weight: rows that an example of either label stands for."""
        self.settings, self.idf, self.prior = settings, idf, prior
        vectors = [(i, y, self._vector(counts)) for i, y, counts in sorted(rows, key=lambda r: (r[1], r[0]))]
        vectors = [v for v in vectors if v[2]]
        self.ids = [v[0] for v in vectors]
        self.toxic = np.array([v[1] for v in vectors], float)
        self.votes = np.where(self.toxic == 1, weight[1], weight[0]) if vectors else np.zeros(0)
        self.blocks = -(-len(vectors) // settings.block)
        self.postings: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        self.largest: dict[str, np.ndarray] = {}
        gathered: dict[str, dict[int, list]] = {}
        for n, (_, _, vector) in enumerate(vectors):
            for term, w in vector.items():
                gathered.setdefault(term, {}).setdefault(n // settings.block, []).append((n % settings.block, w))
        for term, blocks in gathered.items():
            self.postings[term] = {b: (np.array([p for p, _ in e]), np.array([w for _, w in e])) for b, e in blocks.items()}
            self.largest[term] = top = np.zeros(self.blocks)
            for b, e in blocks.items():
                top[b] = max(w for _, w in e)
        self.memo = None

    def _vector(self, counts: dict[str, int]) -> dict[str, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in sorted(counts.items()) if t in self.idf}
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / length for t, w in raw.items()} if length else {}

    def nearest(self, counts: dict[str, int]) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest examples that share a term, best first."""
        query = {t: w for t, w in self._vector(counts).items() if t in self.largest}
        if not query:
            return []
        bound = sum(w * self.largest[t] for t, w in query.items())
        k, found, worst = self.settings.k, [], -1.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(found) == k and bound[b] < worst - 1e-12):
                break
            score = np.zeros(self.settings.block)
            for t, w in query.items():
                if b in self.postings[t]:
                    places, weights = self.postings[t][b]
                    score[places] += w * weights
            found += [(float(round(score[p], 12)), int(b) * self.settings.block + int(p)) for p in np.flatnonzero(score > 0)]
            found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            worst = found[-1][0] if len(found) == k else -1.0
        return found

    def score(self, counts: dict[str, int]) -> tuple[float, list[int]]:
        near = self.nearest(counts)
        votes = [(c * self.votes[n], self.toxic[n]) for c, n in near]
        w = self.settings.prior_weight
        score = (sum(v * y for v, y in votes) + w * self.prior) / (sum(v for v, _ in votes) + w)
        return float(min(1.0, max(0.0, score))), [self.ids[n] for _, n in near]

    def score_text(self, text: str) -> tuple[float, list[int], list[str]]:
        if self.memo is None:
            self.memo = Memo(lambda key: self.score(dict(key)), 20_000)
        used = self.idf
        key = tuple(sorted(Counter(t for t in terms_of(text) if t in used).items()))
        return (*self.memo[key], [t for t, _ in key])

    def __getstate__(self):
        return {**self.__dict__, "memo": None}


def _examples(docs: DataFrame, train: DataFrame, settings: Settings) -> list:
    """(id, toxic, {term: count}, sign) of the sample: a bounded number of rows."""
    chosen = []
    for label in (0, 1):
        rows = train.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.examples)
        chosen += [(r["doc_id"], label) for r in rows.collect()]
    if len({label for _, label in chosen}) < 2:
        return []
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int"))

    def make():
        def work(text: str) -> tuple:
            terms = terms_of(text)
            return dict(Counter(terms)), _sign(terms)

        return work

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    counted = with_columns_from_text(texts, make, "counts map<string,int>, sign string", ["doc_id", "toxic"])
    counted = counted.withColumn("n", F.row_number().over(_first_of("doc_id", "counts"))).where("n = 1")
    return [(r["doc_id"], r["toxic"], r["counts"], r["sign"]) for r in counted.collect()]


def _first_of(key: str, counts: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(F.xxhash64(F.array_sort(F.map_keys(counts))))


def _least_lift(a: int, b: int, n1: int, n0: int, deviations: float) -> float:
    """Lower confidence bound of a term's lift: held by `a` of `n1` toxic and `b` of `n0` other rows, smoothed by half a row.

    It nears the lift itself as rows grow, so what it demands of a term does not rise with the table.
    """
    ratio = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    spread = math.sqrt(max(0.0, 1 / (a + 0.5) - 1 / (n1 + 1) + 1 / (b + 0.5) - 1 / (n0 + 1)))
    return math.exp(ratio - deviations * spread)


def _sign(terms: list[str]) -> str | None:
    """A 128-bit digest of all terms in their order: equal for copies only. None for a text without terms."""
    return xxhash.xxh3_128_hexdigest(" ".join(terms).encode("utf-8", "surrogatepass")) if terms else None


def _features(docs: DataFrame, number: dict[str, int], wanted: set[int], keep: list[str]) -> DataFrame:
    """The wanted terms that each text holds, and its sign."""
    shared = docs.sparkSession.sparkContext.broadcast({t: n for t, n in number.items() if n in wanted})

    def make():
        number = shared.value

        def work(text: str) -> tuple:
            terms = terms_of(text)
            return [number[t] for t in set(terms) & number.keys()], _sign(terms)

        return work

    return with_columns_from_text(docs, make, "terms array<int>, sign string", keep)


def _one_of_each(labelled: DataFrame) -> DataFrame:
    """One row of each label for copies, that is for rows of one sign.

    A text that is there a thousand times is one observation, or all its words would look typical of its label.
    """
    apart = F.when(F.col("sign").isNull(), F.col("doc_id")).alias("apart")
    return labelled.groupBy("toxic", "sign", apart).agg(F.min_by("terms", "doc_id").alias("terms"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from `labels` (doc_id, toxic), already cut to the rows that may be learnt from."""
    train = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    examples = _examples(docs, train, settings)
    if not examples:
        return Model(settings, {}, [], (1.0, 1.0), 0.0)
    frequency = Counter(t for _, _, counts, _ in examples for t in counts)
    vocabulary = sorted(t for t, n in frequency.items() if n >= settings.least)
    number = {t: i for i, t in enumerate(vocabulary)}
    # Copies among the examples count once as well; terms without half the lift there are not counted further.
    single = {(y, sign or f"id {i}"): c for i, y, c, sign in examples}
    seen = {label: Counter(t for (y, _), c in single.items() if y == label for t in c) for label in (0, 1)}
    rows = Counter(y for y, _ in single)
    wanted = {number[t] for t in vocabulary if seen[1][t] * rows[0] >= settings.lift / 2 * seen[0][t] * rows[1]}
    features = freeze(_features(docs.select("doc_id", "text"), number, wanted, ["doc_id"]), "terms")
    n_docs = features.count()
    counted = features.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    labelled = freeze(_one_of_each(features.join(train, "doc_id")), "labelled")
    rows = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    by_label = labelled.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.count("*").alias("both")
    )
    n1, n0 = rows.get(1, 0), rows.get(0, 0)
    used = set()
    for r in by_label.collect():
        a, b = r["a"], r["both"] - r["a"]
        if _least_lift(a, b, n1, n0, settings.deviations) >= settings.lift:
            used.add(r["term"])
    idf = {vocabulary[r["term"]]: math.log((1 + n_docs) / (1 + r["n"])) + 1 for r in counted if r["term"] in used}
    mask = F.arrays_overlap("terms", F.array(*[F.lit(t) for t in sorted(used)])) if used else F.lit(False)
    bare = labelled.where(~mask).agg(F.count("*"), F.sum("toxic")).first()
    prior = ((bare[1] or 0) + n1 / (n1 + n0)) / (bare[0] + 1)
    sampled = Counter(y for _, y, _, _ in examples)
    weight = (n0 / sampled[0] if sampled[0] else 1.0, n1 / sampled[1] if sampled[1] else 1.0)
    return Model(settings, idf, [e[:3] for e in examples], weight, prior)


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None, evidence: bool = True) -> DataFrame:
    """`docs` with score, predicted (1 from 0.5) and, as evidence, the nearest examples and the shared terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = shared.value

        def work(text: str) -> tuple:
            score, near, terms = found.score_text(text)
            return (score, int(score >= 0.5), near, terms)[: 4 if evidence else 2]

        return work

    fields = "score double, predicted int" + ", neighbours array<long>, terms array<string>" * evidence
    return with_columns_from_text(docs, make, fields, keep)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """`docs`, columns and values as they are, without the rows that the model predicts to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = shared.value
        return lambda text: (found.score_text(text)[0] >= 0.5,)

    return with_columns_from_text(docs, make, "__toxic boolean").where("not __toxic").select(*docs.columns)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id")).select("doc_id", "toxic"))
    scored = score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "neighbours", "terms")
