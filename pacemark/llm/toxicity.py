"""Toxicity by non-negative positive-unlabelled learning.

The classifiers learn from confirmed toxic texts (positive) and from unlabelled text, which holds toxic
texts too. With the class prior p the risk of a scorer g is ``p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])``:
the second part is the risk on clean text, written by what is known, and clipped since a true risk is
not negative. When a step's part falls below zero, it is walked back instead. The loss l is the sigmoid,
which is bounded: chance differences between the positive texts and those among the unlabelled ones then
stay small, while a logistic loss grows with g and holds sure scores back.

A feature is a word or its first 3, 4, 5 or 6 letters, weighed by ``log(1 + count)``; those that tell
positive from unlabelled texts best are chosen by counts over the sample. Scores are the mean of a few
linear models trained on seeded resamples and taken through the logistic function, between 0 and 1. Only the text enters a score.

The fit uses at most ``MAX_POSITIVE`` positive and ``MAX_UNLABELLED`` unlabelled texts, taken in the
order of a seeded hash of their ids; these bounds are parameters. Scoring reads every whole text.

Edge cases: a null text counts as empty and gets the models' score of a text without features. Without
any positive or unlabelled row for the fit every score is 0. A document that the labels hold more than
once counts as toxic if one row says so. Null ids are never used for the fit. Repeated rows are scored
each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pacemark.llm.base import store
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4_000, 12_000, 400
STEMS = (3, 4, 5, 6)
SEED = 17
THRESHOLD = 0.7
MIN_TEXTS = 5  # positive texts that a feature must occur in
LETTERS = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    """A word (ended by a blank) and its stems."""
    return [word + " ", *(word[:k] for k in STEMS if len(word) >= k)]


@dataclass
class Model:
    """Weights of the classifiers, one row each; the last weight is the constant."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def heads(self) -> frozenset[str]:
        """What the first three letters of a word must be for it to have a feature."""
        return frozenset(f.rstrip(" ")[:3] for f in self.features)

    def counts(self, text: str, heads: frozenset[str]) -> Counter[int]:
        words = [w for w in LETTERS.findall(text.lower()) if w[:3] in heads]
        known = self.features
        return Counter(known[t] for w in words for t in terms(w) if t in known)

    def score(self, counts: Counter[int]) -> float:
        if not len(self.weights):
            return 0.0
        z = self.weights[:, -1].copy()
        for f, n in sorted(counts.items()):
            z += self.weights[:, f] * np.log1p(n)
        return float(np.mean(_sigmoid(z)))


def held_out(doc_id: str | Column) -> Column:
    """Rows that the fit must not learn from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk(pos: np.ndarray, unl: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Risk of missing positives, risk of taking clean ones, and the gradient to step down.

    The second is that of the unlabelled less the positives' share, so it may fall below zero where the model
    learns the sample by heart. It then counts as zero, and the gradient leads back up.
    """
    sp, su = _sigmoid(pos @ w), _sigmoid(unl @ w)  # losses of calling a text clean
    clean = np.mean(su) - prior * np.mean(sp)
    of_positive = prior * (pos.T @ (sp * (1 - sp))) / len(pos)
    of_clean = unl.T @ (su * (1 - su)) / len(unl) - of_positive
    return prior * np.mean(1 - sp), clean, of_clean - of_positive if clean >= 0 else -of_clean


def nnpu(
    pos: np.ndarray, unl: np.ndarray, prior: float, seed: int, epochs: int = 40, rate: float = 0.02,
    ridge: float = 1e-5,
) -> np.ndarray:
    """Linear weights (constant last) by Adam on the non-negative risk; rows are feature vectors."""
    rng = np.random.default_rng(seed)
    pos = np.hstack([pos, np.ones((len(pos), 1))])[rng.integers(0, len(pos), len(pos))]
    unl = np.hstack([unl, np.ones((len(unl), 1))])[rng.integers(0, len(unl), len(unl))]
    w = np.zeros(pos.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, len(unl) // 500)
    for _ in range(epochs):
        for up, uu in zip(
            np.array_split(rng.permutation(len(pos)), steps), np.array_split(rng.permutation(len(unl)), steps)
        ):
            p, u = pos[up if len(up) else rng.integers(0, len(pos), 8)], unl[uu]
            g = risk(p, u, w, prior)[2]
            g[:-1] += ridge * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    max_features: int = MAX_FEATURES,
    members: int = 3,
    seed: int = SEED,
) -> Model:
    """Train on rows that are not held out; ``docs`` has doc_id and text, ``labels`` doc_id and toxic."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    rank = F.xxhash64(F.lit(seed), "doc_id")
    positive = known.where("toxic = 1").orderBy(rank, "doc_id").limit(max_positive).select("doc_id")
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id").distinct()
    unlabelled = ids.orderBy(rank, "doc_id").limit(max_unlabelled)
    chosen = (
        positive.select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
        .unionByName(unlabelled.select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u")))
        .groupBy("doc_id")
        .agg(F.max("p").alias("p"), F.max("u").alias("u"))
    )  # at most max_positive + max_unlabelled ids: small enough to send to every task
    sample = store(docs.select("doc_id", "text").join(F.broadcast(store(chosen)), "doc_id"))
    n_pos, n_unl = sample.agg(F.sum("p"), F.sum("u")).first()
    if not prior or not n_pos or not n_unl:
        return Model()
    prior = min(prior, 0.99)
    names = _features(sample, n_pos, n_unl, max_features)
    model = Model({f: i for i, f in enumerate(names)})
    pos, unl = _matrices(sample, model)
    weights = [nnpu(pos, unl, prior, seed + i) for i in range(members)]
    return Model(model.features, np.array(weights))


def _features(sample: DataFrame, n_pos: int, n_unl: int, most: int) -> list[str]:
    """Terms by how much more often they occur in positive than in unlabelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos: Counter[str] = Counter()
            unl: Counter[str] = Counter()
            for text, p, u in zip(*(c.to_pylist() for c in batch.columns)):
                own = {t for w in set(LETTERS.findall((text or "").lower())) for t in terms(w)}
                if p:
                    pos.update(own)
                if u:
                    unl.update(own)
            seen = list(pos.keys() | unl.keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seen, pa.string()),
                    pa.array([pos[t] for t in seen], pa.int64()),
                    pa.array([unl[t] for t in seen], pa.int64()),
                ],
                names=["term", "p", "u"],
            )

    counts = (
        sample.select("text", "p", "u")
        .mapInArrow(run, "term string, p bigint, u bigint")
        .groupBy("term")
        .agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    )
    share, base = F.col("p") / n_pos, (F.col("u") + 1) / n_unl
    gain = F.col("p") * F.log(share / base)
    top = (
        counts.where((F.col("p") >= MIN_TEXTS) & (share > 2 * base))
        .select("term", gain.alias("gain"))
        .orderBy(F.desc("gain"), "term")
        .limit(most)
    )
    return [r.term for r in top.collect()]


def _matrices(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors of the positive and of the unlabelled texts of the bounded sample."""
    heads = model.heads()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ps, us, fs, ns = [], [], [], [], []
            for doc, text, p, u in zip(*(c.to_pylist() for c in batch.columns)):
                own = model.counts(text or "", heads)
                ids.append(str(doc))
                ps.append(p)
                us.append(u)
                fs.append(list(own))
                ns.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()), pa.array(ps, pa.int32()), pa.array(us, pa.int32()),
                    pa.array(fs, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32())),
                ],
                names=["doc_id", "p", "u", "f", "n"],
            )

    kind = "doc_id string, p int, u int, f array<int>, n array<int>"
    rows = sample.select("doc_id", "text", "p", "u").mapInArrow(run, kind).collect()
    rows.sort(key=lambda r: (r.doc_id, r.f, r.n))
    out = []
    for side in ("p", "u"):
        own = [r for r in rows if r[side]]
        x = np.zeros((len(own), len(model.features)))
        for i, r in enumerate(own):
            x[i, r.f] = np.log1p(r.n)
        out.append(x)
    return out[0], out[1]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id) of every row, and ``score``; the text is read as a whole."""
    keep = ["doc_id"] if keep is None else keep
    heads = model.heads()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(model.counts(x.as_py() or "", heads)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(scores, pa.float64())], names=[*names, "score"]
            )

    narrow = docs.select(F.col("text").alias("_scored"), *keep)
    names = narrow.columns[1:]
    return narrow.mapInArrow(run, StructType([*narrow.schema.fields[1:], StructField("score", DoubleType())]))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under the threshold; columns of any name go through."""
    packed = docs.select(F.struct("*").alias("row"), "text")
    return score(packed, model, ["row"]).where(F.col("score") < threshold).select("row.*")
