"""Quality by ordinal regression with cumulative links.

Graded ratings 0..K-1 share one vector of hashed-text weights; ordered thresholds cut its value into grades:
P(grade <= k) = sigmoid(threshold_k - w . x). The model gives each text its expected grade and the probability
of reaching a chosen grade, by which documents are selected. With two grades it is a logistic regression.

Features are hashed tokens and hashed token shapes (case, digits, punctuation), as roots of counts on a unit sphere.
Training reads at most ``TRAIN_ROWS`` rated rows of each grade.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cellwatch.llm.labelled import held_out, labelled_sample

#: Hashed dimensions; the upper half holds shapes.
DIMENSIONS = 1 << 15
#: Rated rows of each grade that training reads.
TRAIN_ROWS = 3000
STEPS = 250
RATE = 0.3
RIDGE = 1e-4
CACHE = 300_000


def shape(token: str) -> str:
    """Letters as A (all capitals), Aa (capitalised) or a, digits as 9; other characters stay, each run once."""
    letters = lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a"
    told = re.sub(r"[^\W\d_]+", letters, re.sub(r"[0-9]+", "9", token))
    return re.sub(r"(\W)\1+", r"\1\1", told)


class _Slots(dict):
    """Slots of a token's own hash and of its shape's."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        half = DIMENSIONS // 2
        at = lambda s: xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) % half
        self[token] = slots = (at(token.lower()), half + at(shape(token)))
        return slots


_slots = _Slots()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; none for a text without tokens."""
    found = (text or "").split()
    if not found:
        return np.empty(0, np.int32), np.empty(0)
    pairs = np.array([_slots[t] for t in found], np.int64)
    slots, counts = np.unique(pairs, return_counts=True)
    values = np.sqrt(counts)
    values[slots < DIMENSIONS // 2] *= 0.5  # shapes repeat much more than tokens, and say more of form
    return slots.astype(np.int32), values / np.linalg.norm(values)


class Model(NamedTuple):
    grades: tuple[int, ...]
    thresholds: tuple[float, ...]
    weights: np.ndarray


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_grades: int, sample_weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and weights that maximise the likelihood of grades ``y`` in 0..n_grades-1, by Adam on all rows."""
    sample = np.ones(len(y)) if sample_weight is None else sample_weight
    sample = sample / sample.sum()
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    x = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    w = np.zeros(DIMENSIONS)
    share = np.clip(np.cumsum(np.bincount(y, sample, n_grades))[:-1], 1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    # the first threshold and the logs of the steps to the next ones are free, so the order holds
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    p = np.concatenate([free, w])
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = n_grades - 1
    for step in range(1, STEPS + 1):
        gaps = np.exp(p[1:k])
        th = p[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        w = p[k:]
        z = np.bincount(owner, x * w[at], len(y))
        below = _sigmoid(np.concatenate([th, [np.inf]])[y] - z)
        under = np.where(y > 0, _sigmoid(np.concatenate([[-np.inf], th])[y] - z), 0.0)
        prob = np.maximum(below - under, 1e-12)
        upper, lower = below * (1 - below), under * (1 - under)
        dz = sample * (upper - lower) / prob
        dth = np.bincount(np.minimum(y, k - 1), np.where(y < k, -sample * upper / prob, 0), k) + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, sample * lower / prob, 0), k)
        tail = np.cumsum(dth[::-1])[::-1]
        grad = np.concatenate([tail[:1], gaps * tail[1:], np.bincount(at, x * dz[owner], DIMENSIONS) + RIDGE * w])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (0.1 + 0.9 * (1 - step / STEPS))
    return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:k]))]), p[k:]


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [features(t) for t in frame["text"]]
        yield pd.DataFrame({"rating": frame["rating"], "slots": [r[0] for r in rows], "vals": [r[1] for r in rows]})


def train(rows: DataFrame, share: dict[int, int]) -> Model:
    """A model from a bounded sample ``rows(text, label)`` with integer ratings, weighted so that the grades have their
    ``share`` in all rated rows. With fewer than two grades every text gets the only one there is, or 0.
    """
    told = rows.where("text IS NOT NULL AND label IS NOT NULL").select("text", F.col("label").cast("int").alias("rating"))
    told = told.repartition(12).mapInPandas(_featured, "rating int, slots array<int>, vals array<double>").toPandas()
    read = Counter(told["rating"])
    grades = tuple(sorted(read))
    if len(grades) < 2:
        return Model(grades or (0,), (), np.zeros(DIMENSIONS))
    y = told["rating"].map({g: i for i, g in enumerate(grades)}).to_numpy()
    weight = told["rating"].map({g: share[g] / read[g] for g in read}).to_numpy(float)
    th, w = fit([(np.asarray(s), np.asarray(v)) for s, v in zip(told["slots"], told["vals"])], y, len(grades), weight)
    return Model(grades, tuple(float(t) for t in th), w)


def rate(docs: DataFrame, model: Model, at_least: int = 1) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability``, that of a grade of ``at_least``; columns of these names are replaced.

    Only the text counts, all of it. Null and empty texts are rated by the thresholds alone; repeated rows are rated alike; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights

    @F.pandas_udf("expected_grade double, tail_probability double")
    def rated(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        th, grades = np.array(m.thresholds), np.array(m.grades, float)
        for batch in texts:
            z = np.array([float(v @ m.weights[s]) for s, v in map(features, batch)])
            upto = np.column_stack([_sigmoid(th[None, :] - z[:, None]), np.ones(len(z))]) if len(th) else np.ones((len(z), 1))
            each = np.diff(upto, axis=1, prepend=0.0)
            yield pd.DataFrame({"expected_grade": each @ grades, "tail_probability": each[:, grades >= at_least].sum(axis=1)})

    rest = docs.select(*(c for c in docs.columns if c not in ("expected_grade", "tail_probability", "_rated")))
    return rest.withColumn("_rated", rated("text")).select(*rest.columns, "_rated.*")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, expected_grade, tail_probability, keep)`` of every row of ``docs(doc_id, text, ...)``, trained on
    ``labels(doc_id, quality, ...)``; keep: the top half of the scale is likelier than not.

    A null or empty text has no tokens and gets what the thresholds alone say. Repeated rows and null ids are rows like others, a text is read whole whatever
    its length, an empty table of documents gives no rows, and without rated rows every text gets grade 0. Other columns are ignored, also
    ones named like those of the result.
    """
    model = train(*labelled_sample(docs, labels, "quality", TRAIN_ROWS))
    rated = rate(docs.select("doc_id", "text"), model, at_least=max(1, (model.grades[-1] + 1) // 2))
    return rated.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("keep"))
