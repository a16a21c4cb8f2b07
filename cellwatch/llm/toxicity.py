"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on toxic text, one on ordinary text. A window is a word
(a run of at most ``SPAN`` word characters) behind a fixed marker, and the dictionaries are made of such windows, so a
window known to a dictionary, or one that begins like a known one, compresses to little more than its marker. What a
window saves with the toxic dictionary against the ordinary one, in bytes, is its gain. A document's gains are
summed up in three figures, which a logistic curve fitted on labelled rows turns into a calibrated score.

The dictionaries are raw content that Spark's counts select, not zstandard's own training, which gave far worse results (README): they keep the words that mark their class,
those used more in it by a factor, counted by distinct neighbours, so that copies of a document don't count again. All such words are kept, whatever their
number. Training reads at most ``TRAIN_ROWS`` labelled rows of each class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from cellwatch.llm.labelled import held_out, labelled_sample

#: Labelled rows of each class that training reads.
TRAIN_ROWS = 4000
#: A word marks toxic text if it has so many distinct neighbourhoods there (fewer, in proportion, if there are less than `FULL_ROWS` toxic rows, but
#: `LEAST_CONTEXTS`), and so many times its share in ordinary text.
MIN_CONTEXTS, LEAST_CONTEXTS, FULL_ROWS = 8, 3, 640
FACTOR = 20.0
SPAN = 48
#: Behind no text: separates a dictionary's windows and leads every window.
MARK = bytes(range(1, 9))
#: Gains below this say nothing.
LEAST_GAIN = 3
CACHE = 400_000
_WORD = re.compile(rf"\w{{1,{SPAN}}}")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


class Gains:
    """What each window saves with the toxic dictionary, in bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        size = max(len(toxic), len(ordinary))  # equal sizes, so that distances cost the same in both
        options = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0,
            window_log=max(16, size.bit_length() + 1), hash_log=max(14, size.bit_length() - 2), chain_log=max(15, size.bit_length() - 1), search_log=8, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
        )

        def of(content: bytes):
            shared = zstandard.ZstdCompressionDict(content.rjust(size, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=options)
            return zstandard.ZstdCompressor(dict_data=shared, compression_params=options).compress

        self.by_toxic, self.by_ordinary = of(toxic), of(ordinary)
        self.cache: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        window = MARK + word.encode("utf-8", "surrogatepass")
        gain = len(self.by_ordinary(window)) - len(self.by_toxic(window))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = gain
        return gain

    def figures(self, text: str | None) -> tuple[float, float, float]:
        """The largest gain, the next, and the root of the sum of the telling ones against the text's length."""
        get, of = self.cache.get, self
        found = words(text)
        gains = [gain if (gain := get(w)) is not None else of(w) for w in found]
        told = sorted((gain for gain in gains if gain >= LEAST_GAIN), reverse=True)
        if not told:
            return 0.0, 0.0, 0.0
        return float(told[0]), float(told[1]) if len(told) > 1 else 0.0, float(np.sqrt(sum(told) / (1 + len(found) / 50)))


_gains: dict[int, Gains] = {}


def _shared(model: Model) -> Gains:
    """One cache for each worker process and model."""
    key = hash((model.toxic, model.ordinary))
    if key not in _gains:
        _gains.clear()
        _gains[key] = Gains(model.toxic, model.ordinary)
    return _gains[key]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found = words(text)
            near = {(w, xxhash.xxh3_64_intdigest(f"{a} {b}".encode("utf-8", "surrogatepass")) >> 1) for a, w, b in zip(["", *found], found, [*found[1:], ""])}
            yield pa.RecordBatch.from_pydict(
                {"word": [w for w, _ in near], "near": [c for _, c in near], "toxic": [toxic] * len(near)}, pa.schema([("word", pa.string()), ("near", pa.int64()), ("toxic", pa.int32())])
            )


def _content(found: list[str]) -> bytes:
    """A dictionary's windows, the most telling last, where they are found first."""
    return b"".join(MARK + word.encode("utf-8", "surrogatepass") for word in reversed(found)) + MARK


def train_dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """Toxic and ordinary dictionary from ``sample(text, toxic)``; the counts are made by Spark, and of the bounded sample's words those
    that tell a class reach the driver."""
    near = sample.mapInArrow(_contexts, "word string, near bigint, toxic int").distinct()
    least = max(LEAST_CONTEXTS, min(MIN_CONTEXTS, MIN_CONTEXTS * sample.where("toxic = 1").count() // FULL_ROWS))
    counts = near.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    counts = counts.where(f"t >= {least} OR o >= {MIN_CONTEXTS}").persist()
    try:
        total = counts.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
        t, o = total["t"] or 1, total["o"] or 1
        ratio = (F.col("t") / t) / ((F.col("o") + 0.5) / o)
        toxic = counts.where((F.col("t") >= least) & (ratio >= FACTOR)).orderBy(F.desc(F.col("t") * F.log(ratio)), "word").select("word")
        ordinary = counts.where((F.col("o") >= MIN_CONTEXTS) & (ratio < FACTOR)).orderBy(F.desc("o"), "word").select("word")
        return _content([r[0] for r in toxic.collect()]), _content([r[0] for r in ordinary.collect()])
    finally:
        counts.unpersist()


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Intercept and slopes of a logistic curve, by Newton's method; the ridge keeps it finite on separable rows."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-6] + [ridge] * (a.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (y - p)) - keep @ w
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + keep, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(rows: DataFrame, share: dict[int, int]) -> Model:
    """A model from a bounded sample ``rows(text, label)`` with labels 0 and 1, weighted so that the classes have their
    ``share`` in all labelled rows. Without rows of a class, every text scores the same.
    """
    sample = rows.where("text IS NOT NULL AND label IN (0, 1)").select("text", F.col("label").cast("int").alias("toxic")).repartition(12).persist()
    try:
        toxic, ordinary = train_dictionaries(sample)
        told = sample.mapInPandas(_told(Model(toxic, ordinary, ())), "toxic int, a double, b double, c double").toPandas()
    finally:
        sample.unpersist()
    if told["toxic"].nunique() < 2:
        return Model(toxic, ordinary, (0.0, 0.0, 0.0, 0.0))
    y = told["toxic"].to_numpy(float)
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, min(1.0, share[1] / share[0] * n[0] / n[1]), 1.0)
    return Model(toxic, ordinary, fit_curve(told[["a", "b", "c"]].to_numpy(), y, weight))


def _told(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains = _shared(model)
        for frame in frames:
            x = pd.DataFrame([gains.figures(t) for t in frame["text"]], columns=["a", "b", "c"], dtype=float)
            yield pd.concat([frame[["toxic"]].reset_index(drop=True), x], axis=1)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from 0.5 on); columns of these names are replaced.

    Only the text counts, all of it. Null and empty texts score as texts without telling words; repeated rows score alike; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a bounded sample's words

    @F.pandas_udf("double")
    def rated(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        gains, w = _shared(m), np.array(m.weights)
        for batch in texts:
            x = np.array([gains.figures(t) for t in batch]).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    rest = docs.select(*(c for c in docs.columns if c not in ("score", "predicted")))
    return rest.withColumn("score", rated("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most ``TRAIN_ROWS`` labelled rows of each class that are not held out."""
    return train(*labelled_sample(docs, labels.where("toxic IN (0, 1)"), "toxic", TRAIN_ROWS))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text, ...)``, trained on ``labels(doc_id, toxic, ...)``.

    Other columns are ignored, also ones named like those of the result; ``score`` tells what odd texts and rows get.
    """
    scored = score(docs.select("doc_id", "text"), train_on(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
