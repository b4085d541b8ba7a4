"""Cumulative-link ordinal regression over hashed text features.

One weight per feature is shared by all grades; ordered thresholds cut the score into grades:
``P(grade <= k) = sigmoid(threshold_k - weights . features)``.

Two families of features.  ``structure``: a text's lower-cased words, their shapes (runs of one
character class taken once), pairs of neighbouring shapes, and marks for a word that repeats the one
before it and for four words that stood in the text before; values are the square root of a feature's
share, so every text has unit length.  ``words``: its lower-cased words; values are the logarithm of
one more than the count, over the fourth root of the number of words, so that a few words still tell
in a long text.  Each feature is hashed to one of ``dimension`` places.

Fitting takes a sample of at most ``sample`` ratings, chosen by a hash of the id and so the same
however the table is partitioned; features are computed in tasks, and the sparse rows of the sample
(bounded by ``sample`` and by the features of a text, at most ``dimension``) meet in the driver.
Scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.llm import spans

DIMENSION = 1 << 16
SAMPLE = 6000
RIDGE = 1e-4
STEPS = 150

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[48:58] = ord("0")


def _shapes(found: spans.Texts, words: spans.Spans) -> np.ndarray:
    kinds = _CLASS[found.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[words.start] = True
    places = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    return spans.Hasher(kinds[keep]).of(places[words.start], places[words.end])


def _salted(values: np.ndarray, salt: int) -> np.ndarray:
    return spans.mix(values + np.uint64(salt * 0x51_7CC1_B727_2203 + 1))


def _structure(found: spans.Texts, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = spans.runs(found, spans.NOT_SPACE)
    same = spans.Hasher(spans.LOWER[found.data]).of(words.start, words.end)
    shape = _shapes(found, words)
    pair, pair_row = spans.grams(shape, words.row, 2)
    four, four_row = spans.grams(same, words.row, 4)
    inside = pair_row >= 0
    twice = inside & (same[1:] == same[:-1])
    key = spans.keyed(four, four_row)[four_row >= 0]
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    parts = [
        (words.row, _salted(same, 1)),
        (words.row, _salted(shape, 2)),
        (pair_row[inside], _salted(pair[inside], 3)),
        (words.row[1:][twice], np.full(int(twice.sum()), 4, np.uint64)),
        (four_row[four_row >= 0][again], np.full(int(again.sum()), 5, np.uint64)),
    ]
    row = np.concatenate([p[0] for p in parts])
    row, place, count = _counted(row, np.concatenate([p[1] for p in parts]), dimension)
    total = np.bincount(row, weights=count, minlength=found.rows)
    return row, place, np.sqrt(count / total[row])


def _words(found: spans.Texts, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lowered = spans.Texts(spans.LOWER[found.data], found.offsets)
    words = spans.runs(lowered, spans.ALPHANUMERIC)
    row, place, count = _counted(words.row, spans.Hasher(lowered.data).of(words.start, words.end), dimension)
    total = np.bincount(row, weights=count, minlength=found.rows)
    return row, place, np.log1p(count) / np.sqrt(np.sqrt(total[row]))


def _counted(row: np.ndarray, feature: np.ndarray, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = (feature % np.uint64(dimension)).astype(np.int64)
    cell, count = np.unique(row * dimension + place, return_counts=True)
    return cell // dimension, cell % dimension, count


FAMILIES = {"structure": _structure, "words": _words}


@dataclass(frozen=True)
class OrdinalModel:
    """``grades``: the grades met in training, in order; one threshold between neighbours."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray
    family: str = "structure"

    def above(self, found: spans.Texts) -> np.ndarray:
        """P(grade > grades[k]) for each text and threshold."""
        row, place, value = FAMILIES[self.family](found, len(self.weights))
        latent = np.bincount(row, weights=value * self.weights[place], minlength=found.rows)
        return _sigmoid(latent[:, None] - self.thresholds[None, :])

    def expected(self, above: np.ndarray) -> np.ndarray:
        return self.grades[0] + above @ np.diff(self.grades)

    def tail(self, above: np.ndarray, least: int) -> np.ndarray:
        """P(grade >= least)."""
        k = int(np.searchsorted(self.grades, least))
        if k == 0:
            return np.ones(len(above))
        return above[:, k - 1] if k < len(self.grades) else np.zeros(len(above))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(row, place, value, grade, dimension: int, ridge: float = RIDGE, steps: int = STEPS) -> OrdinalModel:
    """Penalised maximum likelihood by Adam over all rows at once; deterministic.

    Grades that no row has get no threshold.  With one grade the model always answers it.
    """
    grades, level = np.unique(grade, return_inverse=True)
    cuts, n = len(grades) - 1, len(grade)
    weights = np.zeros(dimension)
    if cuts < 1:
        return OrdinalModel(weights, np.zeros(0), grades if len(grades) else np.zeros(1, np.int64))
    share = np.cumsum(np.bincount(level))[:-1] / n
    logit = np.log(share / (1 - share))
    # thresholds as a first one and the logarithms of the gaps, so they stay ordered
    free = np.concatenate([logit[:1], np.log(np.maximum(np.diff(logit), 1e-2))])
    low, high = np.maximum(level - 1, 0), np.minimum(level, cuts - 1)
    state = [np.zeros(dimension), np.zeros(dimension), np.zeros(cuts), np.zeros(cuts)]
    for t in range(1, steps + 1):
        gaps = np.exp(free[1:])
        theta = np.concatenate([free[:1], free[0] + np.cumsum(gaps)])
        latent = np.bincount(row, weights=value * weights[place], minlength=n)
        upper = np.where(level < cuts, _sigmoid(theta[high] - latent), 1.0)
        lower = np.where(level > 0, _sigmoid(theta[low] - latent), 0.0)
        chance = np.maximum(upper - lower, 1e-9)
        d_up, d_low = upper * (1 - upper) / chance / n, lower * (1 - lower) / chance / n
        g_theta = np.bincount(low, weights=d_low, minlength=cuts) - np.bincount(high, weights=d_up, minlength=cuts)
        slope = d_up - d_low
        g_weights = np.bincount(place, weights=value * slope[row], minlength=dimension) + ridge * weights
        tails = np.cumsum(g_theta[::-1])[::-1]
        g_free = np.concatenate([tails[:1], gaps * tails[1:]])
        rate = 0.5 * (1 - t / (steps + 1))
        for x, g, a in ((weights, g_weights, 0), (free, g_free, 2)):
            m, v = state[a], state[a + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    gaps = np.exp(free[1:])
    return OrdinalModel(weights, np.concatenate([free[:1], free[0] + np.cumsum(gaps)]), grades)


def screened(row, place, value, grade, dimension: int, least: float) -> np.ndarray:
    """Places whose score statistic at weight 0 is at least ``least`` standard errors from 0."""
    rest = grade - np.mean(grade) if len(grade) else np.zeros(0)
    slope = np.bincount(place, weights=value * rest[row], minlength=dimension)
    error = np.sqrt(np.bincount(place, weights=value * value, minlength=dimension) * max(float(np.mean(rest**2)), 1e-12) if len(rest) else np.ones(dimension))
    return np.abs(slope) > least * np.maximum(error, 1e-9)


def train(
    docs: DataFrame,
    ratings: DataFrame,
    family: str = "structure",
    sample: int = SAMPLE,
    dimension: int = DIMENSION,
    ridge: float = RIDGE,
    screen: float = 0.0,
) -> OrdinalModel:
    """A model of ``ratings`` (doc_id, grade integer) of ``docs`` (doc_id, text).

    Ratings without a grade or a document are left out; a null text is empty.  With ``screen``, only
    features that pass ``screened`` get a weight.
    """
    ratings = ratings.where("grade is not null and doc_id is not null").select(
        "doc_id", F.col("grade").cast("long").alias("grade"), F.xxhash64("doc_id", F.lit(17)).alias("order")
    )
    # at most ``sample`` narrow rows, so the broadcast is bounded
    chosen = F.broadcast(ratings.orderBy("order", "doc_id", "grade").limit(sample))
    wanted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            row, place, value = FAMILIES[family](spans.texts(batch.column("text")), dimension)
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("grade"), cut(place, "<i4"), cut(value, "<f4")],
                ["order", "grade", "place", "value"],
            )

    found = wanted.mapInArrow(features, "order long, grade long, place binary, value binary").toArrow()
    found = found.sort_by([("order", "ascending"), ("grade", "ascending")])
    places = [np.frombuffer(x.as_py(), "<i4") for x in found.column("place")]
    values = [np.frombuffer(x.as_py(), "<f4") for x in found.column("value")]
    row = np.repeat(np.arange(len(places)), [len(x) for x in places])
    place = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
    value = np.concatenate(values).astype(np.float64) if values else np.zeros(0)
    grade = found.column("grade").to_numpy()
    if screen:
        passed = screened(row, place, value, grade, dimension, screen)[place]
        row, place, value = row[passed], place[passed], value[passed]
    return replace(fit(row, place, value, grade, dimension, ridge), family=family)


def score(docs: DataFrame, model: OrdinalModel, least: int, expected: str, tail: str) -> DataFrame:
    """``doc_id``, the expected grade and P(grade >= least) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in spans.slices(batches, "text"):
            above = fitted.above(spans.texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fitted.expected(above)), pa.array(fitted.tail(above, least))],
                ["doc_id", expected, tail],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        scored, f"doc_id {kind}, {expected} double, {tail} double"
    )


def filtered(docs: DataFrame, model: OrdinalModel, grade: int, least: float) -> DataFrame:
    """The rows whose P(grade >= ``grade``) reaches ``least``, whatever their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in spans.slices(batches, "text"):
            tail = fitted.tail(fitted.above(spans.texts(batch.column("text"))), grade)
            yield batch.filter(pa.array(tail >= least))

    return docs.mapInArrow(keep, docs.schema)
