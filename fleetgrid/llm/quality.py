"""Quality classification by ordinal cumulative-link regression.

Graded ratings 0, 1, ... share one weight vector over hashed text features; ordered thresholds t_k give
P(grade > k) = sigmoid(score - t_k). Features that tell the grade below the top one raise the last threshold of their
text, and the score counts up to CEILING above it, so that no number of other words outvotes them. Documents are
selected by such a tail probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Hashed features; labelled rows fitted on at most (picked by a hash of the id); rounds, step and weight decay of the fit;
#: least z-score of a feature that gets a weight; probability of the upper grades from which a document is kept.
BUCKETS, FIT_ROWS = 1 << 18, 16_000
ROUNDS, STEP, DECAY = 300, 0.3, 1e-3
SCREEN, KEEP = 6.0, 0.5
#: How far above the last threshold a score counts in a text with features of the grade below the top one.
CEILING = 3.0
#: Texts with a feature that are added to its spread, so that features of a few texts stand out less.
PRIOR = 10

_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_SHAPES = bytes(ord("0") if chr(b).isdigit() else ord("A") if 65 <= b <= 90 else ord("a") if b >= 0x80 or chr(b).isalpha() else b for b in range(256))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text: 1 for each distinct word, and shares of its words by their shape, of words
    that repeat the one before, and of words that stood earlier. Values of a bucket that is hit twice add up."""
    raw = text.encode()
    words = raw.translate(_WORD_BYTES).split()
    distinct = {*words}
    tokens = raw.translate(_SHAPES).split()
    n = max(1, len(tokens))
    shapes = Counter([t[:1] + t[-2:] for t in tokens])
    named = [(b"\0" + s, c / n) for s, c in shapes.items()]
    named += [(b"\1again", sum(map(eq, words, words[1:])) / max(1, len(words))), (b"\1seen", 1 - len(distinct) / max(1, len(words)))]
    named.append((b"\1none", float(not words)))
    buckets = np.fromiter(map(zlib.crc32, [*distinct, *(k for k, _ in named)]), dtype=np.int64) & (BUCKETS - 1)
    values = np.ones(len(buckets), dtype=np.float32)
    values[len(distinct) :] = [v for _, v in named]
    return buckets.astype(np.int32), values


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    brakes: np.ndarray = np.zeros(BUCKETS, dtype=np.float32)

    def tails(self, score: np.ndarray, brake: np.ndarray | None = None) -> np.ndarray:
        """P(grade > k) for each text and threshold k; its row sums are the expected grades. ``brake`` (0 or more) lowers the last."""
        out = 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -60, 60)))
        if brake is not None:
            held = np.minimum(score, self.thresholds[-1] + CEILING) - self.thresholds[-1] - brake
            out[:, -1] = np.where(brake > 0, 1 / (1 + np.exp(np.clip(-held, -60, 60))), out[:, -1])
        return out


def slopes(score: np.ndarray, cuts: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, and its derivatives by each score and each cut."""
    n, rows = len(score), np.arange(len(score))
    # P(grade <= k) at the cuts, with 0 and 1 at the ends
    below = np.c_[np.zeros(n), 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -60, 60))), np.ones(n)]
    low, high = below[rows, grades], below[rows, grades + 1]
    chance = np.maximum(high - low, 1e-9)
    slope_low, slope_high = low * (1 - low) / chance, high * (1 - high) / chance
    by_cut = np.array([slope_low[grades == k + 1].sum() - slope_high[grades == k].sum() for k in range(len(cuts))]) / n
    return float(-np.log(chance).mean()), (slope_high - slope_low) / n, by_cut


def fit_model(buckets: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray) -> Model:
    """Maximum likelihood with a small weight decay, over the features that differ between grades beyond chance."""
    top = int(grades.max(initial=0))
    if not len(grades) or not top:
        return Model(np.zeros(BUCKETS, dtype=np.float32), np.full(max(top, 1), -60.0))
    doc = np.repeat(np.arange(len(grades)), [len(b) for b in buckets])
    column, value = np.concatenate(buckets), np.concatenate(values).astype(np.float64)
    n, best = len(grades), np.zeros(BUCKETS)
    total, square = np.bincount(column, value, BUCKETS), np.bincount(column, value * value, BUCKETS)
    spread = np.maximum(square / n - (total / n) ** 2, 0) + PRIOR / n * np.minimum(square / np.maximum(total, 1e-12), 1) ** 2 + 1e-12
    for k in range(top):
        upper = grades > k
        a, b = upper.sum(), n - upper.sum()
        mine = np.bincount(column, value * upper[doc], BUCKETS)
        z = np.abs(mine / max(a, 1) - (total - mine) / max(b, 1)) / np.sqrt(spread * (1 / max(a, 1) + 1 / max(b, 1)))
        best = np.maximum(best, z)
    chosen = np.flatnonzero(best >= SCREEN)
    slot = np.full(BUCKETS, -1)
    slot[chosen] = np.arange(len(chosen))
    used = slot[column] >= 0
    doc, column, value = doc[used], slot[column[used]], value[used] / np.sqrt(spread[column[used]])
    w, cuts = np.zeros(len(chosen)), np.linspace(-1.0, 0.0, top)
    moments = [np.zeros(len(chosen) + top) for _ in range(2)]
    for step in range(1, ROUNDS + 1):
        score = np.bincount(doc, w[column] * value, n)
        _, by_score, grad_cuts = slopes(score, cuts, grades)
        grad_w = np.bincount(column, by_score[doc] * value, len(chosen)) + DECAY * w
        grad = np.r_[grad_w, grad_cuts]
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad * grad
        move = STEP / np.sqrt(step) * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(w)]
        cuts = np.maximum.accumulate(cuts - move[len(w) :])
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[chosen] = w / np.sqrt(spread[chosen])
    brakes = fit_brakes(np.bincount(doc, w[column] * value, n) - cuts[-1], buckets, values, grades) if top > 1 else np.zeros(BUCKETS, dtype=np.float32)
    return Model(weights, cuts, brakes)


def fit_brakes(above: np.ndarray, buckets: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Weights of 0 or more of the features that are more common in the grade below the top one than in the top one, beyond
    chance, given how far scores lie above the last threshold. Maximum likelihood of these two grades."""
    top, out = int(grades.max()), np.zeros(BUCKETS, dtype=np.float32)
    pick = np.flatnonzero(grades >= top - 1)
    good, above = grades[pick] == top, np.minimum(above[pick], CEILING)
    a, b = good.sum(), len(pick) - good.sum()
    if not a or not b:
        return out
    doc = np.repeat(np.arange(len(pick)), [len(buckets[i]) for i in pick])
    column, value = np.concatenate([buckets[i] for i in pick]), np.concatenate([values[i] for i in pick]).astype(np.float64)
    total, square, mine = np.bincount(column, value, BUCKETS), np.bincount(column, value * value, BUCKETS), np.bincount(column, value * good[doc], BUCKETS)
    spread = np.maximum(square / len(pick) - (total / len(pick)) ** 2, 0) + PRIOR / len(pick) * np.minimum(square / np.maximum(total, 1e-12), 1) ** 2 + 1e-12
    chosen = np.flatnonzero(((total - mine) / b - mine / a) / np.sqrt(spread * (1 / a + 1 / b)) >= SCREEN)
    slot = np.full(BUCKETS, -1)
    slot[chosen] = np.arange(len(chosen))
    used = slot[column] >= 0
    doc, column, value = doc[used], slot[column[used]], value[used]
    u, first, second = (np.zeros(len(chosen)) for _ in range(3))
    for step in range(1, ROUNDS + 1):
        chance = 1 / (1 + np.exp(np.clip(np.bincount(doc, u[column] * value, len(pick)) - above, -60, 60)))
        grad = np.bincount(column, (good - chance)[doc] * value, len(chosen)) / len(pick) + DECAY * u / 100
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        u = np.maximum(u - STEP / np.sqrt(step) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8), 0)
    out[chosen] = u
    return out


def learn(rated: DataFrame, text_col: str = "text", grade_col: str = "grade") -> Model:
    """A model of ``rated`` (a text and a whole grade from 0; rows with a null grade teach nothing; FIT_ROWS rows at most).

    The features are made where the texts are; one task fits, since the rows are bounded, and the weights come back.
    """

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), 4_000_000):
                both = [features(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x, _ in both], pa.binary()), pa.array([v.tobytes() for _, v in both], pa.binary())], names=["grade", "b", "v"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, buckets, values = [], [], []
        for batch in batches:
            grades += batch.column(0).to_pylist()
            buckets += [np.frombuffer(x, dtype=np.int32) for x in batch.column(1).to_pylist()]
            values += [np.frombuffer(x, dtype=np.float32) for x in batch.column(2).to_pylist()]
        order = sorted(range(len(grades)), key=lambda i: (grades[i], zlib.crc32(buckets[i]), len(buckets[i])))  # whatever the order of arrival
        model = fit_model([buckets[i] for i in order], [values[i] for i in order], np.array([grades[i] for i in order], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tobytes()], pa.binary()), pa.array([model.brakes.tobytes()], pa.binary())], names=["w", "t", "u"])

    rows = rated.filter(F.col(grade_col).isNotNull()).select(F.col(grade_col).cast("int").alias("grade"), text_or_empty(text_col).alias("_text"))
    made = rows.mapInArrow(featured, "grade int, b binary, v binary").repartition(1)
    w, t, u = made.mapInArrow(fitted, "w binary, t binary, u binary").first()
    return Model(np.frombuffer(w, dtype=np.float32), np.frombuffer(t, dtype=np.float64), np.frombuffer(u, dtype=np.float32))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tails`` (P(grade > k) for k = 0, 1, ...) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(model))  # two times BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tails in _tails(batch.column(1), Model(*shared.value)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names=["doc_id", "expected_grade", "tails"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")


def _tails(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray]]:
    """P(grade > k) of the texts, some rows at a time; null texts count as empty."""
    for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 4_000_000):
        made = map(features, (t or "" for t in texts.slice(a, b - a).to_pylist()))
        both = np.array([(float(model.weights[buckets] @ values), float(model.brakes[buckets] @ values)) for buckets, values in made]).reshape(-1, 2)
        yield a, b, model.tails(both[:, 0], both[:, 1])


def held_out(id_col: str = "doc_id") -> Column:
    """Labelled documents that the model is measured on and not fitted on: a fifth, by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grade() -> Column:
    """The rating of a labelled document: 0 poor, 1 well written but toxic, 2 well written and clean."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def rated(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``text, grade`` of FIT_ROWS labelled documents that aren't held out, under the name ``text_col``; a document with several labels
    gets the lowest, an id with several texts the least text that isn't null."""
    own = labels.filter(~held_out()).groupBy("doc_id").agg(F.min(grade()).alias("grade")).filter("grade is not null")
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    texts = docs.select("doc_id", F.col(text_col).alias("_text")).join(F.broadcast(own), "doc_id")
    return texts.groupBy("doc_id", "grade").agg(F.min("_text").alias(text_col)).select(text_col, "grade")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, expected_grade, p_above_0, p_above_1, selected`` of every document.

    Null and empty texts are rated by the features that they lack; repeated rows and null ids stay, one row each; other
    columns are ignored; without labels everything is selected. A document is selected if its chance of the top
    grade is KEEP or more.
    """
    found = score(docs, learn(rated(docs, labels)))
    low, top = F.element_at("tails", 1), F.element_at("tails", -1)
    return found.select("doc_id", held_out().alias("held_out"), "expected_grade", low.alias("p_above_0"), top.alias("p_above_1"), (top >= KEEP).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are selected, with their columns as they are; nothing is shuffled for it."""
    model = learn(rated(docs, labels, text_col), text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tails in _tails(batch.column(at), Model(*shared.value)):
                yield batch.slice(a, b - a).filter(pa.array(tails[:, -1] >= KEEP))

    return docs.mapInArrow(run, docs.schema)
