"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Indicators are byte n-grams, words and word pairs of the whole text, hashed to ``DIMS`` cells. Each
cell is scaled by the log ratio of its smoothed counts in good and bad texts (counted over all
labelled rows), divided by the root of the number of cells of the text. A linear hinge-loss model
is fitted to these vectors by dual coordinate descent, mixed with its mean weight, and its margins
are mapped to probabilities by a logistic curve.

Counting and scoring run over all rows on the executors. Fitting the hinge loss and the curve uses
the ``fit_rows`` + ``curve_rows`` labelled rows with the smallest hash of their id: a fixed bound,
so that the driver holds some ten thousand bytes a row and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions.sizes import broadcast_if_small
from tallymart.llm import frames, text

BITS = 18
DIMS = 1 << BITS
FIT_ROWS = 2000
CURVE_ROWS = 2000
GRAMS = (1, 2, 3)

_U = np.uint64


def _cells(keys: np.ndarray, kind: int) -> np.ndarray:
    """Cell numbers of 64-bit keys of one kind of feature."""
    salt = _U((kind + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    spread = (keys + salt) * _U(0xD6E8FEB86659FD93)
    spread ^= spread >> _U(32)
    spread *= _U(0xD6E8FEB86659FD93)
    return (spread >> _U(64 - BITS)).astype(np.int64)


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted numbers of the cells its n-grams set."""
    seen = np.zeros(DIMS, dtype=bool)
    for first, last, data, at in text.slices(texts):
        wide = data.astype(_U)
        grams, key = [], np.zeros(len(data), dtype=_U)
        for n in GRAMS:
            key = (key[: len(data) - n + 1] << _U(8)) | wide[n - 1 :] if len(data) >= n else key[:0]
            grams.append((n, _cells(key, n)))
        w = text.words(data, at)
        hashes = w.hashes()
        single = _cells(hashes, 10)
        double = _cells(text.mix(hashes[:-1]) + hashes[1:], 11) if len(hashes) > 1 else single[:0]
        for row in range(last - first):
            a, b = at[row], at[row + 1]
            for n, cells in grams:
                seen[cells[a : max(a, b - n + 1)]] = True
            a, b = w.first[row], w.first[row + 1]
            seen[single[a:b]] = True
            seen[double[a : max(a, b - 1)]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


@dataclass
class Model:
    """Weights of the scaled indicators and the logistic curve of the margin."""

    weights: np.ndarray
    slope: float
    offset: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        return np.array([margin(self.weights, c) for c in indicators(texts)], dtype=float)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _curve(self.slope * self.margins(texts) + self.offset)


def margin(weights: np.ndarray, cells: np.ndarray) -> float:
    return float(weights[cells].sum() / np.sqrt(len(cells))) if len(cells) else 0.0


def _curve(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def log_count_ratio(good: np.ndarray, bad: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = good + smooth, bad + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(
    rows: list[np.ndarray],
    labels: np.ndarray,
    scale: np.ndarray,
    cost: float = 1.0,
    epochs: int = 40,
    tolerance: float = 1e-3,
    seed: int = 7,
) -> np.ndarray:
    """Weights of the hinge loss for rows of cells, whose values are ``scale`` by root length.

    Costs are weighted so that both classes count alike. Stops when the projected gradients of
    an epoch span less than ``tolerance``.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    share = {s: max(1, int((y == s).sum())) for s in (1.0, -1.0)}
    most = np.array([cost * len(y) / (2 * share[s]) for s in y])
    root = [np.sqrt(max(1, len(c))) for c in rows]
    square = np.array([float((scale[c] ** 2).sum()) / r**2 for c, r in zip(rows, root, strict=True)])
    alpha, weights = np.zeros(len(y)), np.zeros(len(scale))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        low, high = 0.0, 0.0
        for i in order.permutation(len(y)):
            if square[i] == 0:
                continue
            values = scale[rows[i]] / root[i]
            gradient = y[i] * float(weights[rows[i]] @ values) - 1.0
            projected = gradient
            if alpha[i] == 0:
                projected = min(gradient, 0.0)
            elif alpha[i] == most[i]:
                projected = max(gradient, 0.0)
            low, high = min(low, projected), max(high, projected)
            if projected:
                before = alpha[i]
                alpha[i] = min(max(before - gradient / square[i], 0.0), most[i])
                weights[rows[i]] += (alpha[i] - before) * y[i] * values
        if high - low < tolerance:
            break
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that fit labels to margins (Newton steps on Platt's smoothed targets)."""
    good, bad = int((labels > 0).sum()), int((labels <= 0).sum())
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = 0.0, float(np.log((good + 1) / (bad + 1)))
    for _ in range(rounds):
        p = _curve(slope * margins + offset)
        g = np.array([((p - target) * margins).sum() + 1e-3 * slope, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        length = min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        slope, offset = slope - length * step[0], offset - length * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
    curve_rows: int = CURVE_ROWS,
    mean_share: float = 0.25,
) -> Model:
    """Learn from the texts that ``labels`` marks 0 or 1.

    Repeated labels of an id count once; an id with both labels, a null id and any other label
    are left out. Without labelled texts all weights are zero and the score is 0.5; with one class
    alone it is that class's smoothed share.
    """
    spark = frames.ready(docs)
    marked = (
        labels.select(frames.col(labels, id_col).alias("id"), frames.col(labels, label_col).alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("id", F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("place"))
    )
    # The bounded part: the rows up to this hash. Ties of the hash are ties of the id.
    bound = marked.select("place").orderBy("place").limit(fit_rows + curve_rows)
    last = bound.agg(F.max("place")).first()[0]
    if last is None:
        return Model(np.zeros(DIMS), 0.0, 0.0)
    texts = docs.select(frames.col(docs, id_col).alias("id"), frames.col(docs, text_col).alias("text"))
    known = texts.join(broadcast_if_small(marked), "id").select("text", "label", "place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, DIMS), dtype=np.int64)
        for batch in batches:
            marks, places = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sample = []
            for label, place, cells in zip(marks, places, indicators(batch.column(0)), strict=True):
                found[label, cells] += 1
                if place <= last:
                    sample.append((int(place), int(label), cells.astype(np.int32)))
            if sample:
                yield _sent([s[0] for s in sample], [s[1] for s in sample], [s[2] for s in sample])
        cells = np.flatnonzero(found.any(axis=0))
        if len(cells):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), None)).cast(pa.int64()), pa.array(np.full(len(cells), None)).cast(pa.int32()),
                 pa.nulls(len(cells), pa.list_(pa.int32())), pa.array(cells.astype(np.int32)),
                 pa.array(found[1, cells]), pa.array(found[0, cells])],
                names=_COUNTED.names,
            )

    passed = frames.store(known.mapInArrow(count, _COUNTED), "indicators")
    totals = passed.where("cell is not null").groupBy("cell").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    ).toArrow()
    counts = np.zeros((2, DIMS))
    counts[1, totals["cell"].to_numpy()] = totals["good"].to_numpy()
    counts[0, totals["cell"].to_numpy()] = totals["bad"].to_numpy()

    bounded = (
        passed.where("place is not null")
        .select("place", "label", "cells")
        .orderBy("place", "label", "cells")
        .limit(fit_rows + curve_rows)
        .toArrow()
    )
    places, marks = bounded["place"].to_numpy(), bounded["label"].to_numpy()
    rows = [c.values.to_numpy() for chunk in bounded["cells"].chunks for c in chunk]  # views, no copies
    if not len(rows):
        return Model(np.zeros(DIMS), 0.0, 0.0)
    # Alternate rows fit the weights and the curve, so that both follow the same distribution.
    fit = text.mix(places.view(_U)) % _U(fit_rows + curve_rows) < _U(fit_rows)
    scale = log_count_ratio(counts[1], counts[0])
    weights = np.zeros(DIMS)
    if len(set(marks[fit])) == 2:
        weights = dual_coordinate_descent([r for r, f in zip(rows, fit, strict=True) if f], marks[fit], scale)
        used = np.abs(weights[weights != 0]).mean() if weights.any() else 0.0
        weights = ((1 - mean_share) * weights + mean_share * used) * scale
    other = ~fit if len(set(marks[~fit])) == 2 else np.ones(len(marks), dtype=bool)
    margins = np.array([margin(weights, r) for r, f in zip(rows, other, strict=True) if f])
    slope, offset = logistic_curve(margins, marks[other])
    return Model(weights, slope, offset)


_COUNTED = T.StructType([
    T.StructField("place", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("cells", T.ArrayType(T.IntegerType())),
    T.StructField("cell", T.IntegerType()),
    T.StructField("good", T.LongType()),
    T.StructField("bad", T.LongType()),
])


def _sent(places: list[int], labels: list[int], cells: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of the bounded part."""
    n = len(places)
    ends = np.concatenate(([0], np.cumsum([len(c) for c in cells]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells)))
    return pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int64()), pa.array(labels, pa.int32()), lists,
         pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
        names=_COUNTED.names,
    )


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of the good class as ``name``.

    A null text scores like an empty one: the curve's value at margin zero. The model has a fixed
    size, so it is broadcast.
    """
    spark = frames.ready(docs)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(sent.value.scores(batch))

    return docs.withColumn(name, score(frames.col(docs, text_col)))


def fold(id_column, folds: int):
    """The remainder of the CRC-32 of an id's text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % folds
