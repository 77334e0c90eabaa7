"""Operator 5: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 of low quality, 2 good. A document's features are the hashed
distinct words (alphanumeric runs, A-Z lower-cased) and one bin each of a few
rates of its characters; one weight vector gives a score s, and ordered
thresholds t give P(grade <= k) = 1 / (1 + exp(s - t_k)). Fitted on at most
``MOST_LABELLED`` labelled documents (the first in a hash order), of which one
in five is held out to set the cut on P(grade >= 2). All documents are scored
whole; what is broadcast is the weight vector of 2^20 numbers.

Defined cases: null or empty text has no words and the bins of empty rates;
labels that are null, or for unknown documents, are ignored; repeated labels
count by their lowest grade; with labels of fewer than two grades every document
is kept at the grade seen (2 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import python_batches, table

MOST_LABELLED = 20_000
BITS, BINS, LEAST_DF, STEPS, DECAY = 20, 16, 16, 300, 10.0
RATES = 8
WIDTH = (1 << BITS) + RATES * BINS
_CLASS = np.zeros(256, np.int64)
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()"]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4


def features(column):
    """Yields (row, sorted feature indices) for every row of an Arrow string column."""
    for at, data, offsets in ts.slices(column):
        words, first = ts.scan(data, offsets, punct=True)
        starts, _, raw_first = ts.spans(data, offsets)
        index = (words >> np.uint64(64 - BITS)).astype(np.int64)
        kind = _CLASS[data]
        for i in range(len(offsets) - 1):
            lo, hi = offsets[i], offsets[i + 1]
            k = np.bincount(kind[lo:hi], minlength=5)
            n = max(int(raw_first[i + 1] - raw_first[i]), 1)
            body = max(int(hi - lo) - int(k[4]), 1)
            own = np.unique(index[first[i] : first[i + 1]])
            seen = words[first[i] : first[i + 1]]
            repeat = 1 - len(own) / max(len(seen), 1)
            again = (seen[1:] == seen[:-1]).mean() if len(seen) > 1 else 0.0
            rates = (k[1] / n, 3 * k[2] / body, 3 * k[3] / body, repeat, body / n / 24, np.log2(n + 1) / 20, again, 2 * k[1] / body)
            bins = [(1 << BITS) + j * BINS + min(BINS - 1, int(r * BINS)) for j, r in enumerate(rates)]
            yield at + i, np.concatenate([own, bins]).astype(np.int32)


def probabilities(score, cuts):
    """P(grade <= k) for each cut; scores beyond the exponent's range saturate."""
    return 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -60, 60)))


def fit(rows: list[tuple[int, np.ndarray]], grades: int = 3):
    """(weights of WIDTH, cuts, least P(grade >= 2) to keep) from (grade, features) rows."""
    y = np.array([g for g, _ in rows])
    if len(np.unique(y)) < 2:
        top = y[0] if len(y) else grades - 1
        return np.zeros(WIDTH, np.float32), np.where(np.arange(grades - 1) < top, -30.0, 30.0), 0.0
    held = np.arange(len(rows)) % 5 == 4
    df = np.zeros(WIDTH, np.int64)
    for (_, x), out in zip(rows, held, strict=True):
        if not out:
            df[x] += 1
    number = np.cumsum(df >= LEAST_DF) - 1
    kept = [number[x[df[x] >= LEAST_DF]] for _, x in rows]
    width = int(number[-1]) + 1

    def matrix(pick):
        some = [np.append(kept[i], width) for i in np.flatnonzero(pick)]  # a constant keeps every row filled
        return np.concatenate(some), np.concatenate([[0], np.cumsum([len(s) for s in some])[:-1]]), np.repeat(np.arange(len(some)), [len(s) for s in some])

    def scores(w, m):
        return np.add.reduceat(w[m[0]], m[1])

    # rates and the constant are few: they are held less than the words
    decay = np.append(np.where(np.flatnonzero(df >= LEAST_DF) < 1 << BITS, DECAY, DECAY / 100), 0) / max(int((~held).sum()), 1)
    train = matrix(~held)
    yt = y[~held]
    share = np.clip(np.array([(yt <= k).mean() for k in range(grades - 1)]), 1e-3, 1 - 1e-3)
    share = np.maximum.accumulate(share + 1e-6 * np.arange(grades - 1))
    logit = np.log(share / (1 - share))
    theta = np.concatenate([[logit[0]], np.log(np.maximum(np.diff(logit), 1e-2))])
    w = np.zeros(width + 1)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)]
    balance = len(yt) / (len(np.unique(yt)) * np.maximum(np.bincount(yt, minlength=grades), 1))[yt]
    for step in range(1, STEPS + 1):
        gaps = np.exp(theta[1:])
        cuts = theta[0] + np.concatenate([[0], np.cumsum(gaps)])
        s = scores(w, train)
        low = np.concatenate([np.zeros((len(s), 1)), probabilities(s, cuts), np.ones((len(s), 1))], axis=1)
        r = np.arange(len(s))
        a, b = low[r, yt], low[r, yt + 1]
        p = np.maximum(b - a, 1e-9)
        da, db = a * (1 - a), b * (1 - b)
        gs = balance * (db - da) / p / len(s)
        gc = np.zeros(grades - 1)
        for k in range(grades - 1):
            gc[k] = (-(balance * db / p)[yt == k].sum() + (balance * da / p)[yt == k + 1].sum()) / len(s)
        gw = np.bincount(train[0], gs[train[2]], minlength=width + 1) + decay * w
        tail = np.cumsum(gc[::-1])[::-1]
        gt = np.concatenate([[gc.sum()], gaps * tail[1:]])
        for x, g, m, v, rate in ((w, gw, *moments[:2], 0.05), (theta, gt, *moments[2:], 0.02)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    cuts = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])
    test = matrix(held) if held.any() else train
    yh = y[held] if held.any() else yt
    tail = 1 - probabilities(scores(w, test), cuts)[:, -1]
    good, bad = np.sort(tail[yh == grades - 1]), tail[yh < grades - 1]
    least = 0.5
    if len(good) and len(bad):
        marks = np.unique(np.quantile(tail, np.linspace(0, 1, 200)))
        least = float(max(marks, key=lambda t: 4 * (good >= t).mean() + (bad < t).mean()))
    weights = np.zeros(WIDTH, np.float32)
    weights[df >= LEAST_DF] = w[:-1]
    return weights, cuts - w[-1], least


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [x.tobytes() for _, x in features(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("s_order"), batch.column("s_id"), batch.column("grade"), pa.array(out, pa.binary())], names=["s_order", "s_id", "grade", "x"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts, least = shared.value
        for batch in batches:
            s = np.array([weights[x].sum(dtype=np.float64) for _, x in features(batch.column("text"))])
            low = probabilities(s, np.asarray(cuts)) if len(s) else np.zeros((0, len(cuts)))
            tail = 1 - low[:, -1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.round((1 - low).sum(axis=1), 6)), pa.array(np.round(tail, 6)), pa.array(tail >= least)],
                names=["doc_id", "expected_grade", "tail_probability", "kept"],
            )

    return run


def graded(labels: DataFrame) -> DataFrame:
    """(s_id, grade) from (doc_id, quality, toxic)."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("s_id"), grade.alias("grade")).where("s_id is not null and grade is not null").groupBy("s_id").agg(F.min("grade").alias("grade"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    python_batches(spark)
    sample = graded(labels).withColumn("s_order", F.xxhash64("s_id")).orderBy("s_order", "s_id").limit(MOST_LABELLED)
    # at most MOST_LABELLED rows of three numbers
    some = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("s_id")).select("s_order", "s_id", "grade", F.col("text").cast("string").alias("text"))
    got = some.mapInArrow(_feature_rows, "s_order long, s_id long, grade int, x binary").collect()
    got.sort(key=lambda r: (r["s_order"], r["s_id"], bytes(r["x"])))
    return fit([(r["grade"], np.frombuffer(bytes(r["x"]), np.int32)) for r in got])


def score(spark: SparkSession, docs: DataFrame, model) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) for every row of ``docs``."""
    python_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), "doc_id long, expected_grade double, tail_probability double, kept boolean")


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(spark, docs, train(spark, docs, table(spark, sf_dir, "labels")))
