"""Toxicity categories by a classifier chain.

Categories are predicted one after the other by sparse logistic models over the
words, word beginnings and word endings that occur in a document (hashed);
model c also sees the probabilities of the categories before it. For training
these are out-of-fold predictions, so a later model learns from probabilities
like those it meets on new rows.

The labels have one toxicity column. The chain's earlier categories are kinds of
toxic documents found in the fitting rows: toxic rows are described by the words
that separate them from the others, and split where these words occur together
(two means, started from the main direction of the words). Every toxic row with
such a word is of one kind. For the out-of-fold probabilities words and kinds are
found anew without the fold, and numbered like those of all fitting rows.

The chain is fitted in one task on at most ``2 x FIT_PER_CLASS`` labelled
documents; rows count by their class's share of all labelled rows.

Rows: a null or empty text has the models' base rates; without labels of both
classes every probability is the only class (0 without labels); repeated rows and
null ids come back as they are; other columns are not read.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

FIT_PER_CLASS = 4000
BUCKETS = 1 << 18
AFFIXES = (4, 5, 6)
FOLDS = 5
KEPT = 500
MIN_DOCS = 4
STEPS = 150
RATE = 0.1
L2 = 0.3
THRESHOLD = 0.3
BEGINNING, ENDING = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333)

KINDS = 2
KIND_STEPS = 20
LABELLED = "toxic"
CHAIN = (*(f"kind_{k + 1}" for k in range(KINDS)), LABELLED)


def features(buf: np.ndarray, off: np.ndarray, affixes: tuple = AFFIXES) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct feature of every row; without ``affixes`` of its words only."""
    low = common.WORD_TABLE[buf]
    start, end, row = common.words(buf, off, common.WORD_TABLE)
    p = common.prefix_hash(low)
    parts = [(row, common.span_hash(p, start, end))]
    for n in affixes:
        long = end - start > n
        a, b, r = start[long], end[long], row[long]
        parts += [(r, common.span_hash(p, a, a + n) ^ BEGINNING), (r, common.span_hash(p, b - n, b) ^ ENDING)]
    rows = np.concatenate([r for r, _ in parts])
    bucket = (np.concatenate([h for _, h in parts]) % np.uint64(BUCKETS)).astype(np.int64)
    both = np.unique(rows * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def separation(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """By bucket: how much more frequent it is among the positive rows (standardised difference)."""
    pos, neg = w * y, w * (1 - y)
    a = np.bincount(bucket, pos[row], BUCKETS) / max(pos.sum(), 1e-9)
    b = np.bincount(bucket, neg[row], BUCKETS) / max(neg.sum(), 1e-9)
    mid = (a + b) / 2
    strength = (a - b) / np.sqrt(mid * (1 - mid) + 1e-3)
    strength[np.bincount(bucket, minlength=BUCKETS) < MIN_DOCS] = 0
    return strength


def kinds(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, weight: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Kind of every positive row in ``use`` that has a separating word, -1 for other rows."""
    out = np.full(len(y), -1)
    mine = use[row]
    row, bucket = row[mine], bucket[mine]
    strength = separation(row, bucket, y, weight * use)
    keep = np.argsort(-strength, kind="stable")[:KEPT]
    keep = keep[strength[keep] > 0]
    number = np.full(BUCKETS, -1)
    number[keep] = np.arange(len(keep))
    has = (number[bucket] >= 0) & (y[row] == 1)
    rows, at = np.unique(row[has], return_inverse=True)
    if len(rows) < KINDS:
        return out
    x = np.zeros((len(rows), len(keep)))
    x[at, number[bucket[has]]] = strength[bucket[has]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    around = x - x.mean(axis=0)
    main = np.linalg.eigh(around.T @ around)[1][:, -1]
    main = main * np.sign(main[np.argmax(np.abs(main))])
    place = np.argsort(np.argsort(around @ main, kind="stable"), kind="stable")
    kind = place * KINDS // len(rows)
    for _ in range(KIND_STEPS):
        centres = np.stack([x[kind == k].mean(axis=0) if (kind == k).any() else np.zeros(len(keep)) for k in range(KINDS)])
        new = np.argmax(x @ (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).T, axis=1)
        if (new == kind).all():
            break
        kind = new
    out[rows] = kind
    return out


def numbered_like(kind: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``kind`` renumbered to agree with ``other`` on as many rows as possible."""
    same = np.zeros((KINDS, KINDS))
    both = (kind >= 0) & (other >= 0)
    np.add.at(same, (kind[both], other[both]), 1)
    best = max(itertools.permutations(range(KINDS)), key=lambda p: sum(same[k, p[k]] for k in range(KINDS)))
    return np.where(kind >= 0, np.array(best)[kind], -1)


def fit_linear(row: np.ndarray, bucket: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray,
               use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights by bucket, weights of the earlier categories, bias) from the rows in ``use``.

    Features are those whose frequency differs most between the classes
    (standardised difference), at most ``KEPT``.
    """
    mine = use[row]
    row, bucket = row[mine], bucket[mine]
    w = weight * use
    strength = np.abs(separation(row, bucket, y, w))
    keep = np.argsort(-strength, kind="stable")[:KEPT]
    keep = keep[strength[keep] > 0]
    number = np.full(BUCKETS, -1)
    number[keep] = np.arange(len(keep))
    has = number[bucket] >= 0
    row, col = row[has], number[bucket[has]]
    coef, more, bias = np.zeros(len(keep)), np.zeros(dense.shape[1]), 0.0
    scale = w / w.sum()
    values, one, two = [coef, more, bias], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for step in range(1, STEPS + 1):  # Adam on the weighted log loss
        coef, more, bias = values
        p = _sigmoid(np.bincount(row, coef[col], len(y)) + dense @ more + bias)
        err = (p - y) * scale
        slopes = [np.bincount(col, err[row], len(keep)) + L2 / use.sum() * coef,
                  dense.T @ err + L2 / use.sum() * more, err.sum()]
        one = [0.9 * o + 0.1 * g for o, g in zip(one, slopes)]
        two = [0.99 * t + 0.01 * g**2 for t, g in zip(two, slopes)]
        rate = RATE * (1 - (step - 1) / STEPS)
        values = [v - rate * (o / (1 - 0.9**step)) / (np.sqrt(t / (1 - 0.99**step)) + 1e-12)
                  for v, o, t in zip(values, one, two)]
    coef, more, bias = values
    full = np.zeros(BUCKETS, np.float32)
    full[keep] = coef
    return full, more, float(bias)


def linear(model: tuple, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
    full, more, bias = model
    value = full[bucket]
    used = value != 0
    return _sigmoid(np.bincount(row[used], value[used], len(dense)) + dense @ more + bias)


def fit_chain(row: np.ndarray, bucket: np.ndarray, words: tuple[np.ndarray, np.ndarray], y: np.ndarray,
              weight: np.ndarray) -> list[tuple]:
    """One model per category; earlier categories enter as out-of-fold probabilities."""
    n = len(weight)
    fold = np.arange(n) % FOLDS
    everything = np.ones(n, bool)
    kind = kinds(*words, y, weight, everything)
    in_folds = [numbered_like(kinds(*words, y, weight, fold != f), kind) for f in range(FOLDS)]
    dense, models = np.zeros((n, 0)), []
    for c in range(len(CHAIN)):
        def target(of: np.ndarray) -> np.ndarray:
            return (of == c).astype(float) if c < KINDS else y
        out = np.zeros(n)
        for f in range(FOLDS):
            part = fit_linear(row, bucket, dense, target(in_folds[f]), weight, fold != f)
            out[fold == f] = linear(part, row, bucket, dense)[fold == f]
        models.append(fit_linear(row, bucket, dense, target(kind), weight, everything))
        dense = np.concatenate([dense, out[:, None]], axis=1)
    return models


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        per_class: int = FIT_PER_CLASS) -> list[tuple] | float:
    common.start(docs.sparkSession)
    sample, totals = common.labelled_sample(docs, labels, LABELLED, per_class, id_col, text_col)
    if len(totals) < 2:
        return float(next(iter(totals), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))  # at most 2 x per_class rows
        got = got.take(pa.array(np.argsort(common.mix(got.column("id").to_numpy().astype(np.uint64)), kind="stable")))
        y = got.column("label").to_numpy().astype(float)
        buf, off = common.text_buffer(got.column("text"))

        def of(affixes: tuple) -> tuple[np.ndarray, np.ndarray]:
            parts = [(r + i, c) for i, j in common.slices(off)
                     for r, c in [features(buf[off[i]: off[j]], off[i: j + 1] - off[i], affixes)]]
            return np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])

        have = [max(1, int((y == c).sum())) for c in (0, 1)]
        weight = np.where(y == 1, totals[1] / have[1], totals[0] / have[0])
        model = fit_chain(*of(AFFIXES), of(()), y, weight)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    ids = sample.withColumn("id", F.xxhash64(F.col("id").cast("string")))
    return pickle.loads(ids.select("id", "text", "label").coalesce(1).mapInArrow(run, "model binary").first()[0])


def score(docs: DataFrame, model: list[tuple] | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one probability per category) of every row."""
    spark = docs.sparkSession
    common.start(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(model, float):
        return rows.select("id", *(F.lit(model).alias(c) for c in CHAIN))
    shared = spark.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            buf, off = common.text_buffer(b.column("text"))
            for i, j in common.slices(off):
                row, bucket = features(buf[off[i]: off[j]], off[i: j + 1] - off[i])
                dense = np.zeros((j - i, 0))
                for m in models:
                    dense = np.concatenate([dense, linear(m, row, bucket, dense)[:, None]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), *(pa.array(dense[:, k]) for k in range(len(CHAIN)))],
                    names=["id", *CHAIN])

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in CHAIN))
