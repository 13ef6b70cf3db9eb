"""Quality classifier: gated attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is
encoded from the shares of its byte classes, its words' lengths and repeats and
a hashed profile of its byte pairs. A gated attention layer, learned from the
documents' labels alone, weighs the passages; the weighted sum of their
encodings gives the document's score.

The model is fitted in one task on a sample of at most ``2 x FIT_PER_CLASS``
labelled documents; rows count by their class's share of all labelled rows, so
scores keep the base rate. Everything else covers all rows.

Rows: a null or empty text is one empty passage and has a score; without a
labelled row every score is 0.5, with one class only the score is that class;
repeated rows and null ids come back as they are; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

PASSAGE_WORDS = 64
FIT_PER_CLASS = 2500
PAIR_BUCKETS = 256
HIDDEN = 32
ATTENTION = 16
EPOCHS = 30
BATCH = 256
RATE = 0.01
SEED = 7


def _byte_classes() -> np.ndarray:
    t = np.zeros(256, np.int64)  # 0: other control bytes
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t",
                               b"\n\r", b".,;:", b"'\"-()", b"!?", b"#$%&*@^~_+=", b"|<>{}[]\\/`"), 1):
        t[list(chars)] = k
    t[128:] = 11
    return t


CLASS = _byte_classes()
N_CLASSES = 12
PAIR = (common.mix(np.arange(65536, dtype=np.uint64)) % np.uint64(PAIR_BUCKETS)).astype(np.int64)
SPACED = np.zeros(256, np.uint8)
SPACED[33:] = np.arange(33, 256)
N_FEATURES = N_CLASSES + 5 + PAIR_BUCKETS


def features(buf: np.ndarray, off: np.ndarray, passage_words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(passage features, first passage of each row): every row has at least one passage."""
    n_rows = len(off) - 1
    start, end, row = common.words(buf, off, SPACED)
    first_word = np.searchsorted(row, np.arange(n_rows + 1))
    counts = np.diff(first_word)
    bags = np.concatenate([[0], np.cumsum(np.maximum(1, -(-counts // passage_words)))])
    inside = np.arange(len(row)) - first_word[row]
    word_passage = bags[row] + inside // passage_words
    n = int(bags[-1])
    begin = np.empty(n + 1, np.int64)
    begin[bags[:-1]] = off[:-1]
    lead = (inside % passage_words == 0) & (inside > 0)
    begin[word_passage[lead]] = start[lead]
    begin[n] = len(buf)
    sizes = np.diff(begin)
    owner = np.repeat(np.arange(n), sizes)
    total = np.maximum(sizes, 1)[:, None]
    share = np.bincount(owner * N_CLASSES + CLASS[buf], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / total
    if len(buf) > 1:
        pair = PAIR[buf[:-1].astype(np.int64) * 256 + buf[1:]]
        same = owner[:-1] == owner[1:]
        pairs = np.bincount((owner[:-1] * PAIR_BUCKETS + pair)[same], minlength=n * PAIR_BUCKETS)
    else:
        pairs = np.zeros(n * PAIR_BUCKETS)
    pairs = np.sqrt(pairs.reshape(n, PAIR_BUCKETS) / total)
    hashed = common.span_hash(common.prefix_hash(SPACED[buf]), start, end)
    seen = np.unique(common.mix(hashed ^ common.mix(word_passage.astype(np.uint64))), return_index=True)[1]
    words = np.bincount(word_passage, minlength=n)
    some = np.maximum(words, 1)
    length = end - start
    mean = np.bincount(word_passage, length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(word_passage, length.astype(float) ** 2, minlength=n) / some - mean**2, 0))
    distinct = np.bincount(word_passage[seen], minlength=n) / some
    more = np.stack([mean / 10, spread / 10, distinct, np.log1p(words) / 5, words == 0], axis=1)
    return np.concatenate([share, more, pairs], axis=1).astype(np.float32), bags


def features_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``features`` gives, made in pieces: it takes some 80 bytes of memory for a byte of text."""
    xs, bags = [], [np.zeros(1, np.int64)]
    for i, j in common.slices(off, common.SLICE_BYTES // 8):
        x, own = features(buf[off[i]: off[j]], off[i: j + 1] - off[i])
        xs.append(x)
        bags.append(own[1:] + bags[-1][-1])
    return (np.concatenate(xs), np.concatenate(bags)) if xs else features(buf, off)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, dict]:
    """Document probabilities, and what the gradient needs."""
    x = (x - m["mean"]) / m["scale"]
    h = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    sizes = np.diff(bags)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, bags[:-1]), sizes))
    a = e / np.repeat(np.add.reduceat(e, bags[:-1]), sizes)
    z = np.add.reduceat(a[:, None] * h, bags[:-1], axis=0)
    return _sigmoid(z @ m["c"] + m["d"]), {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "sizes": sizes}


def gradient(m: dict, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    p, k = forward(m, x, bags)
    dz = (p - y) * weight / weight.sum()
    out = {"c": k["z"].T @ dz, "d": dz.sum()}
    per = np.repeat(dz, k["sizes"])
    da = per * (k["h"] @ m["c"])
    de = k["a"] * (da - np.repeat(np.add.reduceat(k["a"] * da, bags[:-1]), k["sizes"]))
    out["w"] = (k["t"] * k["g"]).T @ de
    both = de[:, None] * m["w"]
    dt, dg = both * k["g"] * (1 - k["t"] ** 2), both * k["t"] * k["g"] * (1 - k["g"])
    out["V"], out["U"] = k["h"].T @ dt, k["h"].T @ dg
    dh = per[:, None] * k["a"][:, None] * m["c"] + dt @ m["V"].T + dg @ m["U"].T
    dh *= 1 - k["h"] ** 2
    out["W"], out["b"] = k["x"].T @ dh, dh.sum(axis=0)
    return out


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Adam on the weighted log loss of the documents."""
    r = np.random.default_rng(SEED)
    n = x.shape[1]
    m = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-2, "W": r.normal(0, n**-0.5, (n, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
         "w": r.normal(0, ATTENTION**-0.5, ATTENTION), "c": np.zeros(HIDDEN), "d": 0.0}
    names = ["W", "b", "V", "U", "w", "c", "d"]
    one, two, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = r.permutation(len(y))
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(order), BATCH):
            docs = np.sort(order[i: i + BATCH])
            sizes = np.diff(bags)[docs]
            rows = common.ranges(bags[docs], sizes)
            g = gradient(m, x[rows], np.concatenate([[0], np.cumsum(sizes)]), y[docs], weight[docs])
            step += 1
            for k in names:
                slope = g[k] + (1e-4 * m[k] if k in "WVUwc" else 0)
                one[k] = 0.9 * one[k] + 0.1 * slope
                two[k] = 0.999 * two[k] + 0.001 * slope**2
                m[k] = m[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return {k: np.asarray(v, np.float32) for k, v in m.items()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        per_class: int = FIT_PER_CLASS) -> dict | float:
    """The model, or a constant score where the labels have fewer than two classes."""
    common.start(docs.sparkSession)
    sample, totals = common.labelled_sample(docs, labels, label, per_class, id_col, text_col)
    if len(totals) < 2:
        return float(next(iter(totals), 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)).sort_by("id")  # at most 2 x per_class rows
        y = got.column("label").to_numpy().astype(np.float32)
        xs, bags = [], [np.zeros(1, np.int64)]
        buf, off = common.text_buffer(got.column("text"))
        for i, j in common.slices(off):
            x, own = features_of(buf[off[i]: off[j]], off[i: j + 1] - off[i])
            xs.append(x)
            bags.append(own[1:] + bags[-1][-1])
        have = [max(1, int((y == c).sum())) for c in (0, 1)]
        weight = np.where(y == 1, totals[1] / have[1], totals[0] / have[0])
        model = train(np.concatenate(xs), np.concatenate(bags), y, weight)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(sample.select("id", "text", "label").coalesce(1).mapInArrow(run, "model binary").first()[0])


def score(docs: DataFrame, model: dict | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    spark = docs.sparkSession
    common.start(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(model, float):
        return rows.select("id", F.lit(model).alias("score"))
    shared = spark.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            buf, off = common.text_buffer(b.column("text"))
            for i, j in common.slices(off):
                p, _ = forward(m, *features_of(buf[off[i]: off[j]], off[i: j + 1] - off[i]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), pa.array(p.astype(np.float64))], names=["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double")


def keep(docs: DataFrame, model: dict | float, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, all columns kept; no shuffle."""
    common.start(docs.sparkSession)
    if isinstance(model, float):
        return docs if model >= threshold else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            buf, off = common.text_buffer(b.column(place))
            for i, j in common.slices(off):
                p, _ = forward(m, *features_of(buf[off[i]: off[j]], off[i: j + 1] - off[i]))
                yield b.slice(i, j - i).filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
