"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1/-1. A letter n-gram is the product
of its letters' vectors, the i-th one permuted (rotated) by its distance from
the end; a text's vector is the sum of its n-grams' vectors, and a language's
prototype the sum over its training texts. A text is given the language whose
prototype has the largest cosine with it, after the mean of the prototypes,
which holds what all languages share, has been taken from both.

Letters are Unicode letters, lower-cased; a-z and the rest of the Latin,
Greek and Cyrillic small letters (U+00DF..U+04FF) have classes of their own as
far as ``CLASSES`` reaches, others share classes by code point. Runs of other
characters count as one boundary sign.

Only n-gram counts per language leave the training tasks: at most
``languages x CLASSES**3`` sums, whatever the input.

Rows: a null text or one without a letter gets ``und`` with score 0; ties go to
the first language in order; no training text: all get ``und``; repeated rows
and null ids come back as they are; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

CLASSES = 64
GRAM = 3
DIMENSIONS = 1024
SEED = 20_240_501
MAX_LANGUAGES = 4096
UNDETERMINED = "und"

_CACHE: dict[str, np.ndarray] = {}


def letter_classes() -> np.ndarray:
    """Class of each code point; 0 for what is not a letter."""
    if "letters" not in _CACHE:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha() and unicodedata.category(ch)[0] == "L":
                low = ord(ch.lower()[0])
                t[c] = low - 96 if 97 <= low <= 122 else 27 + (low - 0xDF) % (CLASSES - 27)
        _CACHE["letters"] = t
    return _CACHE["letters"]


def gram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Vectors of n-gram codes: product of permuted letter vectors."""
    key = f"letters{dimensions}"
    if key not in _CACHE:
        base = np.random.default_rng(SEED).integers(0, 2, (CLASSES, dimensions), dtype=np.int8) * 2 - 1
        _CACHE[key] = np.stack([np.roll(base, GRAM - 1 - i, axis=1) for i in range(GRAM)])
    v = _CACHE[key]
    out = v[GRAM - 1][codes % CLASSES].copy()
    for i in range(1, GRAM):
        out *= v[GRAM - 1 - i][codes // CLASSES**i % CLASSES]
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram code) of every n-gram, and the number of letters of each row."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    points = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = letter_classes()[points].astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(row[kinds > 0], minlength=len(texts))
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] > 0) | (kinds[:-1] > 0)
    kinds, row = kinds[keep], row[keep]
    if len(kinds) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    n = len(kinds) - GRAM + 1
    code = np.zeros(n, np.int64)
    for i in range(GRAM):
        code = code * CLASSES + kinds[i: i + n]
    same = row[:n] == row[GRAM - 1:]
    return row[:n][same], code[same], letters


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    off = common.text_buffer(batch.column("text"))[1]
    values = batch.column("text")
    for i, j in common.slices(off, common.SLICE_BYTES // 2):
        yield i, [x or "" for x in values.slice(i, j - i).to_pylist()]


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang",
        dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from rows with a language."""
    common.start(train.sparkSession)
    rows = train.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for at, texts in _texts(b):
                names = sorted(set(langs[at: at + len(texts)]))
                number = {x: i for i, x in enumerate(names)}
                own = np.array([number[x] for x in langs[at: at + len(texts)]])
                row, code, _ = grams(texts)
                sums = np.bincount(own[row] * CLASSES**GRAM + code, minlength=0)
                at_code = np.flatnonzero(sums)
                for i, x in enumerate(names):
                    mine = at_code[at_code // CLASSES**GRAM == i]
                    if x not in total:
                        if len(total) > MAX_LANGUAGES:
                            raise ValueError(f"more than {MAX_LANGUAGES} languages")
                        total[x] = np.zeros(CLASSES**GRAM, np.int64)
                    total[x][mine % CLASSES**GRAM] += sums[mine]
        for x, t in total.items():
            code = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(code), pa.string()), pa.array(code), pa.array(t[code])], names=["lang", "code", "n"])

    def bundle(table: pa.Table) -> pa.Table:
        out = np.zeros(dimensions, np.int64)
        codes, n = (table.column(c).to_numpy() for c in ("code", "n"))
        for i in range(0, len(codes), 4096):
            out += n[i: i + 4096] @ gram_vectors(codes[i: i + 4096], dimensions)
        return pa.table({"lang": table.column("lang").slice(0, 1), "vector": pa.array([out.tolist()], pa.list_(pa.int64()))})

    sums = rows.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").applyInArrow(bundle, "lang string, vector array<bigint>").limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    got.sort(key=lambda r: r["lang"])
    return [r["lang"] for r in got], np.array([r["vector"] for r in got], np.float64).reshape(len(got), dimensions)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is (1 + cosine) / 2."""
    spark = docs.sparkSession
    common.start(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    mean = unit.mean(axis=0) if len(unit) > 1 else np.zeros(prototypes.shape[1])
    centred = unit - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    model = spark.sparkContext.broadcast((languages, centred.astype(np.float32), mean.astype(np.float32)))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, protos, shared = model.value
        d = protos.shape[1]
        for b in batches:
            for at, texts in _texts(b):
                row, code, letters = grams(texts)
                present, code = np.unique(code, return_inverse=True)
                vectors = np.zeros((len(texts), d), np.float32)
                for i in range(0, len(present), 4096):
                    mine = (code >= i) & (code < i + 4096)
                    width = min(4096, len(present) - i)
                    for r in range(0, len(texts), 512):
                        part = mine & (row >= r) & (row < r + 512)
                        count = np.bincount((row[part] - r) * width + code[part] - i,
                                            minlength=min(512, len(texts) - r) * width)
                        vectors[r: r + 512] += (count.reshape(-1, width).astype(np.float32)
                                                @ gram_vectors(present[i: i + width], d).astype(np.float32))
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.maximum(size, 1e-12) - shared
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                known = (letters > 0) & (len(names) > 0)
                cosine = vectors @ protos.T if names else np.zeros((len(texts), 1), np.float32)
                best = cosine.argmax(axis=1)
                score = np.clip((1 + cosine[np.arange(len(texts)), best].astype(np.float64)) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(at, len(texts)),
                     pa.array([names[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known)], pa.string()),
                     pa.array(np.where(known, score, 0.0))], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, is_train: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Fit on the training rows, predict every row."""
    return predict(docs, *fit(docs.where(is_train), text_col, lang_col), id_col=id_col, text_col=text_col)
