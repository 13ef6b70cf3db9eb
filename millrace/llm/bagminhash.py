"""Near-duplicate documents by BagMinHash signatures, bands and exact overlap.

A document is the multiset of its ``SHINGLE``-word shingles (all its words, if
fewer). Each shingle has a Poisson process over time and weight: weights are
cut into the dyadic levels [0, 1), [1, 2), [2, 4), ..., a level's points come at
its width's rate in the order of time, and a shingle that occurs c times sees
the points below c. Every point falls into a random slot of the signature, and
a slot keeps its earliest point. Two documents agree in a slot with the
probability of their weighted Jaccard similarity, sum(min) / sum(max).

Equal texts are one class before signatures are compared. Bands of a signature
are buckets; candidate links are found as in ``linking`` and each is verified
on the shingle multisets themselves, against ``THRESHOLD``. Classes are the
connected documents, named by their smallest id. With 50 bands of 6 slots a
pair at the threshold shares no band with probability 3e-7, and has a signature
that hides it (``SLACK``) with less than that; both fall fast above it.
A slot keeps eight bits of its point, so unlike slots agree once in 256.

Rows: a null text is an empty one; texts without a word are alike only if equal;
repeated rows of an id are one document (one of its texts is compared); rows
without an id have a null class; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common, linking

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 50
ROWS = 6
SLOTS = BANDS * ROWS
PIECE_BYTES = 1 << 18  # of text taken at a time,
PIECE_ROWS = 128  # and rows, for signatures
SLACK = 5.2  # standard deviations allowed to the signature's estimate


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of every distinct shingle of every row."""
    start, end, row = common.words(buf, off, common.WORD_TABLE)
    wh = common.span_hash(common.prefix_hash(common.WORD_TABLE[buf]), start, end)
    first = np.searchsorted(row, np.arange(len(off)))
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = common.ranges(first[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    h = common.span_hash(common.prefix_hash(wh), at, at + np.minimum(n[owner], size))
    _, one, c = np.unique(common.mix(h ^ common.mix(owner.astype(np.uint64))), return_index=True, return_counts=True)
    return owner[one], h[one], c


def signatures(row: np.ndarray, h: np.ndarray, c: np.ndarray, n_rows: int, slots: int = SLOTS) -> np.ndarray:
    """(n_rows, slots) int8; rows without a shingle have zeros."""
    total = np.bincount(row, c, n_rows)
    limit = (np.log(slots) + 4) * slots / np.maximum(total, 1)
    sig = np.zeros(n_rows * slots, np.int8)
    full = np.zeros(n_rows * slots, bool)
    todo = total > 0
    while todo.any():
        mine = todo[row]
        # processes: one per shingle and dyadic weight level below its count
        levels = np.ceil(np.log2(c[mine])).astype(np.int64) + 1
        elem = np.repeat(np.flatnonzero(mine), levels)
        level = common.ranges(np.zeros(len(levels), np.int64), levels)
        low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        width = np.maximum(low, 1.0)
        seed = common.mix(h[elem] + (level.astype(np.uint64) + np.uint64(1)) * common.BASE)
        time = np.zeros(len(elem))
        made, block, found = 0, 4, []
        while len(elem):
            with np.errstate(over="ignore"):
                draw = common.mix(seed[:, None] + (np.arange(made + 1, made + block + 1).astype(np.uint64) * common.MIX_1)[None, :])
            gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
            t = time[:, None] + np.cumsum(gap, axis=1)
            r = row[elem]
            more = common.mix(draw ^ common.BASE)
            y = low[:, None] + width[:, None] * ((more >> np.uint64(32)).astype(np.float64) * 2.0**-32)
            ok = (t <= limit[r][:, None]) & (y < c[elem][:, None])
            i, _ = np.nonzero(ok)
            found.append((r[i] * slots + (more[ok] % np.uint64(slots)).astype(np.int64), t[ok], draw[ok]))
            on = t[:, -1] <= limit[r]
            elem, seed, time, low, width = elem[on], seed[on], t[on, -1], low[on], width[on]
            made, block = made + block, min(block * 4, 1024)
        place, t, draw = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(-t, kind="stable")  # the earliest point of a slot is written last
        sig[place[order]] = draw[order].astype(np.uint8).view(np.int8)
        full[place] = True
        todo &= ~full.reshape(n_rows, slots).all(axis=1)
        limit = np.where(todo, limit * 2, limit)
        full[np.repeat(todo, slots)] = False
    return sig.reshape(n_rows, slots)


def similarity(a: tuple, b: tuple, n_rows: int) -> np.ndarray:
    """Weighted Jaccard of row i of a and row i of b, from their shingles."""
    key_a, key_b = (common.mix(h ^ common.mix(r.astype(np.uint64))) for r, h, _ in (a, b))
    _, i, j = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    both = np.bincount(a[0][i], np.minimum(a[2][i], b[2][j]), n_rows)
    union = np.bincount(a[0], a[2], n_rows) + np.bincount(b[0], b[2], n_rows) - both
    return both / np.maximum(union, 1)


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of a bounded size: a row of any length makes some SLOTS * log(SLOTS) points."""
    for i, j in common.slices(off, PIECE_BYTES):
        yield from ((x, min(x + PIECE_ROWS, j)) for x in range(i, j, PIECE_ROWS))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = common.text_buffer(b.column("text"))
        for i, j in _pieces(off):
            part = b.slice(i, j - i)
            found = shingles(buf[off[i]: off[j]], off[i: j + 1] - off[i])
            sig = signatures(*found, j - i)
            some = np.bincount(found[0], minlength=j - i) > 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(some, SLOTS, 0))]), pa.int32()), pa.array(sig[some].ravel()))
            weight = np.bincount(found[0], found[2], j - i).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copy"), lists, pa.array(weight)],
                                             names=["id", "copy", "sig", "weight"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        sig = b.column("sig").flatten().to_numpy().reshape(len(ids), SLOTS).view(np.uint8).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.zeros((len(ids), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                key = common.mix(key * common.BASE + sig[:, r::ROWS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], names=["key", "id"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (buf_a, off_a), (buf_b, off_b) = (common.text_buffer(b.column(c)) for c in ("text_a", "text_b"))
        for i, j in common.slices(off_a + off_b, PIECE_BYTES):
            s = similarity(shingles(buf_a[off_a[i]: off_a[j]], off_a[i: j + 1] - off_a[i]),
                           shingles(buf_b[off_b[i]: off_b[j]], off_b[i: j + 1] - off_b[i]), j - i)
            yield pa.RecordBatch.from_arrays(
                [c.slice(i, j - i).filter(pa.array(s >= threshold)) for c in (b.column("a"), b.column("b"))], names=["a", "b"])


def _elements(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Every shingle occurrence of every text; links share one of the first ``most`` in any order."""
    for b in batches:
        buf, off = common.text_buffer(b.column("text"))
        for i, j in common.slices(off, PIECE_BYTES):
            row, h, c = shingles(buf[off[i]: off[j]], off[i: j + 1] - off[i])
            owner = np.repeat(row, c)
            with np.errstate(over="ignore"):
                el = common.mix(np.repeat(h, c) + common.ranges(np.zeros(len(c), np.int64), c).astype(np.uint64) * common.MIX_1)
            size = np.bincount(row, c, j - i).astype(np.int64)
            most = size - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1
            at = pa.array(owner + i)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("comp").take(at), pa.array(el.view(np.int64)),
                 pa.array(size[owner].astype(np.int32)), pa.array(most[owner].astype(np.int32))],
                names=["id", "comp", "el", "size", "most"])


def least_agreement(threshold: float) -> int:
    """Equal slots that two signatures of a link have, but for fewer cases than the bands miss."""
    return int(SLOTS * threshold - SLACK * (SLOTS * threshold * (1 - threshold)) ** 0.5)


def agreement(x: Column, y: Column) -> Column:
    """Number of equal slots of two signatures."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) of every row."""
    spark = docs.sparkSession
    shared = common.Shared(spark, "bagminhash")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    signed = shared.write(known.withColumn("copy", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
                          .mapInArrow(_sign, f"id {kind}, copy binary, sig array<tinyint>, weight bigint"))
    copies = shared.write(signed.groupBy("copy").agg(F.min("id").alias("first")))
    sigs = shared.write(signed.where(F.size("sig") > 0).join(copies, (F.col("id") == F.col("first")) & (signed["copy"] == copies["copy"]))
                        .select("id", F.struct("sig", "weight").alias("sig")).dropDuplicates(["id"]))
    members = sigs.select("id", "sig.sig").mapInArrow(_bands, f"key bigint, id {kind}")
    least = least_agreement(threshold)

    def possible(x: Column, y: Column) -> Column:
        """Sizes that allow the threshold, and enough equal slots."""
        sizes = F.least(x["weight"], y["weight"]) >= F.greatest(x["weight"], y["weight"]) * threshold
        return sizes & (agreement(x["sig"], y["sig"]) >= least)

    def likely(pairs: DataFrame) -> DataFrame:
        a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
        b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
        return pairs.join(a, "a").join(b, "b").where(possible(F.col("sig_a"), F.col("sig_b"))).select("a", "b")

    def enough(x: Column, y: Column) -> Column:
        """As many elements left as a link's overlap takes."""
        return F.least(x["rest"], y["rest"]) * (1 + threshold) >= (x["size"] + y["size"]) * threshold - 1e-6

    def elements(texts: DataFrame, ids: DataFrame) -> DataFrame:
        return texts.join(ids.hint("merge"), "id").mapInArrow(
            lambda batches: _elements(batches, threshold), f"id {kind}, comp {kind}, el bigint, size int, most int")

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(
            lambda batches: _verify(batches, threshold), f"a {kind}, b {kind}")

    def texts_of(ids: DataFrame) -> DataFrame:
        # ids grow with the data: joined by a shuffle at every size
        return shared.write(known.join(ids.hint("merge"), "id").dropDuplicates(["id"]))

    lab = linking.link(members, texts_of, verify, shared, elements, likely, enough)
    # a document with several texts joins its classes: components over (first of copies, id) too
    named = signed.join(copies, "copy").join(lab.select(F.col("id").alias("first"), "comp"), "first", "left").select(
        "id", F.coalesce("comp", "first").alias("comp"))
    least_id = named.groupBy("comp").agg(F.min("id").alias("class_id"))
    named = (named.groupBy("id").agg(F.min("comp").alias("comp"))
             .join(least_id, "comp").select(F.col("id").alias("known_id"), "class_id"))
    named = shared.write(named)
    return rows.select("id").join(named, F.col("id") == F.col("known_id"), "left").select("id", "class_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those whose class has a smaller id; all columns kept, rows without an id stay."""
    later = (classes(docs, id_col, text_col, threshold).where("id <> class_id")
             .select(F.col("id").alias("_later_copy")).distinct())
    return docs.join(later, docs[id_col] == later["_later_copy"], "left_anti")
