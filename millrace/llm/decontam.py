"""Benchmark decontamination by winnowing.

A text's words are its runs of ASCII letters (lower-cased), digits and
non-ASCII characters. In every window of ``n`` words the smallest hash of its
k-grams is the window's fingerprint, so two texts that share ``n`` consecutive
words share a fingerprint. Fingerprints of documents are joined with those of
the benchmark items; every hit is then extended, word by word, to the longest
common run, and a run of ``n`` words or more marks its words and its item. An
item of fewer words (m, but not none) is one window: it has fingerprints of its
own for length m.

Benchmark fingerprints up to ``BROADCAST_BYTES`` of item text (measured before)
go to every task; beyond that both sides are joined on the fingerprint with a
shuffle.

Rows: null and empty texts have no words and no hits; repeated rows come back
repeated; a document without an id is handled like any other on the broadcast
path and by its text on the shuffled one; an item without an id marks words but
is not listed; repeated item ids are one item; an empty benchmark marks nothing;
other columns are not read. ``remove`` decides for every row by its own text,
whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

WINDOW_WORDS = 10
GRAM = 5
BROADCAST_BYTES = 16 << 20

HITS = "n_words bigint, n_hit bigint, items array<string>"


class Text:
    """Word hashes of some rows: words of row r are hash[first[r]:first[r + 1]].

    Words are compared by hashes over a prime field, at the run's base.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, base: int):
        start, end, row = common.words(buf, offsets, common.WORD_TABLE)
        self.hash = common.field_hash(common.field_prefix(common.WORD_TABLE[buf], base), start, end, base)
        self.first = np.searchsorted(row, np.arange(len(offsets)))
        self.prefix = common.prefix_hash(self.hash)

    def fingerprints(self, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, int]:
        """(start, smallest gram hash) of every window of ``length`` words inside a row; grams in a window."""
        k = min(gram, length)
        w = length - k + 1
        n = len(self.hash)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), w
        i = np.arange(n - k + 1)
        grams = common.span_hash(self.prefix, i, i + k)
        least = common.sliding_min(grams, w)
        counts = np.maximum(np.diff(self.first) - length + 1, 0)
        start = common.ranges(self.first[:-1], counts)
        self.grams = grams
        return start, least[start], w

    def places(self, start: np.ndarray, w: int) -> np.ndarray:
        """Leftmost place of the smallest gram in each of the given windows."""
        return start + np.argmin(self.grams[start[:, None] + np.arange(w)], axis=1)


class Index:
    """Fingerprints of items: hash -> (item, place), for every length that windows have."""

    def __init__(self, ids: list[str | None], texts: pa.Array, base: int, n: int = WINDOW_WORDS):
        self.ids = ids
        t = Text(*common.text_buffer(texts), base)
        sizes = np.diff(t.first)
        self.words = [t.hash[t.first[i]: t.first[i + 1]] for i in range(len(ids))]
        self.lengths: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        for length in sorted({min(int(s), n) for s in sizes if s}):
            start, least, w = t.fingerprints(length)
            item = np.searchsorted(t.first, start, side="right") - 1
            own = sizes[item] >= n if length == n else sizes[item] == length
            start, least, item = start[own], least[own], item[own]
            place = t.places(start, w) - t.first[item] if len(start) else start
            post: dict[int, list[tuple[int, int]]] = {}
            for h, i, p in sorted(set(zip(least.tolist(), item.tolist(), place.tolist()))):
                post.setdefault(h, []).append((i, p))
            self.lengths[length] = (np.array(sorted(post), np.uint64), post)


def hits(t: Text, index: Index) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
    """row -> (hit word runs, items) for rows with a hit."""
    found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    for length, (keys, post) in index.lengths.items():
        start, least, w = t.fingerprints(length)
        if not len(start) or not len(keys):
            continue
        at = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == least)
        if not len(hit):
            continue
        place = t.places(start[hit], w)
        place, one = np.unique(place, return_index=True)
        rows = np.searchsorted(t.first, place, side="right") - 1
        done: dict[tuple[int, int], int] = {}
        for p, h, r in zip(place.tolist(), least[hit][one].tolist(), rows.tolist()):
            lo, hi = int(t.first[r]), int(t.first[r + 1])
            for item, q in post[h]:
                if done.get((item, p - q), -1) > p:
                    continue
                words = index.words[item]
                a = _back(t.hash[lo:p], words[:q])
                b = _forth(t.hash[p:hi], words[q:])
                done[(item, p - q)] = p + b
                if a + b >= length:
                    runs, items = found.setdefault(r, ([], set()))
                    runs.append((p - a - lo, p + b - lo))
                    items.add(item)
    return found


def _forth(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _back(x: np.ndarray, y: np.ndarray) -> int:
    return _forth(x[::-1], y[::-1])


def covered(runs: list[tuple[int, int]]) -> int:
    """Number of places in the union of the runs."""
    total, end = 0, 0
    for a, b in sorted(runs):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items) of every document row."""
    spark = docs.sparkSession
    common.start(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bench = _bench(items, item_id, item_text)
    shared = _broadcast(bench, broadcast_bytes)
    if shared is None:
        return _shuffled(rows, bench, n)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, base = shared.value
        index = Index(ids, pa.array(texts, pa.string()), base, n)
        for b in batches:
            buf, off = common.text_buffer(b.column("text"))
            for i, j in common.slices(off):
                t = Text(buf[off[i]: off[j]], off[i: j + 1] - off[i], base)
                found = hits(t, index)
                n_hit = [covered(found[r][0]) if r in found else 0 for r in range(j - i)]
                names = [sorted({ids[x] for x in found[r][1]} - {None}) if r in found else [] for r in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), pa.array(np.diff(t.first), pa.int64()),
                     pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string()))],
                    names=["id", "n_words", "n_hit", "items"])

    return rows.mapInArrow(run, f"id {kind}, {HITS}")


def _bench(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))


def _broadcast(bench: DataFrame, limit: int) -> Broadcast | None:
    """The items' ids and texts for every task and a base for hashes, unless they are larger than ``limit`` bytes."""
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    if size > limit:
        return None
    got = bench.toArrow()
    return bench.sparkSession.sparkContext.broadcast(
        (got.column("item").to_pylist(), got.column("text").to_pylist(), common.draw_base()))


def _text_key(text: str | Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _runs(rows: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """(doc_key, item_key, runs) of every text that shares a run with an item; no side is broadcast.

    Texts are keyed by their hash, so equal texts are examined once.
    """
    lengths = [x[0] for x in _word_counts(bench).select(F.least("n_words", F.lit(n)).alias("m"))
               .where("m > 0").distinct().collect()]  # at most n values
    base = common.draw_base()
    texts = rows.select("doc_key", "text").dropDuplicates(["doc_key"])
    item_texts = bench.select("item_key", "text").dropDuplicates(["item_key"])
    pairs = (_prints(texts, "doc_key", lengths, base).join(_prints(item_texts, "item_key", lengths, base), ["length", "print"])
             .select("doc_key", "item_key").distinct())

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, key, text, item in zip(*(b.column(c).to_pylist() for c in
                                              ("doc_key", "item_key", "text", "item_text"))):
                found = hits(Text(*common.text_buffer(pa.array([text], pa.string())), base),
                             Index([key], pa.array([item], pa.string()), base, n))
                if found:
                    out.append((doc, key, [{"a": a, "b": e} for a, e in found[0][0]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()),
                 pa.array([x[2] for x in out], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                names=["doc_key", "item_key", "runs"])

    return (pairs.join(texts, "doc_key").join(item_texts.withColumnRenamed("text", "item_text"), "item_key")
            .mapInArrow(extend, "doc_key string, item_key string, runs array<struct<a:bigint,b:bigint>>"))


def _shuffled(rows: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """The result of ``scan`` with the fingerprints joined by a shuffle."""
    bench = bench.withColumn("item_key", _text_key("text"))
    rows = rows.withColumn("doc_key", _text_key("text"))
    found = _runs(rows, bench, n)
    places = (found.select("doc_key", F.explode("runs").alias("r"))
              .select("doc_key", F.explode(F.sequence("r.a", F.col("r.b") - 1)).alias("place"))
              .distinct().groupBy("doc_key").agg(F.count("*").alias("n_hit")))
    names = (found.join(bench.select("item_key", "item").where("item is not null").distinct(), "item_key")
             .groupBy("doc_key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    counts = _word_counts(rows.select("id", "doc_key", "text"))
    return (counts.join(places, "doc_key", "left").join(names, "doc_key", "left")
            .select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def _word_counts(df: DataFrame) -> DataFrame:
    """The columns without the text, and the number of words."""
    keep = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = common.text_buffer(b.column("text"))
            _, _, row = common.words(buf, off, common.WORD_TABLE)
            count = np.bincount(row, minlength=len(off) - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(count, pa.int64())],
                                             names=[*keep, "n_words"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{kinds}, n_words bigint")


def _prints(df: DataFrame, key: str, lengths: list[int], base: int) -> DataFrame:
    """Distinct (key, length, print) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(key)
            buf, off = common.text_buffer(b.column("text"))
            for i, j in common.slices(off):
                t = Text(buf[off[i]: off[j]], off[i: j + 1] - off[i], base)
                for length in lengths:
                    start, least, _ = t.fingerprints(length)
                    row = np.searchsorted(t.first, start, side="right") - 1
                    new = np.ones(len(start), bool)
                    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(row[new] + i)), pa.array(np.full(new.sum(), length), pa.int32()),
                         pa.array(least[new].astype(np.int64), pa.int64())], names=[key, "length", "print"])

    return df.mapInArrow(run, f"{key} string, length int, print bigint").distinct()


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW_WORDS,
           item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows without a hit, all columns kept; each row by its own text, ids are not read."""
    common.start(docs.sparkSession)
    bench = _bench(items, item_id, item_text)
    shared = _broadcast(bench, broadcast_bytes)
    if shared is None:
        rows = docs.select(_text_key(text_col).alias("doc_key"), F.col(text_col).alias("text"))
        bad = (_runs(rows, bench.withColumn("item_key", _text_key("text")), n)
               .select(F.col("doc_key").alias("_contaminated_text")).distinct())
        return docs.join(bad, _text_key(docs[text_col]) == bad["_contaminated_text"], "left_anti")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, base = shared.value
        index = Index(ids, pa.array(texts, pa.string()), base, n)
        for b in batches:
            buf, off = common.text_buffer(b.column(place))
            for i, j in common.slices(off):
                clean = np.ones(j - i, bool)
                clean[list(hits(Text(buf[off[i]: off[j]], off[i: j + 1] - off[i], base), index))] = False
                yield b.slice(i, j - i).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
