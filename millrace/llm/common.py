"""Helpers shared by the operators: text buffers, hashing, shared tables.

Texts are handled as one byte buffer per Arrow batch plus row offsets, so byte
and word work is vectorised; batches are cut into slices of about a megabyte
to bound the memory of a task (one row is never cut).
"""

from __future__ import annotations

import secrets
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import checkpoint_dir, ship_package

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
ARROW_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Multipliers of a 64-bit polynomial hash and of its mixer
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixer of unsigned 64-bit values (wraps silently)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_1
        x = (x ^ (x >> np.uint64(27))) * MIX_2
        return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    key = int(base)
    have = _POWERS.get(key)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(p)
        if size <= 1 << 22:
            _POWERS[key] = have
    return have[: n + 1]


def prefix_hash(values: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """h with h[j] - h[i] * base**(j-i) the hash of values[i:j] (see span_hash).

    Stored as S[i] = sum(values[t] * base**-t); the inverse of an odd base
    exists modulo 2**64, so every span hash is one subtraction and one product.
    """
    inv = np.uint64(pow(int(base), -1, 1 << 64))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values), inv)[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of each span, the same for equal contents wherever they stand."""
    p = powers(len(prefix) - 1, base)
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * p[start] + (end - start).astype(np.uint64) * MIX_2)


# Where equal hashes must mean equal contents, hashes are polynomials over a prime field at a base drawn
# for the run: contents that collide cannot be written beforehand, unlike modulo 2**64, where every odd
# base maps some texts of two letters to one value.
PRIME = (1 << 61) - 1
_P, _30, _31 = np.uint64(PRIME), np.uint64(30), np.uint64(31)
_LOW_30, _LOW_31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
BLOCK = 1 << 22  # values added up before sums are reduced
_FIELD_POWERS: dict[int, np.ndarray] = {}


def draw_base() -> int:
    """A base for ``field_prefix``, unforeseeable; every task of a run needs the same."""
    return 2 + secrets.randbelow(PRIME - 3)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.minimum(x, x - _P)  # x - PRIME wraps to a larger value if x is below


def field_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it."""
    ah, al, bh, bl = a >> _31, a & _LOW_31, b >> _31, b & _LOW_31
    mid = ah * bl + al * bh
    return _reduce(np.uint64(2) * ah * bh + (mid >> _30) + ((mid & _LOW_30) << _31) + al * bl)


def field_powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**n modulo PRIME, by doubling."""
    have = _FIELD_POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0], done = 1, 1
        while done < size:
            more = min(done, size - done)
            have[done: done + more] = field_product(have[:more], np.uint64(pow(base, done, PRIME)))
            done += more
        if size <= BLOCK:
            while len(_FIELD_POWERS) >= 4:  # workers outlive runs, each of which has two bases
                _FIELD_POWERS.pop(next(iter(_FIELD_POWERS)))
            _FIELD_POWERS[base] = have
    return have[: n + 1]


def field_prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of (value + 1) * base**-place modulo PRIME, for bytes (see ``field_hash``)."""
    inverse = field_powers(len(values), pow(base, -1, PRIME))
    out = np.zeros(len(values) + 1, np.uint64)
    for i in range(0, len(values), BLOCK):
        v = values[i: i + BLOCK].astype(np.uint64) + np.uint64(1)
        w = inverse[i: i + len(v)]
        high, low = np.cumsum(v * (w >> _31)), np.cumsum(v * (w & _LOW_31))  # at most 2**60 and 2**61 over a block
        out[i + 1: i + 1 + len(v)] = _reduce((high >> _30) + ((high & _LOW_30) << _31) + low + out[i])
    return out


def field_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed field hash of each span; different spans of L bytes at most agree with a chance of L / 2**61."""
    return mix(field_product(_reduce(prefix[end] + _P - prefix[start]), field_powers(len(prefix) - 1, base)[start]))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values (len(x) - w + 1 of them), by doubling."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; every row is in exactly one."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated start, start+1, ... of the given lengths."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in the buffer and each word's row.

    ``table`` maps a byte to 0 (outside words) or to the byte that is hashed.
    A word never crosses a row.
    """
    inside = table[buf] != 0
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def _word_table() -> np.ndarray:
    """Digits, ASCII letters (lower-cased) and every byte of a non-ASCII character."""
    t = np.zeros(256, np.uint8)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        t[lo:hi] = np.arange(lo, hi)
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


WORD_TABLE = _word_table()


def start(spark: SparkSession) -> str:
    """Make the package importable on executors; the shared scratch folder."""
    ship_package(spark)
    return checkpoint_dir(spark)


def unused(df: DataFrame, name: str) -> str:
    """The name, longer if the table has such a column (in any case of letters)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


class Shared:
    """Tables of one run in the shared checkpoint folder (cut lineage, survive lost executors)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{start(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame, partition_by: list[str] | None = None, batch: int = BATCH_ROWS) -> DataFrame:
        path = f"{self.root}/t{self.n}"
        self.n += 1
        before, records = self.spark.conf.get(CLEANUP, "false"), self.spark.conf.get(ARROW_RECORDS)
        self.spark.conf.set(CLEANUP, "true")  # the shuffle files of this write go when it ends
        if not 0 < int(records) <= batch:
            self.spark.conf.set(ARROW_RECORDS, str(batch))  # texts cross to Python in pieces of some megabytes
        try:
            w = df.write.option("compression", "zstd")
            (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
            self.spark.conf.set(ARROW_RECORDS, records)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.shared_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            if getattr(t, "shared_path", None) is None:
                continue
            path = jvm.org.apache.hadoop.fs.Path(t.shared_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


LOW, HIGH = -(1 << 63), (1 << 63) - 1


def integral(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles without a fraction (exact at any size)."""
    def one(e: Column) -> Column:
        x = e * F.lit(float(scale))  # a double of 2**52 and more has no fraction; floor() gives 64 bits only
        return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    return F.transform(vec.cast("array<double>"), one)


def finite(vec: Column) -> Column:
    """A vector without null, NaN or infinite components (an empty one is finite)."""
    return vec.isNotNull() & F.forall(vec.cast("array<double>"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integral doubles; one beyond 64 bits is the largest or smallest such value."""
    dim = q.shape[1]
    out = np.zeros((len(q), len(c)), np.int64)
    if not dim or not out.size:
        return out
    qa, ca = np.abs(q).max(axis=1), np.abs(c).max(axis=1)
    limit = np.sqrt(2.0**53 / dim)
    if qa.max() < limit and ca.max() < limit:
        return (q @ c.T).astype(np.int64)  # every partial sum is an integer below 2**53
    q_ok, c_ok = np.flatnonzero(qa < limit), np.flatnonzero(ca < limit)
    out[np.ix_(q_ok, c_ok)] = (q[q_ok] @ c[c_ok].T).astype(np.int64)
    large = [(i, range(len(c))) for i in np.flatnonzero(qa >= limit)] + [(i, np.flatnonzero(ca >= limit)) for i in q_ok]
    for i, others in large:  # whole numbers of any size
        x = [int(e) for e in q[i].tolist()]
        for j in others:
            out[i, j] = min(max(sum(a * int(b) for a, b in zip(x, c[j].tolist())), LOW), HIGH)
    return out


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for the test fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """A bounded training sample for a 0/1 label, and the number of rows of each class.

    Of each class the ``per_class`` ids of smallest hash are taken (all, if
    fewer), so the sample does not depend on the layout of the tables. A
    document labelled twice has its larger label.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    own = docs.select(F.col(id_col).alias("id")).distinct().join(own, "id")
    order = F.xxhash64(F.col("id").cast("string"), F.lit(label))
    totals = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    picked = [own.where(F.col("label") == c).orderBy(order, "id").limit(per_class) for c in (0, 1)]
    chosen = docs.sparkSession.createDataFrame(
        [tuple(r) for p in picked for r in p.collect()], own.schema)  # at most 2 x per_class ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), "id").dropDuplicates(["id"]), totals
