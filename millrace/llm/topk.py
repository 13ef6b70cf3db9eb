"""Exact top-k inner-product search by distributed histogram selection.

Vectors become integers, floor(scale * x). All rows are scored against the
stated query rows in blocks, several times: each pass counts, for every query,
the scores of the current interval in ``BINS`` bins, adds the counts of all
blocks, and narrows the interval to the bin that holds the query's k-th highest
score, until that is one integer. A last pass keeps scores of at least the k-th
value and breaks ties by the smaller id. A block passes on only its topmost
bins up to k rows, as the k-th value overall is never below a block's own.

Candidate rows lie in cells of about ``CELL_ROWS`` rows by the hash of their id,
query rows in blocks of ``QUERY_ROWS``; a task holds one cell and one block at a
time, whatever the number of rows or equal vectors.

Rows: vectors that are null or hold a null or non-finite component, and rows
without an id, take no part. Components of any size are exact; a score beyond 64
bits counts as the largest or smallest 64-bit value. A row is compared with rows
of the same number of components (empty vectors with one another: their score is
0). A query's own id
is never its result; repeated candidate rows each count; a repeated query row
counts once. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

BINS = 1024
CELL_ROWS = 4096
QUERY_ROWS = 512
TOP = 1 << 61  # histograms take scores beyond as this much; the last pass ranks them as they are


def integers(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<double>) of the rows that take part; every component without a fraction."""
    vec = F.col(vec_col)
    return rows.where(F.col(id_col).isNotNull() & common.finite(vec)).select(
        F.col(id_col).cast("bigint").alias("id"), common.integral(vec, scale).alias("v"))


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")


def packed(df: DataFrame, extra: list[str], rows: int) -> DataFrame:
    """Blocks of up to ``rows`` rows of one cell and dimension; each column as one binary."""
    names = ["id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.Table]] = {}

        def block(key: tuple, table: pa.Table) -> pa.RecordBatch:
            raw = [np.asarray(table.column(c)).astype("<i8").tobytes() for c in names]
            m = matrix(table.column("v").combine_chunks())
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()),
                 *(pa.array([r], pa.binary()) for r in raw), pa.array([m.tobytes()], pa.binary())],
                names=["cell", "dim", *names, "m"])

        for b in batches:
            t = pa.Table.from_batches([b])
            cell, dim = np.asarray(t.column("cell")), np.asarray(t.column("dim"))
            for key in sorted(set(zip(cell.tolist(), dim.tolist()))):
                mine = t.filter(pa.array((cell == key[0]) & (dim == key[1])))
                held.setdefault(key, []).append(mine)
                have = pa.concat_tables(held[key])
                while have.num_rows >= rows:
                    yield block(key, have.slice(0, rows))
                    have = have.slice(rows)
                held[key] = [have]
        for key, parts in sorted(held.items()):
            have = pa.concat_tables(parts)
            if have.num_rows:
                yield block(key, have)

    schema = "cell bigint, dim int, " + ", ".join(f"{c} binary" for c in names) + ", m binary"
    return df.mapInArrow(run, schema)


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def scored(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, query ids, candidate ids) of one pair of blocks; exact, int64 throughout."""
    row = {c: b.column(c)[i].as_py() for c in ("dim", "id", "m", "c_id", "c_m")}
    ids, cands = _ints(row["id"]), _ints(row["c_id"])
    q = np.frombuffer(row["m"], "<f8").reshape(len(ids), row["dim"])
    c = np.frombuffer(row["c_m"], "<f8").reshape(len(cands), row["dim"])
    return common.products(q, c), ids, cands


def count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bin, n): the block's topmost bins of the query's interval, up to ``need`` rows."""
    for b in batches:
        for i in range(b.num_rows):
            s, ids, cands = scored(b, i)
            key, lo, width, need = (_ints(b.column(c)[i].as_py())[:, None] for c in ("key", "lo", "width", "need"))
            step = -(-width // BINS)
            s = np.clip(s, -TOP, TOP) - lo  # places inside the interval; what lies outside sorts last
            away = (s < 0) | (s >= width) | (ids[:, None] == cands[None, :])
            s = np.where(away, np.int64(-1), s // step)
            k = int(need.max())
            if s.shape[1] > k:
                s = -np.partition(-s, k - 1, axis=1)[:, :k] if k else s[:, :0]
            # the k highest bins; a bin cut by k is still counted up to what is needed
            got = np.stack([np.broadcast_to(key, s.shape), s], axis=-1)[s >= 0]
            pairs, n = np.unique(got.reshape(-1, 2), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int64))], names=["key", "bin", "n"])


def best_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, query, id, score): the block's k best rows among those of at least the k-th value."""
    for b in batches:
        for i in range(b.num_rows):
            s, ids, cands = scored(b, i)
            key, floor, k = (_ints(b.column(c)[i].as_py()) for c in ("key", "lo", "k"))
            q, c = np.nonzero((np.clip(s, -TOP, TOP) >= floor[:, None]) & (ids[:, None] != cands[None, :]))
            order = np.lexsort((cands[c], ~s[q, c], q))  # ~ turns the order of all 64-bit integers round
            q, c = q[order], c[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            q, c = q[rank < k[q]], c[rank < k[q]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[q]), pa.array(ids[q]), pa.array(cands[c]), pa.array(s[q, c])],
                names=["key", "query_id", "id", "score"])


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): every query's k highest scores over all other rows."""
    spark = rows.sparkSession
    shared = common.Shared(spark, "topk")
    everything = integers(rows, id_col, vec_col, scale)
    cells = F.lit(0).cast("bigint")
    n, norm = everything.agg(
        F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))).first()
    parts = max(1, -(-n // CELL_ROWS))
    bound = int(min(norm or 0.0, float(TOP - 1))) + 1  # no score exceeds the largest squared norm
    cells = F.pmod(F.xxhash64("id"), F.lit(parts))
    cand = shared.write(packed(everything.select("id", "v", F.size("v").alias("dim"), cells.alias("cell"))
                               .repartition(parts, "cell"), [], CELL_ROWS))
    cand = cand.select("cell", "dim", F.col("id").alias("c_id"), F.col("m").alias("c_m"))
    queries = shared.write(
        integers(rows.where(is_query), id_col, vec_col, scale).dropDuplicates(["id", "v"])
        .select("id", "v", F.size("v").alias("dim"), F.xxhash64("id", "v").alias("key")))
    state = queries.select("key", F.lit(-bound).cast("bigint").alias("lo"), F.lit(2 * bound + 1).cast("bigint").alias("width"),
                           F.lit(k).cast("bigint").alias("need"))

    def pairs(state: DataFrame, extra: list[str]) -> DataFrame:
        """Each query block beside each cell's candidate block."""
        ready = queries.join(state, "key").withColumn("cell", F.lit(0).cast("bigint"))
        blocks = packed(ready.select("cell", "dim", "v", "id", *extra), extra, QUERY_ROWS)
        copies = blocks.drop("cell").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        return copies.join(cand, ["cell", "dim"])

    width = 2 * bound + 1
    while width > 1:
        counts = (pairs(state, ["key", "lo", "width", "need"]).mapInArrow(count_bins, "key bigint, bin bigint, n bigint")
                  .groupBy("key", "bin").agg(F.sum("n").alias("n")))
        above = F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
        located = (counts.withColumn("above", F.coalesce(above, F.lit(0))).join(state, "key")
                   .where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
                   .select("key", "bin", "above"))
        step = F.ceil(F.col("width") / F.lit(BINS)).cast("bigint")
        old = state
        # a query with fewer rows than it needs keeps the lowest value: all its rows are taken
        state = shared.write(
            state.join(located, "key", "left").select(
                "key", (F.col("lo") + F.coalesce(F.col("bin"), F.lit(0)) * step).alias("lo"), step.alias("width"),
                (F.col("need") - F.coalesce(F.col("above"), F.lit(0))).alias("need")))
        if hasattr(old, "shared_path"):
            shared.drop(old)
        width = -(-width // BINS)
    best = pairs(state.withColumn("k", F.lit(k).cast("bigint")), ["key", "lo", "k"]).mapInArrow(
        best_rows, "key bigint, query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
