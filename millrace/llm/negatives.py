"""Hard negatives by a secondary-sort shuffle.

Vectors become integers, floor(scale * x). Anchors are a stated part of the
rows. All rows are scored against the anchors, twice:

1. positives: every task keeps an anchor's ``k`` best rows of its own label,
   and the best ``k`` of all tasks are the anchor's positives;
2. candidates: with the anchors' positive scores known, every task keeps, for
   each positive, its ``k`` best rows of another label inside the positive's
   score window. No other row of the task can be among the overall first k.

Positives and candidates are then packed into keys of 26 bytes,
(anchor, descending score, positive first, id), whose bytes sort as the rows
should be met. One shuffle by anchor that sorts within its partitions brings
them together (``repartition`` + ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions: the sort spills), and a streaming iterator
reads them in order: a positive opens its window, a window closes when the
scores fall below its floor or when it has its k negatives, and every negative
goes out to the windows open at that moment. The iterator holds the open windows
of one anchor, at most k, never the anchor's rows.

Rows and anchors are packed into blocks in the tasks that read them. Blocks of
rows are dealt to cells and blocks of anchors to teams by their numbers, so that
neither a hot label nor a repeated id or vector fills a task. A task takes a team,
whose size is bounded, and then one block of its cell after the other. Each cell
gets a copy of the anchors and each team one of the rows through a shuffle;
nothing is broadcast, and ``layout`` keeps the anchors' copies below the rows'.

Rows: a row without a label or an id, without a vector, or with a null or
non-finite component takes no part. Rows are compared with rows of as many
components (none included: their score is 0). Anchors without a positive, and
positives without a negative in their window, have no rows in the result. An id
is never its own positive or negative. A repeated row counts as often as it
stands there, also in the ranks; an id that stands in several anchor rows is an
anchor once, with its least label and vector. Scores are exact; one beyond 64
bits counts as the largest or smallest 64-bit value. A positive with a score
below 0 has an empty window. An empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

CELL_ROWS = 4096
ANCHOR_ROWS = 512
TILE_ROWS = 1024            # rows whose scores are in hand at once
BLOCK_BYTES = 4 << 20       # of a block's vectors as doubles
BATCH_BLOCKS = 16           # blocks that cross to Python at once
TEAM_BYTES = 128 << 20      # of a team's vectors and what its anchors hold
CELL_PRODUCTS = 10**9       # additions and multiplications that are worth a cell
OUT_ANCHORS = 4096          # anchors whose rows leave at once
SINGLE = 1 << 24            # single precision holds all whole numbers below
# Window of a positive in hundredths of its score
FROM_SHARE, TO_SHARE = 80, 100


# ------------------------------------------------------------------ scoring


def taking_part(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v array<double>) of the rows that take part; every component without a fraction."""
    vec = F.col(vec_col)
    return rows.where(F.col(id_col).isNotNull() & label.isNotNull() & common.finite(vec)).select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), common.integral(vec, scale).alias("v"))


def _narrow(m: np.ndarray) -> bytes:
    """Whole numbers as the narrowest of 8, 16 and 32 bits and doubles that holds them all."""
    for t in ("<i1", "<i2", "<i4"):
        if m.size and np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max:
            return m.astype(t).tobytes()
    return m.tobytes()


def _wide(raw: bytes, rows: int, dim: int) -> np.ndarray:
    """The matrix of doubles that ``_narrow`` packed."""
    if not rows * dim:
        return np.zeros((rows, dim))
    return np.frombuffer(raw, {1: "<i1", 2: "<i2", 4: "<i4", 8: "<f8"}[len(raw) // (rows * dim)]).reshape(rows, dim).astype("<f8")


def packed(df: DataFrame, rows: int, scored: bool = False) -> DataFrame:
    """Blocks of up to ``rows`` rows (and ``BLOCK_BYTES``) of one partition and dimension.

    (part, dim, block, n, id, label, m), ids and labels as 64-bit integers, the
    n vectors as a matrix of whole numbers; with ``scored`` also every row's list
    ``scores``, as their number ``at`` and the numbers one after the other.
    """
    def ints(x: pa.Array) -> bytes:
        return x.cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8").tobytes()

    def block(dim: int, number: int, t: pa.Table) -> pa.RecordBatch:
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        m = col["v"].flatten().to_numpy(zero_copy_only=False).astype("<f8")
        out = {"part": pa.array([col["part"][0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()),
               "block": pa.array([number], pa.int64()), "n": pa.array([t.num_rows], pa.int32()),
               "id": pa.array([ints(col["id"])], pa.binary()),
               "label": pa.array([ints(col["label"])], pa.binary()), "m": pa.array([_narrow(m)], pa.binary())}
        if scored:
            out["at"] = pa.array([ints(pc.list_value_length(col["scores"]))], pa.binary())
            out["scores"] = pa.array([ints(col["scores"].flatten())], pa.binary())
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        number = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = np.asarray(pc.list_value_length(t.column("v")))
            for dim in np.unique(dims).tolist():
                most = max(1, min(rows, BLOCK_BYTES // (8 * max(dim, 1))))
                mine = t.filter(pa.array(dims == dim))
                have = pa.concat_tables([held[dim], mine]) if dim in held else mine
                while have.num_rows >= most:
                    yield block(dim, number, have.slice(0, most))
                    number, have = number + 1, have.slice(most)
                held[dim] = have
        for dim, have in sorted(held.items()):
            if have.num_rows:
                yield block(dim, number, have)
                number += 1

    schema = "part bigint, dim int, block bigint, n int, id binary, label binary, m binary" + ", at binary, scores binary" * scored
    return df.withColumn("part", F.spark_partition_id().cast("bigint")).mapInArrow(run, schema)


def _norms(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(axis=1))


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


class _Top:
    """The k best rows of each slot: highest score, ties to smaller ids."""

    def __init__(self, lows: np.ndarray, k: int):
        self.k, self.n = k, np.zeros(len(lows), np.int64)
        self.score, self.id, self.place = (np.zeros((len(lows), k), np.int64) for _ in range(3))
        self.floor = lows.copy()  # no lower score can enter

    def enters(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> np.ndarray:
        tied = (self.n[slot] == self.k) & (score == self.floor[slot])
        return (score >= self.floor[slot]) & ~(tied & (ident >= self.id[slot, self.k - 1]))

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, place: np.ndarray) -> None:
        if not len(slot):
            return
        old = np.unique(slot)
        i, j = np.nonzero(np.arange(self.k) < self.n[old, None])
        i = old[i]
        slot, score = np.concatenate([i, slot]), np.concatenate([self.score[i, j], score])
        ident, place = np.concatenate([self.id[i, j], ident]), np.concatenate([self.place[i, j], place])
        order = np.lexsort((ident, ~score, slot))  # ~ reverses the order of all 64-bit integers
        slot = slot[order]
        new, start, count = np.unique(slot, return_index=True, return_counts=True)
        rank = np.arange(len(slot)) - np.repeat(start, count)
        keep = rank < self.k
        slot, rank, order = slot[keep], rank[keep], order[keep]
        self.score[slot, rank], self.id[slot, rank], self.place[slot, rank] = score[order], ident[order], place[order]
        self.n[new] = np.minimum(count, self.k)
        full = new[count >= self.k]
        self.floor[full] = self.score[full, self.k - 1]

    def entries(self, start: int, end: int) -> tuple[np.ndarray, ...]:
        """(slot, score, id, place) of what the slots from start to end hold."""
        i, j = np.nonzero(np.arange(self.k) < self.n[start:end, None])
        i = i + start
        return i, self.score[i, j], self.id[i, j], self.place[i, j]


class _Anchors:
    """Anchors of one dimension that blocks of rows go by: what they have found so far is all that is kept."""

    def __init__(self, dim: int, blocks: list[dict]):
        self.ids, self.labels = (np.concatenate([_ints(b[c]) for b in blocks]) for c in ("id", "label"))
        self.met, self.tile = 0, np.empty(ANCHOR_ROWS * TILE_ROWS, np.float32)  # the scores in hand
        self.norm = np.concatenate([_norms(_wide(b["m"], b["n"], dim)) for b in blocks])
        kind = np.float32 if self.norm.max(initial=0) < SINGLE else np.float64
        self.m = np.concatenate([_wide(b["m"], b["n"], dim).astype(kind) for b in blocks])

    def scored(self, r0: int, r1: int, m: np.ndarray, single: np.ndarray, norm: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(columns, scores) of the anchors r0 to r1 by the rows of a block; scores stand until the next are asked for.

        No sum of products of two rows exceeds the product of their norms: below
        2**24 single precision is exact, in whatever order they are added.
        """
        most = self.norm[r0:r1].max(initial=0)
        ok = (most * norm < SINGLE) & (norm < SINGLE) & (most < SINGLE)
        cols, q = np.flatnonzero(ok), self.m[r0:r1].astype(np.float32, copy=False)
        for i in range(0, len(cols), TILE_ROWS):
            part = cols[i: i + TILE_ROWS]
            out = self.tile[: len(q) * len(part)].reshape(len(q), len(part))
            yield part, np.matmul(q, (single[i: i + TILE_ROWS] if ok.all() else single[part]).T, out=out)
        if (cols := np.flatnonzero(~ok)).size:
            yield cols, common.products(self.m[r0:r1].astype("<f8"), m[cols])

    def hits(self, s: np.ndarray, r0: int, cols: np.ndarray, take, low, high=None) -> None:
        """Hand ``take`` the (anchor, column, score) that reach ``low`` of their anchor and no more than ``high``.

        Where many do, half the columns go first, as they raise ``low``.
        """
        def bound(x: np.ndarray) -> np.ndarray:
            return x if s.dtype == np.int64 else x.clip(-SINGLE, SINGLE).astype(np.float32)

        r = np.flatnonzero(s.max(axis=1) >= bound(low(r0, r0 + len(s))))
        if not len(r):
            return
        part = s[r]
        fits = part >= bound(low(r0, r0 + len(s))[r])[:, None]
        if high is not None:
            fits &= part <= bound(high[r0: r0 + len(s)][r])[:, None]
        if s.shape[1] > 64 and np.count_nonzero(fits) > 64 * len(r):
            half = s.shape[1] // 2
            self.hits(s[:, :half], r0, cols[:half], take, low, high)
            self.hits(s[:, half:], r0, cols[half:], take, low, high)
            return
        at = np.flatnonzero(fits)
        i, j = at // s.shape[1], at % s.shape[1]
        take(r0 + r[i], cols[j], part[i, j].astype(np.int64))

    def meet(self, n: int, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        places = np.arange(self.met, self.met + n)
        self.met += n
        with np.errstate(over="ignore", invalid="ignore"):  # of rows too large for single precision
            self.meet_block(ids, labels, m, m.astype(np.float32), _norms(m), places)


class _Positives(_Anchors):
    """The k best rows of each anchor's label."""

    def __init__(self, dim: int, blocks: list[dict], k: int):
        super().__init__(dim, blocks)
        order = np.argsort(self.labels, kind="stable")
        self.ids, self.labels, self.m, self.norm = self.ids[order], self.labels[order], self.m[order], self.norm[order]
        self.top = _Top(np.full(len(self.ids), common.LOW), k)

    def meet_block(self, ids, labels, m, single, norm, places) -> None:
        order = np.argsort(labels, kind="stable")
        ids, labels, m, single, norm, places = (x[order] for x in (ids, labels, m, single, norm, places))

        def take(r: np.ndarray, c: np.ndarray, score: np.ndarray) -> None:
            ok = (self.ids[r] != ids[c]) & self.top.enters(r, score, ids[c])
            self.top.add(r[ok], score[ok], ids[c[ok]], places[c[ok]])

        for label in np.unique(labels).tolist():
            a0, a1 = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, side="right")
            c0, c1 = np.searchsorted(labels, label), np.searchsorted(labels, label, side="right")
            for r in range(a0, a1, ANCHOR_ROWS):
                for cols, s in self.scored(r, min(r + ANCHOR_ROWS, a1), m[c0:c1], single[c0:c1], norm[c0:c1]):
                    self.hits(s, r, c0 + cols, take, lambda x, y: self.top.floor[x:y])

    def found(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), OUT_ANCHORS):
            slot, score, ident, _ = self.top.entries(i, i + OUT_ANCHORS)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[slot]), pa.array(score), pa.array(ident)], names=["anchor", "score", "id"])


def inside(n: int, p: int, low: int, high: int) -> bool:
    return low * p <= 100 * n <= high * p


def _window(p: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest score inside the window of a positive."""
    return max(-(-low * p // 100), common.LOW), min(high * p // 100, common.HIGH)


class _Negatives(_Anchors):
    """For each positive score of an anchor, the k best rows of other labels in its window."""

    def __init__(self, dim: int, blocks: list[dict], k: int, low: int, high: int):
        super().__init__(dim, blocks)
        at, scores = (np.concatenate([_ints(b[c]) for b in blocks]) for c in ("at", "scores"))
        slots = sorted({(r, *_window(p, low, high)) for r, p in zip(np.repeat(np.arange(len(at)), at).tolist(), scores.tolist())})
        slots = np.array([x for x in slots if x[1] <= x[2]], np.int64).reshape(-1, 3)
        some = np.unique(slots[:, 0])  # anchors with a window
        self.ids, self.labels, self.m, self.norm = self.ids[some], self.labels[some], self.m[some], self.norm[some]
        self.first = np.append(np.searchsorted(slots[:, 0], some), len(slots))  # an anchor's slots lie together
        self.low, self.high = slots[:, 1].copy(), slots[:, 2].copy()
        self.top = _Top(self.low, k)
        self.highest = np.maximum.reduceat(self.high, self.first[:-1]) if len(some) else self.high

    def lowest(self, r0: int, r1: int) -> np.ndarray:
        return np.minimum.reduceat(self.top.floor[: self.first[r1]], self.first[r0:r1])

    def meet_block(self, ids, labels, m, single, norm, places) -> None:
        def take(r: np.ndarray, c: np.ndarray, score: np.ndarray) -> None:
            ok = (self.labels[r] != labels[c]) & (self.ids[r] != ids[c])
            r, c, score = r[ok], c[ok], score[ok]
            n = self.first[r + 1] - self.first[r]
            slot, row = common.ranges(self.first[r], n), np.repeat(np.arange(len(r)), n)
            c, score = c[row], score[row]
            ok = (score <= self.high[slot]) & self.top.enters(slot, score, ids[c])
            self.top.add(slot[ok], score[ok], ids[c[ok]], places[c[ok]])

        for r in range(0, len(self.ids), ANCHOR_ROWS):
            for cols, s in self.scored(r, min(r + ANCHOR_ROWS, len(self.ids)), m, single, norm):
                self.hits(s, r, cols, take, self.lowest, self.highest)

    def found(self) -> Iterator[pa.RecordBatch]:
        """Every row once for an anchor, in however many of its windows it lies."""
        for i in range(0, len(self.ids), OUT_ANCHORS):
            end = min(i + OUT_ANCHORS, len(self.ids))
            slot, score, ident, place = self.top.entries(self.first[i], self.first[end])
            r = np.searchsorted(self.first, slot, side="right") - 1
            order = np.lexsort((place, r))
            r, score, ident, place = (x[order] for x in (r, score, ident, place))
            one = np.ones(len(r), bool)
            one[1:] = (r[1:] != r[:-1]) | (place[1:] != place[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[r[one]]), pa.array(score[one]), pa.array(ident[one])],
                                             names=["anchor", "score", "id"])


def _meet(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """(anchor, score, id) of what the anchors of each task's cells find in the blocks that follow them there."""
    at, held, anchors = None, [], None
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names}
            if (key := (row["cell"], row["team"], row["dim"])) != at:
                if anchors:
                    yield from anchors.found()
                at, held, anchors = key, [], None
            if row["kind"] == 0:
                held.append(row)
            elif held or anchors:
                if not anchors:
                    anchors, held = make(row["dim"], held), []
                anchors.meet(row["n"], _ints(row["id"]), _ints(row["label"]), _wide(row["m"], row["n"], row["dim"]))
    if anchors:
        yield from anchors.found()


def meeting(anchors: DataFrame, cand: DataFrame, teams: int, cells: int) -> DataFrame:
    """Teams of anchor blocks beside cells of row blocks: every anchor meets every row in one task.

    In a task the anchors of a team and dimension come first, then the blocks of a cell.
    """
    def number(n: int) -> Column:
        return F.pmod(F.xxhash64("part", "block"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    a = anchors.withColumn("kind", F.lit(0)).withColumn("team", number(teams)).withColumn("cell", every(cells))
    c = cand.withColumn("kind", F.lit(1)).withColumn("cell", number(cells)).withColumn("team", every(teams))
    both = a.unionByName(c, allowMissingColumns=True).drop("part", "block")
    return both.repartition(teams * cells, "cell", "team").sortWithinPartitions("cell", "team", "dim", "kind")


def layout(anchors: int, anchor_bytes: int, rows: int, components: int, blocks: int) -> tuple[int, int]:
    """(teams, cells): a team's anchors fit into a task; cells as the products ask for, while copied anchors stay a part of the rows."""
    teams = max(1, -(-anchor_bytes // TEAM_BYTES))
    cells = min(blocks, teams * rows // (2 * max(anchors, 1)), 2 * anchors * components // CELL_PRODUCTS)
    return teams, max(1, cells)


# ------------------------------------------------- keys and the streaming pass


def pack(anchor: Column, score: Column, kind: Column, ident: Column) -> Column:
    """Key whose bytes sort by anchor, descending score, positives first, id."""
    def big_endian(x: Column) -> Column:  # two's complement with the sign bit turned sorts as unsigned bytes
        return F.unhex(F.lpad(F.hex(x.bitwiseXOR(F.lit(common.LOW))), 16, "0"))
    return F.concat(big_endian(anchor), big_endian(F.bitwise_not(score)),
                    F.unhex(F.lpad(F.hex(kind), 4, "0")), big_endian(ident))


def unpack(keys: pa.Array) -> np.ndarray:
    """(anchor, score, kind, id) of each key."""
    raw = b"".join(keys.to_pylist())
    t = np.frombuffer(raw, np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", ">u2"), ("id", ">u8")]))
    flip = np.uint64(1 << 63)
    return np.stack([(t["anchor"].astype(np.uint64) ^ flip).view(np.int64), ~(t["score"].astype(np.uint64) ^ flip).view(np.int64),
                     t["kind"].astype(np.int64), (t["id"].astype(np.uint64) ^ flip).view(np.int64)], axis=1)


def emit(keys: Iterator[tuple[int, int, int, int]], k: int, low: int, high: int) -> Iterator[tuple]:
    """Negatives of every positive from keys in order: (anchor, positive, rank, negative, scores of both).

    The state is the open windows of the current anchor: [positive, score, negatives so far].
    """
    anchor, windows = None, []
    for a, score, kind, ident in keys:
        if a != anchor:
            anchor, windows = a, []
        if kind == 0:
            windows.append([ident, score, 0])
            continue
        # scores only fall: a window whose floor has been passed or that is full stays shut
        windows = [w for w in windows if low * w[1] <= 100 * score and w[2] < k]
        for w in windows:
            if inside(score, w[1], low, high):
                w[2] += 1
                yield a, w[0], w[2], ident, w[1], score


def _stream(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    for r in emit((tuple(x) for b in batches for x in unpack(b.column(0)).tolist()), k, low, high):
        rows.append(r)
        if len(rows) == 10_000:
            yield batch()
    yield batch()


def mine(rows: DataFrame, is_anchor: Column, label: Column | str = "label", k: int = 5, id_col: str = "vec_id",
         vec_col: str = "embedding", scale: int = 256, low: int = FROM_SHARE, high: int = TO_SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Per anchor the first ``k`` rows of its label are positives; per positive the
    first ``k`` rows of other labels with low * positive score <= 100 * score <=
    high * positive score are its negatives, high at most 100.
    """
    if high > 100:
        raise ValueError("a window that reaches above its positive's score is not met in score order")
    shared = common.Shared(rows.sparkSession, "negatives")
    label = F.col(label) if isinstance(label, str) else label
    found = "anchor bigint, score bigint, id bigint"
    # blocks are as the input's partitions hold the rows; where a block lies depends on no row's content
    cand = shared.write(packed(taking_part(rows, id_col, vec_col, label, scale), CELL_ROWS))
    n, components, blocks = cand.agg(F.sum("n"), F.sum(F.col("n") * F.col("dim").cast("bigint")), F.count(F.lit(1))).first()
    anchors = taking_part(rows.where(is_anchor), id_col, vec_col, label, scale)
    anchors = shared.write(anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("_first"))
                           .select("id", F.col("_first.label").alias("label"), F.col("_first.v").alias("v")))
    queries = shared.write(packed(anchors, ANCHOR_ROWS))
    state = 24 * k * (k + 1)  # of an anchor: k windows of k rows, and their bounds
    a, size = queries.agg(F.sum("n"), F.sum(F.col("n") * (F.col("dim").cast("bigint") * 8 + state))).first()
    teams, cells = layout(a or 0, size or 0, n or 0, components or 0, blocks)

    # positives are sought among the rows of one label only: fewer cells, and fewer rows to rank
    met = meeting(queries, cand, teams, -(-cells // 4)).mapInArrow(lambda it: _meet(it, lambda dim, blocks: _Positives(dim, blocks, k)), found)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    positives = shared.write(met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn"), batch=BATCH_BLOCKS)
    scores = positives.groupBy("anchor").agg(F.collect_list("score").alias("scores"))  # at most k of an anchor
    windows = anchors.join(scores.hint("merge"), anchors["id"] == scores["anchor"]).select("id", "label", "v", "scores")
    queries = shared.write(packed(windows, ANCHOR_ROWS, scored=True))
    met = meeting(queries, cand, teams, cells).mapInArrow(lambda it: _meet(it, lambda dim, blocks: _Negatives(dim, blocks, k, low, high)), found)
    candidates = shared.write(met, batch=BATCH_BLOCKS)
    shared.drop(cand, anchors, queries)
    met = positives.withColumn("kind", F.lit(0)).unionByName(candidates.withColumn("kind", F.lit(1)))
    keys = met.select(pack(F.col("anchor"), F.col("score"), F.col("kind"), F.col("id")).alias("key"))
    return (keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key").mapInArrow(
        lambda it: _stream(it, k, low, high),
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"))
