"""Exact substring deduplication by a common-prefix-aware distributed merge sort.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier (smaller document id, or same document and earlier start).

*Which suffixes.* In each window of ``length`` bytes the leftmost smallest hash
of its ``GRAM``-byte strings is the window's anchor: equal windows have equal
anchors at equal places. Neighbouring windows with one anchor form a run, and
runs between sparse anchors a chunk. Only runs and chunks whose fingerprint
occurs twice can hold a repeated window; their fingerprints are counted and the
rest, most of the text, takes no part. What is equal inside 8 MB of an Arrow batch
is settled there, and only its first copy goes on.

*Sorting.* Each task sorts the strings of its chunks, and for runs the suffixes
that start at the anchors, and cuts the sorted run at fixed ranges of the
fingerprint. Runs are exchanged front-coded (length of the prefix shared with
the string before, and the rest). A loser tree merges the runs of a range; it
keeps for every loser how much it shares with the last winner, so a known prefix
is never compared again, and yields the common prefixes of neighbours.

*Windows.* A chunk equal to an earlier one is removed whole. For runs the order
and its common prefixes give, for every distance d of a window's start from the
anchor, the classes of equal last length - d bytes; windows that also agree in
the d bytes before the anchor are equal, and all but the first are removed.
Anchors that occur more than ``HOT`` times with different surroundings are
exchanged as single windows. Of equal windows or chunks in a sorted run only the
first is exchanged; the others are known as repeated there, so a range holds a
frequent window once a run, not once an occurrence.

Rows: a null text is empty; texts shorter than ``length`` lose nothing; repeated
rows of an id are one document (equal positions are not earlier than each
other); rows without an id lose nothing and take no part; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

LENGTH = 100
GRAM = 24
SPARSE = 8
CHUNK_WINDOWS = 4096
HOT = 5000
RUN_BYTES = 8 << 20
RANGE_ENTRIES = 25_000

RUN, CHUNK, KNOWN = 0, 1, 2


def anchored(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor, fingerprint) of every run, and the prefix hash; places in the buffer."""
    gram = min(GRAM, length)
    w = length - gram + 1
    p = common.prefix_hash(buf)
    counts = np.maximum(np.diff(off) - length + 1, 0)
    if len(buf) < length or not counts.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64), p
    i = np.arange(len(buf) - gram + 1)
    g = common.span_hash(p, i, i + gram)
    least = common.sliding_min(g, w)
    start = common.ranges(off[:-1], counts)
    row = np.repeat(np.arange(len(counts)), counts)
    value = least[start]

    def runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(start), bool)
        new[1:] = change | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(start)))

    first, n = runs(value[1:] != value[:-1])
    anchor = np.concatenate([at + np.argmin(g[at[:, None] + np.arange(w)], axis=1)
                             for at in np.array_split(start[first], len(first) // 8192 + 1)])
    if (n > anchor - start[first] + 1).any():
        # a gram repeats inside a window (periodic text): leftmost places window by window
        place, have = np.arange(len(g)), 1
        while have < w:
            step = min(have, w - have)
            a, b = place[:-step], place[step:]
            place = np.where(g[a] <= g[b], a, b)
            have += step
        leftmost = place[start]
        first, n = runs(leftmost[1:] != leftmost[:-1])
        anchor = leftmost[first]
    return row[first], start[first], n, anchor, value[first], p


def chunks(row: np.ndarray, start: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first run, windows) of chunks: cut at sparse anchors, rows and CHUNK_WINDOWS."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = h % np.uint64(SPARSE) == 0
    cut[0] = True
    cut[1:] |= row[1:] != row[:-1]
    head = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), 0))
    block = (start - start[head]) // CHUNK_WINDOWS
    cut[1:] |= block[1:] != block[:-1]
    first = np.flatnonzero(cut)
    return first, np.add.reduceat(n, first)


def _order(ids: pa.Array) -> np.ndarray:
    """Ranks of the ids of a batch in their order."""
    return np.unique(np.array(ids.to_pylist()), return_inverse=True)[1]


def _fingerprints(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, kind, start, n, d, h): runs (anchor d bytes on) and chunks, equal ones of a piece once; windows known to be repeated.

    A piece is about RUN_BYTES of a batch's text, so the memory of a task does not follow the length of the rows.
    """
    for whole in batches:
        for first_row, end_row in common.slices(common.text_buffer(whole.column("text"))[1], RUN_BYTES):
            yield _fingerprints_of(whole.slice(first_row, end_row - first_row), length)


def _fingerprints_of(b: pa.RecordBatch, length: int) -> pa.RecordBatch:
    buf, off = common.text_buffer(b.column("text"))
    parts = []
    for i, j in common.slices(off, common.SLICE_BYTES // 4):
        own = off[i: j + 1] - off[i]
        row, start, n, anchor, h, p = anchored(buf[off[i]: off[j]], own, length)
        e = common.span_hash(p, start, start + n + length - 1)
        first, windows = chunks(row, start, n, h)
        c = common.span_hash(p, start[first], start[first] + windows + length - 1)
        for kind, r, s, m, d, x, y in ((RUN, row, start, n, anchor - start, h, e),
                                       (CHUNK, row[first], start[first], windows, np.zeros_like(first), c, c)):
            parts.append((np.full(len(r), kind, np.int8), (r + i).astype(np.int32), (s - own[r]).astype(np.int32),
                          m.astype(np.int32), d.astype(np.int32), x, y))
    kind, row, start, n, d, h, e = (np.concatenate([p[k] for p in parts]) for k in range(7))
    rank = _order(b.column("id"))[row]
    order = np.lexsort((start, rank, e, h, kind))
    same = np.zeros(len(order), bool)
    a, z = order[1:], order[:-1]
    same[1:] = (kind[a] == kind[z]) & (h[a] == h[z]) & (e[a] == e[z])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    lead = order[head]
    again = same & ((rank[order] != rank[lead]) | (start[order] != start[lead])) & (kind[order] == RUN)
    known = order[again]
    known = known[np.lexsort((start[known], row[known]))]
    merged = np.ones(len(known), bool)
    merged[1:] = (row[known[1:]] != row[known[:-1]]) | (start[known[1:]] > start[known[:-1]] + n[known[:-1]])
    f = np.flatnonzero(merged)
    total = np.add.reduceat(n[known], f) if len(f) else np.zeros(0, np.int32)
    keep = order[~same]
    out_row = np.concatenate([row[keep], row[known[f]]])
    return pa.RecordBatch.from_arrays(
        [b.column("id").take(pa.array(out_row)),
         pa.array(np.concatenate([kind[keep], np.full(len(f), KNOWN)]).astype(np.int32)),
         pa.array(np.concatenate([start[keep], start[known[f]]]).astype(np.int32)),
         pa.array(np.concatenate([n[keep], total]).astype(np.int32)),
         pa.array(np.concatenate([d[keep], np.zeros(len(f), np.int64)]).astype(np.int32)),
         pa.array(np.concatenate([h[keep], np.zeros(len(f), np.uint64)]).view(np.int64))],
        names=["id", "kind", "start", "n", "d", "h"])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are not looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8)


BLOCK = ("h", "kind", "shared", "rest", "before", "id", "start", "n")


def _sorted_runs(batches: Iterator[pa.RecordBatch], length: int, ranges: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Front-coded sorted runs of about RUN_BYTES of text: one row for every run and range."""
    for whole in batches:
        for i, j in common.slices(common.text_buffer(whole.column("text"))[1], RUN_BYTES):
            yield from _sorted_run(whole.slice(i, j - i), length, ranges, id_kind)


def _sorted_run(b: pa.RecordBatch, length: int, ranges: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    buf, off = common.text_buffer(b.column("text"))
    ids = b.column("id").to_pylist()
    lists = b.column("marks")
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    kind, start, n, away, h, first, hot = (
        np.asarray(flat.field(k)) for k in ("kind", "start", "n", "d", "h", "first", "hot"))
    row = np.repeat(np.arange(len(ids)), sizes)
    at = off[row] + start
    # runs inside a repeated chunk need no look of their own
    gone = np.flatnonzero((kind == CHUNK) & ~first)
    gone = gone[np.argsort(at[gone], kind="stable")]
    inside = np.zeros(len(at), bool)
    if len(gone):
        k = np.maximum(np.searchsorted(at[gone], at, side="right") - 1, 0)
        inside = (at[gone][k] <= at) & (at + n <= at[gone][k] + n[gone][k]) & (kind == RUN)
    entries: list[tuple] = []
    raw = buf.tobytes()
    for x in np.flatnonzero(~inside).tolist():
        a, m, r = int(at[x]), int(n[x]), int(row[x])
        if kind[x] == CHUNK:
            entries.append((int(h[x]), CHUNK, raw[a: a + m + length - 1], b"", ids[r], int(start[x]), m))
        elif hot[x]:
            for k in range(m):
                piece = raw[a + k: a + k + length]
                key = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big", signed=True)
                entries.append((key, CHUNK, piece, b"", ids[r], int(start[x]) + k, 1))
        else:
            d = int(away[x])
            entries.append((int(h[x]), RUN, raw[a + d: a + m + length - 1], raw[a: a + d], ids[r], int(start[x]), m))
    entries.sort()
    blocks: dict[int, dict[str, list]] = {}
    last: dict[int, tuple] = {}
    again: list[tuple] = []  # equal strings of this run but the first: known as repeated without a merge
    for e in entries:
        z = ((e[0] + (1 << 63)) * ranges) >> 64
        block = blocks.setdefault(z, {k: [] for k in BLOCK})
        prev = last.get(z)
        shared = common_prefix(prev[2], e[2]) if prev is not None and prev[:2] == e[:2] else 0
        if prev is not None and e[1] == CHUNK and prev[:3] == e[:3]:
            if prev[4:6] != e[4:6]:  # not a repeated row
                again.append(e[4:])
            continue
        last[z] = e
        for k, v in zip(BLOCK, (e[0], e[1], shared, e[2][shared:], *e[3:])):
            block[k].append(v)
    if again:
        again.sort()
        spans = [list(again[0])]
        for i, a, m in again[1:]:
            if i == spans[-1][0] and a <= spans[-1][1] + spans[-1][2]:
                spans[-1][2] = max(spans[-1][2], a + m - spans[-1][1])
            else:
                spans.append([i, a, m])
        # below zero: ranges of known spans, dealt by the run's first entry
        z = -1 - (((entries[0][0] + (1 << 63)) * 31 + len(entries)) % ranges)
        empty = [b""] * len(spans)
        blocks[z] = {"h": [0] * len(spans), "kind": [KNOWN] * len(spans), "shared": [0] * len(spans), "rest": empty,
                     "before": empty, **{k: list(v) for k, v in zip(("id", "start", "n"), zip(*spans))}}
    if blocks:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int32()),
             *(pa.array([v[k] for v in blocks.values()], pa.list_(t)) for k, t in zip(BLOCK, _block_types(id_kind)))],
            names=["range", *BLOCK])


def _block_types(id_kind: pa.DataType) -> tuple[pa.DataType, ...]:
    return pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), id_kind, pa.int32(), pa.int32()


class LoserTree:
    """Merges sorted front-coded runs; ``lists`` holds (key, shared, rest) of each run.

    Every player knows how many bytes it shares with the last winner. Of two
    players with the same key the one that shares more is smaller; only if they
    share the same number are they compared, from that byte on.
    """

    def __init__(self, lists: list[tuple[list, list, list]]):
        self.lists = lists
        self.size = 1
        while self.size < len(lists):
            self.size *= 2
        self.at = [0] * len(lists)
        self.key: list = [None] * self.size  # None: exhausted
        self.text: list[bytes] = [b""] * self.size
        self.lcp = [0] * self.size
        for r in range(len(lists)):
            self._load(r)
        self.tree = [0] * self.size
        self.winner = self._build(1)

    def _load(self, r: int) -> None:
        keys, shared, rest = self.lists[r]
        i = self.at[r]
        if i >= len(keys):
            self.key[r] = None
            return
        s = shared[i]
        self.text[r] = self.text[r][:s] + rest[i]
        self.key[r] = keys[i]
        self.lcp[r] = s
        self.at[r] = i + 1

    def _less(self, a: int, b: int) -> bool:
        """True if player a wins; the loser's shared length becomes that with the winner."""
        ka, kb = self.key[a], self.key[b]
        if ka != kb:
            win = kb is None or (ka is not None and ka < kb)
            self.lcp[b if win else a] = 0
            return win
        if ka is None:
            return True
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return la > lb  # the loser shares as much with the winner as with the last one
        x, y = self.text[a], self.text[b]
        n = common_prefix(x, y, la)
        win = n == len(x) or (n < len(y) and x[n] < y[n])
        self.lcp[b if win else a] = n
        return win

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win = self._less(a, b)
        self.tree[node] = b if win else a
        return a if win else b

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(run, place in the run, string, bytes shared with the string before)."""
        w = self.winner
        while self.key[w] is not None:
            yield w, self.at[w] - 1, self.text[w], self.lcp[w]
            before = self.key[w]
            self._load(w)
            if self.key[w] != before:
                self.lcp[w] = 0
            node = (w + self.size) // 2
            while node:
                other = self.tree[node]
                if not self._less(w, other):
                    self.tree[node], w = w, other
                node //= 2
        self.winner = w


def _merge(table: pa.Table, length: int, id_kind: pa.DataType) -> pa.Table:
    """(id, start, n): repeated windows of one range; those of a range below zero are known."""
    if table.num_rows and table.column("range")[0].as_py() < 0:
        return pa.table({k: pc.list_flatten(table.column(k)) for k in ("id", "start", "n")})
    blocks = {k: table.column(k).to_pylist() for k in BLOCK}
    lists = [(list(zip(h, kind)), shared, rest) for h, kind, shared, rest in
             zip(blocks["h"], blocks["kind"], blocks["shared"], blocks["rest"])]
    run, place, size, shared = [], [], [], []
    for r, i, text, s in LoserTree(lists):
        run.append(r)
        place.append(i)
        size.append(len(text))
        shared.append(s)

    def column(name: str) -> list:
        return [blocks[name][r][i] for r, i in zip(run, place)]

    ids, before = column("id"), column("before")
    h, kind, start, n = (np.array(column(k), np.int64) for k in ("h", "kind", "start", "n"))
    shared, size = np.array(shared, np.int64), np.array(size, np.int64)
    left = np.array([len(x) for x in before], np.int64)
    anchor = start + left
    id_rank = np.unique(np.array(ids), return_inverse=True)[1]
    rank = np.unique(id_rank * (1 << 32) + anchor, return_inverse=True)[1]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])
    shared[new] = 0
    out_entry, out_start, out_n = [], [], []

    whole = np.flatnonzero(kind == CHUNK)
    if len(whole):
        # equal strings share all their bytes
        differ = new.copy()
        differ[1:] |= (shared[1:] < size[1:]) | (size[1:] != size[:-1])
        group = np.cumsum(differ)[whole]
        again = _not_first(group, rank[whole])
        out_entry.append(whole[again])
        out_start.append(start[whole[again]])
        out_n.append(n[whole[again]])

    runs = np.flatnonzero(kind == RUN)
    if len(runs):
        far = length - min(GRAM, length)
        context = np.zeros((len(runs), far + 1), np.uint8)  # the byte before the anchor first
        for k, x in enumerate(runs.tolist()):
            if before[x]:
                context[k, : left[x]] = np.frombuffer(before[x], np.uint8)[::-1]
        most, least = left[runs], left[runs] - n[runs] + 1
        mark = np.zeros((len(runs), far + 2), bool)
        behind = np.zeros(len(runs), np.uint64)
        for d in range(far + 1):
            if d:
                with np.errstate(over="ignore"):
                    behind = common.mix(behind * common.BASE + context[:, d - 1] + np.uint64(1))
            act = np.flatnonzero((least <= d) & (d <= most))
            if not len(act):
                continue
            group = np.cumsum(shared < length - d)[runs[act]].astype(np.uint64)
            with np.errstate(over="ignore"):
                group = common.mix(common.mix(group * common.BASE + common.MIX_2) + behind[act] * common.MIX_1)
            again = _not_first(group, rank[runs[act]])
            mark[act[again], far - d] = True  # windows of growing start from left to right
        step = np.diff(np.concatenate([np.zeros((len(runs), 1), np.int8), mark.astype(np.int8)], axis=1), axis=1)
        e, a = np.nonzero(step == 1)
        _, z = np.nonzero(step == -1)
        out_entry.append(runs[e])
        out_start.append(anchor[runs[e]] - (far - a))
        out_n.append(z - a)
    entry = np.concatenate(out_entry) if out_entry else np.zeros(0, np.int64)
    return pa.table({"id": pa.array([ids[x] for x in entry.tolist()], id_kind),
                     "start": pa.array((np.concatenate(out_start) if out_start else entry).astype(np.int32)),
                     "n": pa.array((np.concatenate(out_n) if out_n else entry).astype(np.int32))})


def _not_first(group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places whose group has a smaller rank; equal ranks are the same position."""
    order = np.argsort(group, kind="stable")
    g, r = group[order], rank[order]
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    least = np.repeat(np.minimum.reduceat(r, head), np.diff(np.append(head, len(g))))
    return order[r > least]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, start, n): windows start .. start + n - 1 of a document occur earlier. Written to the shared folder."""
    spark = docs.sparkSession
    shared = common.Shared(spark, "suffix-dedup")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    spark_kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_kind = to_arrow_type(spark_kind)
    name = spark_kind.simpleString()

    prints = shared.write(rows.mapInArrow(lambda b: _fingerprints(b, length), f"id {name}, kind int, start int, n int, d int, h bigint"))
    known = shared.write(prints.where(F.col("kind") == KNOWN).select("id", "start", "n"))
    own = prints.where(F.col("kind") != KNOWN)
    often = (own.groupBy("kind", "h").agg(F.count("*").alias("times"), F.min(F.struct("id", "start")).alias("lead"))
             .where("times > 1"))
    marks = shared.write(own.join(often, ["kind", "h"]).select(
        "id", "kind", "start", "n", "d", "h", ((F.col("lead.id") == F.col("id")) & (F.col("lead.start") == F.col("start"))).alias("first"),
        ((F.col("times") > HOT) & (F.col("kind") == RUN)).alias("hot")))
    shared.drop(prints)
    del prints, own, often
    _release(spark)
    parts = max(1, -(-marks.count() // RANGE_ENTRIES))
    by_doc = marks.groupBy("id").agg(F.collect_list(F.struct("kind", "start", "n", "d", "h", "first", "hot")).alias("marks"))
    types = ("bigint", "int", "int", "binary", "binary", name, "int", "int")
    schema = "range int, " + ", ".join(f"{k} array<{t}>" for k, t in zip(BLOCK, types))
    runs = (rows.join(by_doc, "id").select("id", "text", "marks")
            .mapInArrow(lambda b: _sorted_runs(b, length, parts, id_kind), schema))
    merged = shared.write(runs.groupBy("range").applyInArrow(
        lambda t: _merge(t, length, id_kind), f"id {name}, start int, n int"))
    shared.drop(marks)
    del runs, by_doc, marks
    _release(spark)
    return known.unionByName(merged)


def _release(spark) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = common.text_buffer(b.column("text"))
        kept, spans = [], []
        for r, windows in enumerate(b.column("windows").to_pylist()):
            raw = buf[off[r]: off[r + 1]]
            depth = np.zeros(len(raw) + 1, np.int64)
            for w in windows or ():
                depth[min(w["start"], len(raw))] += 1
                depth[min(w["start"] + w["n"] + length - 1, len(raw))] -= 1
            inside = np.cumsum(depth)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            kept.append(raw[~inside].tobytes())
            spans.append([{"start": a, "end": z} for a, z in edge.reshape(-1, 2).tolist()])
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(np.diff(off)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, removed spans, kept bytes) of every row."""
    windows = (find(docs, id_col, text_col, length).groupBy(F.col("id").alias("known_id"))
               .agg(F.collect_list(F.struct("start", "n")).alias("windows")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = rows.schema["id"].dataType.simpleString()
    return (rows.join(windows, F.col("id") == F.col("known_id"), "left").select("id", "text", "windows")
            .mapInArrow(lambda b: _kept(b, length),
                        f"id {name}, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"))
