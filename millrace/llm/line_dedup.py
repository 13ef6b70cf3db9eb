"""Line deduplication by a segment-partition edit join.

A line is what stands between line ends, without white space around it; edits
are counted in UTF-8 bytes. Lines of at least ``FUZZY_BYTES`` bytes are alike if
at most ``max_edits`` edits apart, shorter ones only if equal; blank lines are
left alone. ``max_edits`` is one number, or grows with the length of the shorter
line by classes (``MAX_EDITS``), each of which is joined exactly. Every line is split into max_edits + 1 segments: a line within
max_edits edits holds at least one of them unchanged, at a place that the two
lengths bound. So each line enters one bucket per (length, segment number,
segment) of its own, and probes those buckets of the lengths down to max_edits
less with its substrings at the possible places. The few lines that meet another
are split further: where a segment matches, the rest is split and probed again,
``LEVELS / max_edits`` levels deep, so that lines which only share a half do not
meet. Of lines that still meet, those are compared that share one of their
rarest substrings of ``GRAM`` bytes (``linking``) and whose sketches of the numbers
of short substrings are near enough, with a bit-parallel edit
distance inside a band of diagonals.

Lines are known by a 128-bit hash, half of it over a prime field at a base drawn
for the run; texts are read again only for the lines that meet. Similar lines form classes (connected lines); the first line of a class,
by document id and line number, is kept and all others are removed.

Rows: a null text has no lines; repeated rows of an id are one document; rows
without an id are left alone; an empty table gives no rows; other columns are
kept by ``remove`` and not read by ``find``.
"""

from __future__ import annotations

import bisect
import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common, linking

MAX_EDITS = ((16, 1), (64, 2), (128, 3))  # bytes of the shorter line from which on so many edits are allowed
FUZZY_BYTES = 16
LEVELS = 6
GRAM = 4  # bytes of the substrings by which lines that still meet are told apart
SKETCH_GRAMS = (2, 4)  # bytes of the substrings whose numbers a sketch keeps, odd or even
SKETCH_WORDS = 8  # of 64 bits, for each
CELL_BYTES = 8  # of a line, in which differences from another are in one place,
CELLS = 64  # or more, for no more than so many of a line
ROWS_A_LINE = 20  # buckets of a line, about
PART_ROWS = 1 << 18  # buckets that a task holds at a time, about
PARTS_A_TASK = 8
PACK_ROWS = 1 << 19  # buckets gathered before they are packed, about
HASH_BYTES = 1 << 18  # of text hashed at a time, so that the arrays stay in the processor's cache
KEY_BYTES = 5  # of a bucket that travel, beside its part

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, start, end) of every line that is not blank, white space trimmed."""
    n_rows = len(off) - 1
    ends = np.flatnonzero(buf == 10)
    row_of_end = np.searchsorted(off, ends, side="right") - 1
    start = np.concatenate([off[:-1], ends + 1])
    row = np.concatenate([np.arange(n_rows), row_of_end])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty_like(start)
    same = row[1:] == row[:-1]
    end[:-1] = np.where(same, start[1:] - 1, off[row[:-1] + 1])
    if len(end):
        end[-1] = off[-1]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    solid = np.flatnonzero(~_SPACE[buf])
    if not len(solid):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, end) - 1
    some = a <= b
    return row[some], number[some], solid[a[some]], solid[b[some]] + 1


def keys(part: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """(n, 2) hashes of the spans: over the prime field, and modulo 2**64."""
    return np.stack([common.field_hash(common.field_prefix(part, base), start, end, base),
                     common.span_hash(common.prefix_hash(part), start, end)], axis=1)


def binary16(k: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(k).view(np.uint8)
    offsets = np.arange(0, 16 * len(k) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def segments(length: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(offset, size) of each of the even segments of lines of the given lengths; the last ones are longer."""
    short, longer = length // parts, length % parts
    out, at = [], np.zeros_like(length)
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at = at + size
    return out


def edit_classes(max_edits: int | tuple) -> list[tuple[int, float, int]]:
    """(least, end, edits) for the lengths of the shorter line; all lines longer than the edits, if one number."""
    steps = [(max_edits + 1, max_edits)] if isinstance(max_edits, int) else sorted(max_edits)
    if any(least <= edits for least, edits in steps):
        raise ValueError("a line must be longer than the edits it allows")
    return [(least, end, edits) for (least, edits), end in zip(steps, [*(x for x, _ in steps[1:]), float("inf")])]


def bucket_rows(p: np.ndarray, start: np.ndarray, end: np.ndarray, max_edits: int | tuple,
                depth: int = 1, levels: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line index, bucket) for the segments of every line and its probes of lengths down to max_edits less.

    ``depth`` levels, or ``levels`` / edits if more: where a segment matches,
    the part that may still hold edits is split and probed in the same way.
    """
    size = end - start
    for least, most, edits in edit_classes(max_edits):
        for less in range(edits + 1):
            who = np.flatnonzero((size - less >= least) & (size - less < most))
            yield from _matches(p, who, start[who], end[who], less, edits, np.zeros(len(who), np.uint64),
                                max(depth, levels // max(edits, 1)))


def _matches(p: np.ndarray, who: np.ndarray, start: np.ndarray, end: np.ndarray, less: int, edits: int,
             tag: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of parts against parts ``less`` bytes shorter, at most ``edits`` edits apart.

    Segment i of the other part may stand from i edits left to edits - i edits
    right of its place, seen from either end.
    """
    other = end - start - less
    ok = other >= 0
    who, start, end, tag, other = who[ok], start[ok], end[ok], tag[ok], other[ok]
    if not len(who):
        return
    with np.errstate(over="ignore"):
        tag = common.mix(tag * common.BASE + other.astype(np.uint64) * np.uint64(64) + np.uint64(edits))
    for i, (at, size) in enumerate(segments(other, edits + 1)):
        for shift in range(-edits, edits + 1):
            if abs(shift) > i or abs(shift - less) > edits - i:
                continue
            a = start + at + shift
            ok = (a >= start) & (a + size <= end)
            w, x, y, z, e = who[ok], start[ok], a[ok], (a + size)[ok], end[ok]
            with np.errstate(over="ignore"):
                t = common.mix((tag[ok] + np.uint64(i + 1)) * common.BASE + common.span_hash(p, y, z))
            if depth == 1 or edits == 0:
                yield w, t
            elif edits > i:
                yield from _matches(p, w, z, e, less - shift, edits - i, t, depth - 1)
            else:
                yield from _matches(p, w, x, y, shift, i, t, depth - 1)


def within(a: bytes, b: bytes, most: int) -> bool:
    """True if the edit distance is at most ``most``: common ends cut, then the banded bit vectors."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x[:n] != y[:n])
    i = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[i:][::-1][: n - i] != y[i:][::-1][: n - i])
    j = int(differ[0]) if len(differ) else n - i
    return banded(a[i: len(a) - j], b[i: len(b) - j], most) <= most


def banded(a: bytes, b: bytes, most: int) -> int:
    """Edit distance, or more than ``most`` if it is larger.

    Bit t of the vectors is row column - most + t of the distance table: a
    column's vertical steps up and down inside the band of 2 * most + 1
    diagonals. The distance is followed down the band's lower edge and then
    along the last row.
    """
    n, width = len(a), 2 * most + 1
    full = (1 << width) - 1
    up, down = full & ~((1 << most) - 1), 0
    score = min(most, n)
    for col, ch in enumerate(b, 1):
        first = col - most - 1  # place in a of bit 0
        match = 0
        for t in range(max(0, -first), min(width, n - first)):
            if a[first + t] == ch:
                match |= 1 << t
        diag = ((((match & up) + up) ^ up) | match | down) & full
        right, left = (down | ~(diag | up)) & full, diag & up
        if col + most <= n:
            score += not diag >> width - 1 & 1
        else:
            bit = n - first - 1
            if bit < 0:
                return most + 1
            score += (right >> bit & 1) - (left >> bit & 1)
        up, down = (left | ~(diag >> 1 | right)) & full, (diag >> 1) & right
        if score > most + abs(len(b) - n) + most:
            return most + 1
    return score


def _hash_lines(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = common.text_buffer(b.column("text"))
        for i, j in common.slices(off, HASH_BYTES):
            part = buf[off[i]: off[j]]
            row, number, start, end = lines(part, off[i: j + 1] - off[i])
            k = keys(part, start, end, base)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(i, j - i).take(pa.array(row)), pa.array(number.astype(np.int32)), binary16(k)],
                names=["id", "line", "k"])


def bucket_parts(lines: int) -> int:
    """Parts of the space of buckets, a power of two: of some PART_ROWS rows each, whatever the input."""
    return 1 << max(lines * ROWS_A_LINE // PART_ROWS, 1).bit_length() - 1


def _bucket_lines(batches: Iterator[pa.RecordBatch], max_edits: int | tuple, fuzzy: int, base: int,
                  parts: int) -> Iterator[pa.RecordBatch]:
    """(part, keys, ids, met): one line of every bucket of some slices of text, and the lines that have met another there.

    So a bucket that many lines share costs one entry there. Buckets travel
    packed, one row for those of the slices that lie in one part: five bytes of
    each beyond the part, beside its line, known here by the first half of its
    hash. Two buckets that agree in those make lines meet that need not.
    """
    held, rows = [], 0
    for b in batches:
        buf, off = common.text_buffer(b.column("text"))
        for i, j in common.slices(off, HASH_BYTES):
            part = buf[off[i]: off[j]]
            _, _, start, end = lines(part, off[i: j + 1] - off[i])
            start, end = start[end - start >= fuzzy], end[end - start >= fuzzy]
            p = common.prefix_hash(part)
            k = common.field_hash(common.field_prefix(part, base), start, end, base)
            k, one = np.unique(k, return_index=True)  # equal lines here enter once
            for who, bucket in bucket_rows(p, start[one], end[one], max_edits):
                held.append((bucket, k[who]))
                rows += len(who)
            if rows >= PACK_ROWS:
                yield _packed(held, parts)
                held, rows = [], 0
    if rows:
        yield _packed(held, parts)


def _packed(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    bucket, k = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(bucket)
    bucket, k = bucket[order], k[order]
    first = np.append(True, bucket[1:] != bucket[:-1])
    of = k[first][np.cumsum(first) - 1]  # the first line of each row's bucket
    met = np.unique(np.concatenate([k[k != of], of[k != of]]))
    bucket, ids = bucket[first], k[first]
    bits = np.uint64(parts.bit_length() - 1)
    at = np.concatenate([[0], np.searchsorted(bucket, np.arange(1, parts, dtype=np.uint64) << (np.uint64(64) - bits)), [len(bucket)]])
    keys_ = np.ascontiguousarray(((bucket << bits) >> np.uint64(64 - 8 * KEY_BYTES)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
    some = np.flatnonzero(np.diff(at))
    at = np.append(at[some], at[-1])
    own = np.zeros(len(some), np.int64)
    own[int(ids[0] % np.uint64(len(some)))] = len(met)  # any one row takes them
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), _blobs(keys_, KEY_BYTES * at), _blobs(ids, 8 * at),
         _blobs(met, 8 * np.concatenate([[0], np.cumsum(own)]))], names=["part", "keys", "ids", "met"])


def _blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that share a bucket with another id, or have met one, from rows sorted by part; repeats may occur.

    Only the buckets of one part are held at a time.
    """
    now, held = None, []
    for b in batches:
        yield _ids(np.frombuffer(b"".join(b.column("met").to_pylist()), np.int64))
        part = b.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for i, j in zip(edges[:-1], edges[1:]):
            if i == j:
                continue
            if part[i] != now:
                yield _ids(_shared(held))
                now, held = part[i], []
            held += [(x, y) for x, y in zip(b.column("keys").slice(i, j - i).to_pylist(), b.column("ids").slice(i, j - i).to_pylist())]
    yield _ids(_shared(held))


def _ids(ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.unique(ids))], names=["id"])


def _shared(held: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The ids of buckets that hold two different ones or more."""
    raw = np.frombuffer(b"".join(x for x, _ in held), np.uint8).reshape(-1, KEY_BYTES)
    ids = np.frombuffer(b"".join(y for _, y in held), np.int64)
    keys_ = np.zeros((len(raw), 8), np.uint8)
    keys_[:, :KEY_BYTES] = raw
    keys_ = keys_.view(np.uint64).ravel()
    order = np.argsort(keys_)
    keys_, ids = keys_[order], ids[order]
    first = np.append(True, keys_[1:] != keys_[:-1])[: len(keys_)]
    owner = ids[first][np.cumsum(first) - 1]
    other = ids != owner
    return np.concatenate([ids[other], owner[other]])


def _raw(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.Table.from_batches([b]).column("raw").cast(pa.large_binary()).combine_chunks()
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset: raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2] or b"", np.uint8), off


def _bucket_texts(batches: Iterator[pa.RecordBatch], max_edits: int | tuple) -> Iterator[pa.RecordBatch]:
    """The buckets of single lines (id, raw), several levels deep."""
    for b in batches:
        buf, off = _raw(b)
        ids = b.column("id")
        for i, j in common.slices(off, common.SLICE_BYTES // 4):
            p = common.prefix_hash(buf[off[i]: off[j]])
            own = off[i: j + 1] - off[i]
            for who, bucket in bucket_rows(p, own[:-1], own[1:], max_edits, levels=LEVELS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), ids.take(pa.array(who + i))], names=["key", "id"])


def _pick_lines(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    """(id, raw) of the wanted line numbers of each text."""
    for b in batches:
        buf, off = common.text_buffer(b.column("text"))
        wanted = b.column("wanted").to_pylist()
        for i, j in common.slices(off, HASH_BYTES):
            part = buf[off[i]: off[j]]
            row, number, start, end = lines(part, off[i: j + 1] - off[i])
            own = {(r, x) for r in range(j - i) for x in wanted[i + r]}
            out = [x for x, place in enumerate(zip(row.tolist(), number.tolist())) if place in own]
            k = keys(part, start[out], end[out], base)
            yield pa.RecordBatch.from_arrays(
                [binary16(k), pa.array([part[start[x]: end[x]].tobytes() for x in out], pa.binary())], names=["k", "raw"])


def grams(raw: np.ndarray, start: np.ndarray, end: np.ndarray, max_edits: int | tuple) -> tuple[np.ndarray, ...]:
    """(line index, element, size, most) of the substrings of GRAM bytes of every line, the same ones numbered.

    An edit touches GRAM of them at most, so two lines within k edits share all but
    GRAM * k of either's, and one of the first GRAM * k + 1 in any order. Lines that have
    no more of them in all hold one element more, the same for all such lines.
    """
    return _placed_grams(raw, start, end, max_edits)[:4]


def _placed_grams(raw: np.ndarray, start: np.ndarray, end: np.ndarray, max_edits: int | tuple) -> tuple[np.ndarray, ...]:
    """What ``grams`` gives, and the place of each in its line, -1 if the line holds the substring twice."""
    p = common.prefix_hash(raw)
    length = end - start
    least, _, edits = (np.array(x) for x in zip(*edit_classes(max_edits)))
    allowed = edits[np.maximum(np.searchsorted(least, length, side="right") - 1, 0)]
    n = np.maximum(length - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = common.ranges(start, n)
    h = common.span_hash(p, at, at + GRAM)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))[: len(h)]
    place = np.where(new & np.append(new[1:], True)[: len(h)], (at - np.repeat(start, n))[order], -1)
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    with np.errstate(over="ignore"):
        el = common.mix(h + run.astype(np.uint64) * common.MIX_1)
    few = np.flatnonzero(n <= GRAM * allowed)
    owner, el, place = np.append(owner, few), np.append(el, np.zeros(len(few), np.uint64)), np.append(place, np.full(len(few), -1))
    size = n + (n <= GRAM * allowed)
    return owner, el, size[owner], np.minimum(GRAM * allowed + 1, size)[owner], place


def _grams(batches: Iterator[pa.RecordBatch], max_edits: int | tuple) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = _raw(b)
        for i, j in common.slices(off, common.SLICE_BYTES // 4):
            own = off[i: j + 1] - off[i]
            owner, el, size, most, place = _placed_grams(buf[off[i]: off[j]], own[:-1], own[1:], max_edits)
            at = pa.array(owner + i)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("comp").take(at), pa.array(el.view(np.int64)),
                 pa.array(size.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(place.astype(np.int32), mask=place < 0)],
                names=["id", "comp", "el", "size", "most", "at"])


def sketch(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(lines, words): for every size of SKETCH_GRAMS, one bit a class of substrings, set if their number is odd.

    An edit takes away at most ``size`` of them and brings as many, so lines
    within k edits differ in at most 2 * size * k bits of a size.
    """
    bits = 64 * SKETCH_WORDS
    out = np.zeros((len(start), len(SKETCH_GRAMS), SKETCH_WORDS), np.uint64)
    p = common.prefix_hash(raw)
    for g, size in enumerate(SKETCH_GRAMS):
        n = np.maximum(end - start - size + 1, 0)
        at = common.ranges(start, n)
        place = np.repeat(np.arange(len(n)) * bits, n) + (common.span_hash(p, at, at + size) % np.uint64(bits)).astype(np.int64)
        odd = np.bincount(place, minlength=len(n) * bits) & 1
        out[:, g] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(len(n), SKETCH_WORDS)
    return out.reshape(len(start), len(SKETCH_GRAMS) * SKETCH_WORDS)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = [f"w{i}" for i in range(len(SKETCH_GRAMS) * SKETCH_WORDS)]
    for b in batches:
        buf, off = _raw(b)
        for i, j in common.slices(off, common.SLICE_BYTES // 4):
            own = off[i: j + 1] - off[i]
            s = sketch(buf[off[i]: off[j]], own[:-1], own[1:]).view(np.int64)
            columns = [pa.array(np.diff(own)), *(pa.array(np.ascontiguousarray(c)) for c in s.T)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(i, j - i), pa.StructArray.from_arrays(columns, names=["length", *words])], names=["id", "sketch"])


def _edits(short: Column, max_edits: int | tuple) -> Column:
    """Edits allowed to two lines, from the bytes of the shorter one."""
    edits = F.lit(0)
    for least, _, k in edit_classes(max_edits):
        edits = F.when(short >= least, F.lit(k)).otherwise(edits)
    return edits


def affordable(x: Column, y: Column, max_edits: int | tuple) -> Column:
    """Whether the edits suffice for the substrings that either of two lines lacks.

    An edit touches at most GRAM substrings of a line, and stands at places of
    the two lines that are no more than the edits apart. So if what one line
    holds alone is that far from what the other holds alone, their edits add up.
    """
    edits = _edits(F.least(x["size"], y["size"]) + (GRAM - 1), max_edits)
    far = (x["hi"] + GRAM + edits < y["lo"]) | (y["hi"] + GRAM + edits < x["lo"])
    return ~F.coalesce(far & (F.ceil(x["lost"] / GRAM) + F.ceil(y["lost"] / GRAM) > edits), F.lit(False))


def alike(x: Column, y: Column, max_edits: int | tuple) -> Column:
    """Whether the sketches of two lines allow them to be within the edits."""
    edits = _edits(F.least(x["length"], y["length"]), max_edits)
    apart = F.abs(x["length"] - y["length"])
    ok = (apart <= max(k for _, _, k in edit_classes(max_edits))) & (apart <= edits)
    for g, size in enumerate(SKETCH_GRAMS):
        words = [f"w{i}" for i in range(g * SKETCH_WORDS, (g + 1) * SKETCH_WORDS)]
        differ = [F.bit_count(x[w].bitwiseXOR(y[w])) for w in words]
        ok = ok & (functools.reduce(operator.add, differ) <= edits * (2 * size))
    return ok


def _verify(batches: Iterator[pa.RecordBatch], max_edits: int | tuple) -> Iterator[pa.RecordBatch]:
    least, _, edits = zip(*edit_classes(max_edits))
    for b in batches:
        ok = [within(x, y, edits[max(bisect.bisect_right(least, min(len(x), len(y))) - 1, 0)])
              for x, y in zip(b.column("raw_a").to_pylist(), b.column("raw_b").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def reach(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int]:
    """The longest beginnings of a that are without and at most ``most`` edits from a beginning of b.

    Per number of edits, the place in a that each diagonal comes to; runs of
    equal bytes are taken at once.
    """
    n, m = len(a), len(b)
    stops = {}

    def run(i: int, d: int) -> int:
        """The place in a of the first difference on diagonal d from place i on."""
        lo, hi = max(0, -d), min(n, m - d)
        if d not in stops:
            stops[d] = np.flatnonzero(a[lo:hi] != b[lo + d: hi + d]) + lo
        k = stops[d].searchsorted(i)
        return int(stops[d][k]) if k < len(stops[d]) else hi

    none = run(0, 0)
    at = {0: none}
    for e in range(1, most + 1):
        if max(at.values()) >= n:
            break
        new = {}
        for d in range(-e, e + 1):
            i = max(at.get(d, -2) + 1, at.get(d - 1, -1), at.get(d + 1, -2) + 1)  # replaced, put in, left out
            i = min(i, n, m - d)
            if i >= max(0, -d):
                new[d] = run(i, d)
        at = new
    return none, max(at.values())


def differences(a: bytes, b: bytes, most: int, linked: bool) -> tuple[int, int, int, int]:
    """Two ranges of places in a, for b: lines that are within ``most`` edits of each other overlap in both.

    Of two such lines, one cannot leave a for good, by more than ``most`` edits,
    before the other one leaves it at all, seen from either end. So what lies
    between both places overlaps; for a line that is linked to a, what lies
    between its outermost differences overlaps those of the others. Two lines
    linked to a need not overlap.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    first, gone = reach(x, y, most)
    last, back = (len(a) - i for i in reach(x[::-1], y[::-1], most))
    if linked:
        return (min(first, last), max(first, last)) * 2
    return min(first, back), gone, back, max(last, gone)


def _divide(batches: Iterator[pa.RecordBatch], max_edits: int | tuple) -> Iterator[pa.RecordBatch]:
    least, _, edits = zip(*edit_classes(max_edits))
    for b in batches:
        out = []
        for p, x in zip(b.column("raw_p").to_pylist(), b.column("raw").to_pylist()):
            linked = within(p, x, edits[max(bisect.bisect_right(least, min(len(p), len(x))) - 1, 0)])
            most = max(edits[:max(bisect.bisect_right(least, len(x)), 1)])  # allowed to the line beside any other
            size = max(CELL_BYTES, -(-len(p) // CELLS))
            out.append((linked, *(i // size for i in differences(p, x, most, linked))))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 5, [pa.bool_()] + [pa.int32()] * 4)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("pivot"), *columns],
                                         names=["id", "pivot", "linked", "lo", "hi", "low", "high"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int | tuple = MAX_EDITS,
         fuzzy_bytes: int = FUZZY_BYTES) -> tuple[DataFrame, DataFrame]:
    """((id, line, first_id, first_line) of every line to remove, (id, lines) of documents with lines)."""
    spark = docs.sparkSession
    shared, base = common.Shared(spark, "line-dedup"), common.draw_base()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    places = shared.write(rows.mapInArrow(lambda b: _hash_lines(b, base), f"id {kind}, line int, k binary"))
    firsts = shared.write(places.groupBy("k").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n")))
    # lines that share a bucket with another line, and their texts, read at their first place
    fuzzy = max(fuzzy_bytes, edit_classes(max_edits)[0][0])
    parts = bucket_parts(places.count())
    members = rows.mapInArrow(lambda b: _bucket_lines(b, max_edits, fuzzy, base, parts), "part int, keys binary, ids binary, met binary")
    both = shared.write(members.repartition(max(parts // PARTS_A_TASK, 1), "part").sortWithinPartitions("part")
                        .mapInArrow(_meeting, "id bigint").distinct())  # written alone, so its shuffle files go before texts are shuffled
    digits = F.hex(F.substring("k", 1, 8))  # little-endian
    half = F.conv(F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2))), 16, -10).cast("bigint")
    wanted = (firsts.withColumn("half", half).join(both.withColumnRenamed("id", "half"), "half").groupBy(F.col("first.id").alias("id"))
              .agg(F.collect_set("first.line").alias("wanted")))
    texts = shared.write(rows.join(wanted.hint("shuffle_hash"), "id").mapInArrow(lambda b: _pick_lines(b, base), "k binary, raw binary").dropDuplicates(["k"])
                         .withColumn("id", F.monotonically_increasing_id()))
    shared.drop(both)
    # the same lines, each beside those that share all but a small part with it
    fine = shared.write(texts.select("id", "raw").mapInArrow(lambda b: _bucket_texts(b, max_edits), "key bigint, id bigint"))

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("raw").alias("raw_a"))
        b = texts.select(F.col("id").alias("b"), F.col("raw").alias("raw_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "raw_a", "raw_b").mapInArrow(
            lambda x: _verify(x, max_edits), "a bigint, b bigint")

    def elements(texts: DataFrame, ids: DataFrame) -> DataFrame:
        return texts.join(ids.hint("merge"), "id").select("id", "comp", "raw").mapInArrow(
            lambda x: _grams(x, max_edits), "id bigint, comp bigint, el bigint, size int, most int, at int")

    def sketches(texts: DataFrame, ids: DataFrame) -> DataFrame:
        words = ", ".join(f"w{i}: bigint" for i in range(len(SKETCH_GRAMS) * SKETCH_WORDS))
        return texts.join(ids.select("id").hint("merge"), "id").select("id", "raw").mapInArrow(
            _sketches, f"id bigint, sketch struct<length: bigint, {words}>")

    def divide(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        pivots = texts.select(F.col("id").alias("pivot"), F.col("raw").alias("raw_p"))
        return pairs.join(texts.select("id", "raw"), "id").join(pivots, "pivot").select("id", "pivot", "raw", "raw_p").mapInArrow(
            lambda x: _divide(x, max_edits), "id bigint, pivot bigint, linked boolean, lo int, hi int, low int, high int")

    lab = linking.link(fine, lambda ids: texts, verify, shared, elements, enough=lambda x, y: affordable(x, y, max_edits),
                       sketches=(sketches, lambda x, y: alike(x, y, max_edits)), divide=divide)
    shared.drop(fine)
    # classes of several lines: those that occur again, and those linked to others
    numbered = texts.select("k", "id").join(lab, "id")
    names = numbered.where("id = comp").select("comp", F.col("k").alias("name"))
    lab = numbered.join(names, "comp").select("k", F.col("name").alias("comp"))
    classed = firsts.join(lab, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    heads = classed.groupBy("comp").agg(F.min("first").alias("head"), F.sum("n").alias("total")).where("total > 1")
    heads = shared.write(classed.select("k", "comp").join(heads, "comp").select("k", "head"))
    removed = (places.join(heads, "k").where((F.col("id") != F.col("head.id")) | (F.col("line") != F.col("head.line")))
               .select("id", "line", F.col("head.id").alias("first_id"), F.col("head.line").alias("first_line")).distinct())
    counts = places.select("id", "line").distinct().groupBy("id").agg(F.count("*").alias("lines"))
    return shared.write(removed), counts


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int | tuple = MAX_EDITS,
           fuzzy_bytes: int = FUZZY_BYTES) -> DataFrame:
    """The documents without the removed lines, all columns kept.

    A document that had lines and keeps none, blank ones aside, is removed.
    """
    gone, counts = find(docs, id_col, text_col, max_edits, fuzzy_bytes)
    gone_id, gone_lines, gone_all = (common.unused(docs, c) for c in ("_gone_id", "_gone_lines", "_gone_all"))
    gone = gone.groupBy("id").agg(F.collect_set("line").alias(gone_lines))
    gone = (gone.join(counts, "id").withColumn(gone_all, F.size(gone_lines) >= F.col("lines"))
            .select(F.col("id").alias(gone_id), gone_lines, gone_all))
    kept = F.array_join(F.transform(
        F.filter(F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                 lambda s: ~F.array_contains(gone_lines, s["i"])), lambda s: s["x"]), "\n")
    joined = docs.join(gone, docs[id_col] == gone[gone_id], "left").where(~F.coalesce(gone_all, F.lit(False)))
    text = F.when(F.col(gone_id).isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))
