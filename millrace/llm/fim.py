"""Fill-in-the-middle transformation by in-place block rotation, and its exact inverse.

A text becomes one bytearray of its UTF-8 bytes. Two cuts, given in characters,
are found by one scan over the lead bytes; the sentinels are put in, in text
order, and two neighbouring blocks then change places by a rotation of three
reversals inside the buffer, without a second copy of the text:

    <P> prefix <M> middle <S> suffix
    psm: [<M> middle] and [<S> suffix] change places
    spm: [<P> prefix <M> middle] and [<S> suffix] change places

``restore`` finds the sentinels in the output, rotates the same blocks back and
takes the sentinels out, so it needs the output and the form alone.

The draws are the first four groups of eight hex digits of the SHA-256 of
``<seed>:<id>``, so they depend on neither the layout of the table nor on retries:
two cuts, the share of texts left plain, and the share of the others in spm form.
Every row is worked on alone and in the task that reads it; no shuffle.

Rows: a null text is an empty one, and an empty text or one that holds a
sentinel stays plain, with null lengths. A row without an id is drawn as the
empty id. Repeated rows each give a row; an empty table gives none; other
columns are not read, whatever their names. A very long text takes about three
times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

# The sentinels and the shares, in hundredths
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM = 90
SPM_BELOW = 20
SEED = 1
SCHEMA = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"


def draws(ident: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).digest()
    return tuple(int.from_bytes(h[4 * i: 4 * i + 4], "big") for i in range(4))


def rotate(buf: bytearray, start: int, mid: int, end: int) -> None:
    """Blocks [start, mid) and [mid, end) of the buffer change places: three reversals."""
    view = np.frombuffer(buf, np.uint8)
    for a, b in ((start, mid), (mid, end), (start, end)):
        half = (b - a) // 2  # swap the halves from both ends; only half a block is held besides
        left = view[a: a + half].copy()
        view[a: a + half] = view[b - half: b][::-1]
        view[b - half: b] = left[::-1]
    del view  # the buffer may be resized again


def places(raw: bytes) -> np.ndarray:
    """Byte offset of every character, and the end."""
    b = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))


def transform(raw: bytes, first: int, last: int, form: str, at: np.ndarray) -> bytearray:
    """The text with its middle, characters ``first`` to ``last``, at the end."""
    i, j, end = int(at[first]), int(at[last]), len(raw)
    buf = bytearray(raw)
    buf[j:j] = SUFFIX
    buf[i:i] = MIDDLE
    buf[0:0] = PREFIX
    mid, suf, end = i + len(PREFIX), j + len(PREFIX) + len(MIDDLE), len(buf)
    rotate(buf, mid if form == "psm" else 0, suf, end)
    return buf


def restore(output: bytes, form: str) -> bytes:
    """The exact text from an output and its form."""
    if form == "plain":
        return bytes(output)
    buf, end = bytearray(output), len(output)
    suf, mid, pre = buf.find(SUFFIX), buf.find(MIDDLE), buf.find(PREFIX)
    if form == "psm":
        rotate(buf, suf, mid, end)
        mid, suf = suf, suf + end - mid
    else:
        rotate(buf, 0, pre, end)
        mid, suf = mid - pre, end - pre
    del buf[suf: suf + len(SUFFIX)]
    del buf[mid: mid + len(MIDDLE)]
    del buf[:len(PREFIX)]
    return bytes(buf)


def _rows(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offsets = common.text_buffer(b.column(1))
        ids = b.column(0).to_pylist()
        for lo, hi in common.slices(offsets):
            out: list[tuple] = []
            for k in range(lo, hi):
                raw = buf[offsets[k]: offsets[k + 1]].tobytes()
                at = places(raw)
                n = len(at) - 1
                h1, h2, h3, h4 = draws(ids[k], seed)
                if not raw or h3 % 100 >= PLAIN_FROM or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
                    out.append((ids[k], n, "plain", None, None, raw, raw))
                    continue
                form = "spm" if h4 % 100 < SPM_BELOW else "psm"
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                made = bytes(transform(raw, first, last, form, at))
                out.append((ids[k], n, form, first, last - first, made, restore(made, form)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
                 pa.array(cols[5], pa.binary()).cast(pa.string()), pa.array(cols[6], pa.binary()).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])


def apply(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, restored) of every row; ``restored`` from output and form."""
    common.start(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _rows(it, seed), SCHEMA)
