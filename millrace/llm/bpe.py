"""BPE encoding and decoding by tree concatenation.

A short text is encoded as a whole inside its task. A text of more than
``long_chars`` characters is cut into leaves that are rows of their own, spread
over the cluster, encoded in parallel and put together again:

* the byte-level pattern always splits between a visible character and a space
  or line end, whatever stands around them, so leaves that meet there are
  concatenated as they are, and a worker remembers the tokens of words it has
  seen (at most ``MEMO_WORDS``);
* a stretch without such a place is split by the tokenizer's own
  pre-tokenizer, and an unsplit piece of more than ``leaf_chars`` characters is
  halved until its parts are short. Encoded halves are joined by encoding a
  window around the join anew and doubling the window until the new tokens
  agree with both halves at the window's ends. A BPE encoding is exact when
  each pair of neighbouring tokens is, so the spliced halves are the encoding
  of the whole.

Rows: a null or empty text has no tokens and decodes to the empty text; equal
long texts are encoded once; repeated rows and null ids come back as they are;
other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

LONG_CHARS = 65_536
LEAF_CHARS = 8_192
WINDOW = 8
BATCH_CHARS = 1 << 20
DECODE_IDS = 1 << 16

MEMO_WORDS = 300_000
MEMO_CHARS = 64

_CUT = re.compile(r"\S(?=[ \n])")
_WORD = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_OTHER_SPACE = re.compile(r"[^\S \t\r\n]")
_CODERS: dict[int, "Coder"] = {}


class Coder:
    """A tokenizer read from its JSON text, and its model without the pre-tokenizer."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_str(source)
        self.whole.no_truncation()
        self.whole.no_padding()
        self._source, self._model, self._table = source, None, None
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words not seen since the last turn are forgotten

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.memo) > MEMO_WORDS // 2:
            self.memo, self.older = {}, self.memo
        memo, get, older = self.memo, self.memo.get, self.older
        plain = [_OTHER_SPACE.search(t) is None for t in texts]
        pieces = [_WORD.findall(t) if p else [t] for t, p in zip(texts, plain)]
        new: dict[str, bytes] = dict.fromkeys(w for ws in pieces for w in ws if w not in memo)
        unseen = [w for w in new if w not in older]
        new.update((w, older[w]) for w in new if w in older)
        if unseen:
            got = self.whole.encode_batch_fast(unseen, add_special_tokens=False)
            new.update((w, pack(e.ids)) for w, e in zip(unseen, got))
        out = [b"".join([get(w) or new[w] for w in ws]) for ws in pieces]
        memo.update((w, x) for w, x in new.items() if len(w) <= MEMO_CHARS)
        return out

    @property
    def model(self):
        """The merges alone; only unsplit pieces need it."""
        if self._model is None:
            from tokenizers import Tokenizer
            self._model = Tokenizer.from_str(self._source).model
        return self._model

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(bytes, start, size) of every token for a byte-level decoder; the last entry, empty, is for unknown ids."""
        if self._table is None and json.loads(self._source)["decoder"]["type"] == "ByteLevel":
            # the model's characters stand for bytes: visible ones for themselves, the others from 256 on
            visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in visible}
            byte.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))})
            vocab = self.whole.get_vocab(with_added_tokens=True)
            tokens = [b""] * (max(vocab.values()) + 2)
            for t, i in vocab.items():
                tokens[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
            size = np.array([len(t) for t in tokens], np.int64)
            self._table = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
        return self._table

    def decode_packed(self, packed: list[bytes]) -> pa.Array:
        """The text of each list of packed ids, as the library decodes it."""
        if self.table is None:
            return pa.array(self.whole.decode_batch([unpack(x) for x in packed], skip_special_tokens=False), pa.string())
        data, start, size = self.table
        ids = np.frombuffer(b"".join(packed), "<u4")
        blocks, ends = [], [np.zeros(1, np.int64)]
        for i in range(0, len(ids), DECODE_IDS):
            some = np.minimum(ids[i: i + DECODE_IDS].astype(np.int64), len(size) - 1)
            blocks.append(data[common.ranges(start[some], size[some])])
            ends.append(ends[-1][-1] + np.cumsum(size[some]))
        raw = np.concatenate(blocks) if blocks else np.zeros(0, np.uint8)
        offsets = np.concatenate(ends)[np.cumsum([0, *(len(x) // 4 for x in packed)])]
        out = pa.Array.from_buffers(pa.large_string(), len(packed), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that are no encoding of a text
            out = pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])], pa.large_string())
        return out.cast(pa.string())

    def bare(self, mapped: str) -> list[int]:
        """Tokens of an unsplit piece given in the model's byte characters."""
        return [t.id for t in self.model.tokenize(mapped)]

    def mapped(self, ids: list[int]) -> str:
        return "".join(self.model.id_to_token(i) for i in ids)

    def join(self, a: list[int], b: list[int], width: int = WINDOW) -> list[int]:
        """Encoding of two neighbouring parts of one unsplit piece."""
        if not a or not b:
            return a + b
        while True:
            la, lb = min(width, len(a)), min(width, len(b))
            left, right = a[-la:], b[:lb]
            new = self.bare(self.mapped(left + right))
            whole_left, whole_right = la == len(a), lb == len(b)
            if (whole_left or new[0] == left[0]) and (whole_right or new[-1] == right[-1]):
                return a[: len(a) - la] + new + b[lb:]
            width *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Join the parts of one unsplit piece pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i]
                     for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def leaves(self, text: str, leaf_chars: int = LEAF_CHARS) -> Iterator[tuple[int, str]]:
        """(piece, leaf) in order of the text.

        Piece 0 marks a leaf that is encoded with the whole tokenizer. Leaves of
        the same piece > 0 are parts of one unsplit piece in the model's byte
        characters.
        """
        piece, at = 0, 0
        while at < len(text):
            if len(text) - at <= leaf_chars:
                yield 0, text[at:]
                return
            cut = 0
            for m in _CUT.finditer(text, at, at + leaf_chars):
                cut = m.end()
            if cut:
                yield 0, text[at:cut]
                at = cut
                continue
            m = _CUT.search(text, at + leaf_chars - 1)
            stop = m.end() if m else len(text)
            for special, part in self._specials(text[at:stop]):
                if special:
                    yield 0, part
                    continue
                for mapped, _ in self.whole.pre_tokenizer.pre_tokenize_str(part):
                    piece += 1
                    for leaf in halves(mapped, leaf_chars):
                        yield piece, leaf
            at = stop

    def _specials(self, text: str) -> Iterator[tuple[bool, str]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield False, text[at:m.start()]
            yield True, m.group()
            at = m.end()
        if at < len(text):
            yield False, text[at:]


def halves(piece: str, leaf_chars: int) -> Iterator[str]:
    if len(piece) <= leaf_chars:
        yield piece
    else:
        mid = len(piece) // 2
        yield from halves(piece[:mid], leaf_chars)
        yield from halves(piece[mid:], leaf_chars)


def coder(source: Broadcast) -> Coder:
    """The worker's tokenizer; loaded once."""
    text = source.value
    key = hash(text)
    if key not in _CODERS:
        _CODERS[key] = Coder(text)
    return _CODERS[key]


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def unpack(raw: bytes | None) -> list[int]:
    return np.frombuffer(raw or b"", dtype="<u4").tolist()


def _chunks(values: list, size) -> Iterator[list]:
    """Lists of about BATCH_CHARS in total."""
    out, n = [], 0
    for v in values:
        out.append(v)
        n += size(v)
        if n >= BATCH_CHARS:
            yield out
            out, n = [], 0
    if out:
        yield out


def tokenizer(docs: DataFrame, tokenizer_path: str) -> Broadcast:
    """The tokenizer file (a fixed file of about a megabyte) for every executor."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, source: Broadcast, id_col: str = "doc_id", text_col: str = "text",
           long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS, decoded: bool = False) -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit) of every row.

    With ``decoded`` also the text that the ids decode to, made by the same
    Python worker (a second step would need workers of its own).
    """
    common.start(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType
    more = ", text string" if decoded else ""
    schema = f"id {kind.simpleString()}, ids binary{more}"

    def columns(c: Coder, ids: list[bytes]) -> dict[str, pa.Array]:
        out = {"ids": pa.array(ids, pa.binary())}
        if decoded:
            out["text"] = c.decode_packed(ids)
        return out

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(source)
        for b in batches:
            for at, part in _offsets(b.column("text").to_pylist()):
                ids = c.encode_all(part)
                yield pa.RecordBatch.from_pydict({"id": b.column("id").slice(at, len(part)), **columns(c, ids)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(source)
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                got = list(c.leaves(text, leaf_chars))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(got), pa.string()), pa.array(range(len(got)), pa.int64()),
                     pa.array([p for p, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string())],
                    names=["key", "leaf", "piece", "part"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(source)
        for b in batches:
            ids = [pack(c.bare(x)) if p else c.encode_all([x])[0]
                   for p, x in zip(b.column("piece").to_pylist(), b.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("leaf"), b.column("piece"), pa.array(ids, pa.binary())],
                names=["key", "leaf", "piece", "ids"])

    def concat(table: pa.Table) -> pa.Table:
        c = coder(source)
        table = table.sort_by("leaf")
        out: list[int] = []
        open_piece, parts = 0, []
        for p, raw in zip(table.column("piece").to_pylist(), table.column("ids").to_pylist()):
            if p != open_piece or p == 0:
                out += c.tree(parts)
                open_piece, parts = p, []
            parts.append(unpack(raw))
        out += c.tree(parts)
        return pa.table({"key": table.column("key").slice(0, 1).cast(pa.string()), **columns(c, [pack(out)])})

    is_long = F.length("text") > long_chars
    done = rows.where(~is_long).mapInArrow(short, schema)
    long_rows = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    leaves = (long_rows.select("key", "text").dropDuplicates(["key"])
              .mapInArrow(cut, "key string, leaf bigint, piece bigint, part string")
              .repartition("key", "leaf")
              .mapInArrow(encode_leaves, "key string, leaf bigint, piece bigint, ids binary"))
    long_ids = leaves.groupBy("key").applyInArrow(concat, f"key string, ids binary{more}")
    return done.unionByName(long_rows.select("id", "key").join(long_ids, "key").drop("key"))


def _offsets(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    for part in _chunks(texts, len):
        yield at, part
        at += len(part)


def decode(encoded: DataFrame, source: Broadcast) -> DataFrame:
    """(id, ids, text): the texts that the ids of ``encode`` stand for."""
    kind = encoded.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(source)
        for b in batches:
            at = 0
            for part in _chunks(b.column("ids").to_pylist(), lambda x: len(x or b"")):
                texts = c.decode_packed([x or b"" for x in part])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(at, len(part)), b.column("ids").slice(at, len(part)), texts], names=["id", "ids", "text"])
                at += len(part)

    return encoded.mapInArrow(run, f"id {kind.simpleString()}, ids binary, text string")
