"""Personal data: patterns, and a skip-chain conditional random field over them.

Base spans are the leftmost non-overlapping matches of four patterns (email,
ip, card, phone) that pass their check. The nodes of the random field are the
base spans, whose labels are fixed, all other tokens of the document that hold a
digit or an at sign, and the numbers outside base spans that are written in
groups of digits (8 to 19 of them, with the separators of cards and phones). A
node has a potential by its shape; neighbouring nodes share a chain potential;
and distant nodes share a skip potential if they are equal, have the same digits
or all but one, or are addresses with the same local part. Loopy message passing
carries labels along both kinds of edges, so a token or number that repeats or
resembles a known entity of its document takes that entity's label. Such tokens
and numbers are reported as ``<kind>_like`` spans beside the base ones.

Potentials are learned piecewise from the base labels of a sample of about
``FIT_DOCS`` documents. Everything else covers whole texts of all rows; all
pattern matching is linear in a text's length.

Rows: a null or empty text has no spans; repeated rows and null ids come back
as they are; other columns are not read; positions are code points, ends
exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
FIT_DOCS = 20_000
ROUNDS = 10
DAMPING = 0.5
SMOOTH = 0.5
CERTAIN = 0.9
NEAR = 40  # characters between neighbours that share a chain potential
SIMILAR_DIGITS = range(8, 20)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits that an earlier start has tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s|,;\"'<>\[\]{}]+")
_GROUPS = re.compile(r"[0-9](?:[\x20().-]*+[0-9])++")  # separators after a digit are tried once
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
SHAPE_CHARS = 64  # longer shapes are known by a hash


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign: the run of local characters before it, the domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            yield a, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)  # local characters never include an at sign
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        x = ord(ch) - 48
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = [(a, b, "email") for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> str:
    """Runs of digits with their length, runs of letters, other characters as they are."""
    s = _RUN.sub(lambda m: f"d{min(len(m.group()), 20)}" if m.group()[0] in "0123456789" else "a", token)
    return s if len(s) <= SHAPE_CHARS else hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def grouped(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of the longest digit groups between base spans, 8 to 19 digits in two groups or more."""
    out, at = [], 0
    for a, b in [*sorted((a, b) for a, b, _ in base), (len(text), len(text))]:
        for m in _GROUPS.finditer(text, at, max(a, at)):
            digits = _digits(m.group())
            if len(digits) in SIMILAR_DIGITS and len(digits) < m.end() - m.start():
                out.append((m.start(), m.end()))
        at = max(at, b)
    return out


def nodes(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of base spans, of other tokens with a digit or an at sign, and of grouped numbers."""
    out = [(a, b, LABELS.index(k)) for a, b, k in base]
    free, busy = [], sorted((a, b) for a, b, _ in base)
    at = 0
    for m in _TOKEN.finditer(text):
        token = m.group().rstrip(".!?:()")
        a, b = m.start(), m.start() + len(token)
        if not token or _SIGN.search(token) is None:
            continue
        while at < len(busy) and busy[at][1] <= a:
            at += 1
        if at < len(busy) and busy[at][0] < b:
            continue
        free.append((a, b, 0))
    known = {(a, b) for a, b, _ in free}
    return sorted(out + free + [(a, b, 0) for a, b in grouped(text, base) if (a, b) not in known])


def edges(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain edges, skip edges); nodes with a common value are linked in a row, so edges stay linear.

    Numbers in the same digits are alike however they are grouped. A grouped
    number stands in the chain beside the tokens that it overlaps.
    """
    row: list[int] = []
    beside, end = [], 0
    for i, (a, b, k) in enumerate(spans):
        (row if k or a >= end else beside).append(i)
        end = max(end, spans[row[-1]][1])
    chain = list(zip(row, row[1:]))
    for i in beside:
        before = bisect.bisect_left(row, i) - 1
        while before >= 0 and spans[row[before]][1] > spans[i][0]:
            before -= 1
        after = bisect.bisect_left(row, spans[i][1], key=lambda x: spans[x][0])
        chain += [(row[before], i)] * (before >= 0) + [(i, x) for x in row[after: after + 1]]
    chain = sorted((x, y) for x, y in chain if spans[y][0] - spans[x][1] <= NEAR)
    last: dict[tuple, int] = {}
    skip = set()
    for i, (a, b, _) in enumerate(spans):
        token = text[a:b].lower()
        values: list[tuple] = [("same", token)]
        if "@" in token:
            values.append(("local", token.split("@")[0]))
        d = _digits(token)
        if len(d) in SIMILAR_DIGITS and 2 * len(d) > len(token):
            values += [("digits", d[:k], d[k + 1:]) for k in range(len(d))]
        for v in values:
            if v in last:
                skip.add((last[v], i))
            last[v] = i
    return chain, sorted(skip)


def potentials(tables: dict[str, Counter]) -> dict:
    """Log potentials from counted labels: of shapes, and of label pairs on both kinds of edges."""
    n = len(LABELS)
    prior = np.array([sum(c for (_, x), c in tables["node"].items() if x == k) for k in range(n)], float) + SMOOTH
    prior /= prior.sum()
    by_shape: dict[str, np.ndarray] = {}
    for (s, k), c in tables["node"].items():
        by_shape.setdefault(s, np.zeros(n))[k] += c
    node = {s: np.log((c + prior) / (c.sum() + 1)) for s, c in by_shape.items()}
    pair = []
    for name in ("chain", "skip"):
        m = np.zeros((n, n))
        for (x, y), c in tables[name].items():
            m[x, y] += c
            m[y, x] += c
        m = (m + SMOOTH) / (m.sum() + SMOOTH * n * n)
        own = m.sum(axis=1)
        pair.append(np.log(m / np.outer(own, own)))
    return {"prior": np.log(prior), "node": node, "pair": np.stack(pair)}


def marginals(own: np.ndarray, edge: np.ndarray, kind: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Label probabilities by loopy sum-product; every edge carries messages both ways."""
    e = len(edge)
    if e:
        src, dst = np.concatenate([edge[:, 0], edge[:, 1]]), np.concatenate([edge[:, 1], edge[:, 0]])
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        table = pair[np.concatenate([kind, kind])]
        msg = np.zeros((2 * e, own.shape[1]))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, dst, msg)
            x = (belief[src] - msg[back])[:, :, None] + table
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            msg = DAMPING * msg + (1 - DAMPING) * new
        own = own.copy()
        np.add.at(own, dst, msg)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def label(texts: list[str], model: dict) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each text."""
    out, own, edge, kind, owner, free = [], [], [], [], [], []
    for t, text in enumerate(texts):
        if _SIGN.search(text) is None:
            out.append(([], []))
            continue
        base = base_spans(text)
        out.append((base, list(base)))
        spans = nodes(text, base)
        if not spans:
            continue
        at = len(own)
        for i, (a, b, k) in enumerate(spans):
            if k:
                fixed = np.full(len(LABELS), -50.0)
                fixed[k] = 0
                own.append(fixed)
            else:
                own.append(model["node"].get(shape(text[a:b]), model["prior"]))
                free.append((at + i, t, a, b))
        for number, links in enumerate(edges(text, spans)):
            edge += [(at + i, at + j) for i, j in links]
            kind += [number] * len(links)
    if free:
        p = marginals(np.array(own), np.array(edge, np.int64).reshape(-1, 2), np.array(kind, np.int64), model["pair"])
        best = p.argmax(axis=1)
        last = (-1, 0)
        for i, t, a, b in sorted(free, key=lambda x: (x[1], x[2], -x[3])):
            if best[i] and p[i, best[i]] > CERTAIN and (t, b) > last:  # not the groups inside a number
                out[t][1].append((a, b, f"{LABELS[best[i]]}_like"))
                last = (t, b)
    order = [*KINDS, *(f"{k}_like" for k in KINDS)]
    return [(b, sorted(s, key=lambda x: (x[0], order.index(x[2])))) for b, s in out]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> dict:
    """Potentials from a sample of ``fit_docs`` documents, taken by a hash of id and text."""
    common.start(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, fit_docs / max(rows.count(), 1))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(place < share).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: Counter() for k in ("node", "chain", "skip")}
        for b in batches:
            for text in b.column("text").to_pylist():
                spans = nodes(text, base_spans(text))
                tables["node"].update((shape(text[a:e]), k) for a, e, k in spans)
                for name, links in zip(("chain", "skip"), edges(text, spans)):
                    tables[name].update((spans[i][2], spans[j][2]) for i, j in links)
        got = [(name, str(x), int(y), c) for name, t in tables.items() for (x, y), c in t.items()]
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate(
            (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["name", "x", "y", "n"])

    got = (picked.mapInArrow(count, "name string, x string, y bigint, n bigint")
           .groupBy("name", "x", "y").agg(F.sum("n").alias("n")).collect())  # as many as the sample has shapes
    tables = {k: Counter() for k in ("node", "chain", "skip")}
    for r in got:
        tables[r["name"]][(r["x"] if r["name"] == "node" else int(r["x"]), r["y"])] = r["n"]
    return potentials(tables)


SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row."""
    spark = docs.sparkSession
    common.start(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(model)  # as large as the shapes of the bounded sample
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            off = common.text_buffer(b.column("text"))[1]
            for i, j in common.slices(off):
                got = label([x or "" for x in b.column("text").slice(i, j - i).to_pylist()], m)
                columns = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in g[k]] for g in got], span) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), *columns], names=["id", "base", "spans"])

    return rows.mapInArrow(run, f"id {kind}, base {SPANS}, spans {SPANS}")
