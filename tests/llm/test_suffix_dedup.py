"""Substring removal against a dictionary of all windows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import suffix_dedup as sd


def brute(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        x = (texts[i] or "").encode()
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            s = x[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            else:
                seen.add(s)
        out[i] = bytes(b for b, g in zip(x, gone) if not g)
    return out


def texts(seed):
    rnd = random.Random(seed)
    src = "".join(rnd.choice("abcdef ") for _ in range(2500))
    out = {}
    for i in range(40):
        s = ""
        while rnd.random() < 0.8:
            k, a = rnd.random(), rnd.randint(0, 2400)
            s += (src[a:a + rnd.randint(20, 500)] if k < 0.5 else "".join(rnd.choice("xyz") for _ in range(90)) if k < 0.7
                  else "ab" * rnd.randint(1, 200) if k < 0.8 else "é" * rnd.randint(1, 120))
        out[i] = s
    return {**out, 40: None, 41: ""}


@pytest.mark.parametrize("seed, length, hot", [(1, 100, 5000), (2, 100, 3), (3, 40, 5000)])
def test_equals_brute_force(spark, monkeypatch, seed, length, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "RANGE_ENTRIES", 200)
    t = texts(seed)
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3)
    got = {r["id"]: bytes(r["kept"]) for r in sd.remove(df, length=length).collect()}
    assert got == brute(t, length)


def test_loser_tree_yields_order_and_common_prefixes():
    rnd = random.Random(2)
    for _ in range(300):
        runs = []
        for _ in range(rnd.randint(1, 9)):
            e = sorted((rnd.randint(0, 2), bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 8)))) for _ in range(rnd.randint(0, 12)))
            shared = [0] + [sd.common_prefix(a[1], b[1]) if a[0] == b[0] else 0 for a, b in zip(e, e[1:])]
            runs.append(([x[0] for x in e], shared[:len(e)], [x[1][s:] for x, s in zip(e, shared)]))
        out = [(runs[r][0][i], text, s) for r, i, text, s in sd.LoserTree(runs)]
        assert [o[:2] for o in out] == sorted(o[:2] for o in out)
        assert len(out) == sum(len(r[0]) for r in runs)
        for a, b in zip(out, out[1:]):
            if a[0] == b[0]:
                assert b[2] == sd.common_prefix(a[1], b[1])


def test_edges(edge_docs, no_docs):
    out = {}
    for r in sd.remove(edge_docs).collect():
        out.setdefault(r["id"], []).append(r)
    given = {}
    for r in edge_docs.collect():
        given.setdefault(r["doc_id"], (r["text"] or "").encode())
    assert sum(len(v) for v in out.values()) == edge_docs.count()
    want = brute({k: v.decode() for k, v in given.items() if k is not None}, 100)
    for k, v in out.items():
        assert all(bytes(r["kept"]) == (given[k] if k is None else want[k]) for r in v)
    assert sd.remove(no_docs).count() == 0
    assert sd.remove(edge_docs.select("doc_id", "text").where(F.col("text").isNull())).first()["n_bytes"] == 0
