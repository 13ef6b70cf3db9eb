"""Histogram selection against a full sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, topk


def brute(rows, k=5):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(e is not None and np.isfinite(e) for e in x):
            v.setdefault(i, [int(np.floor(256 * float(e))) for e in x])
    out = []
    for q in sorted(i for i in v if i % 50 == 0):
        best = sorted((-max(min(sum(a * b for a, b in zip(v[q], v[c])), common.HIGH), common.LOW), c)
                      for c in v if c != q and len(v[c]) == len(v[q]))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return out


@pytest.mark.parametrize("cell_rows", [7, 4096])
def test_equals_a_full_sort(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(topk, "CELL_ROWS", cell_rows)
    r = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(0, 0.2, 8)]) for i in range(230)]
    rows += [(i, [0.25] * 8) for i in range(300, 340)]                       # ties
    rows += [(500, None), (501, []), (502, [float("nan")] * 8), (550, [None] * 8), (None, [0.1] * 8), (600, [0.5, 0.5])]
    rows += [(650, [1.0, 2.0]), (651, [1e8, 1.0]), (652, [-1e8, 3.0]), (653, [3e9, -3e9])]      # large components
    rows += [(700, [1.0] * 3), (701, [1e30, 1.0, 0.0]), (702, [1e30, -1e30, 5.0]), (703, [-1e30] * 3), (704, [2.0] * 3),
             (750, [1e30] * 3), (800, []), (801, [])]                                        # beyond 64 bits, and empty
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    out = topk.search(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((o["query_id"], o["rank"], o["id"], o["score"]) for o in out) == brute(rows)


def test_repeated_query_row_counts_once_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    out = topk.search(df, F.col("vec_id") % 50 == 0).collect()
    assert [tuple(o) for o in out] == [(0, 1, 7, 256 * 512)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
