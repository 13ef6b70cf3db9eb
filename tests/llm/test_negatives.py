"""Hard negatives against a full sort and the SQL oracle."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, negatives
from millrace.llm.queries import ORACLES, QUERIES

NAME = "op13_secondary_sort_negatives"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=5, low=80, high=100):
    """Whole numbers and full sorts; one row an id."""
    v = {}
    for i, x, y in rows:
        if i is not None and y is not None and x is not None and all(e is not None and np.isfinite(e) for e in x):
            v[i] = ([int(np.floor(256 * float(e))) for e in x], y)
    out = []
    for a in sorted(i for i in v if i % every == 0):
        s = sorted((-sum(p * q for p, q in zip(v[a][0], v[c][0])), c) for c in v if c != a and len(v[c][0]) == len(v[a][0]))
        for neg_p, p in [x for x in s if v[x[1]][1] == v[a][1]][:k]:
            fits = [(n, c) for n, c in s if v[c][1] != v[a][1] and low * -neg_p <= 100 * -n <= high * -neg_p]
            out += [(a, p, r + 1, c, -neg_p, -n) for r, (n, c) in enumerate(fits[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    near = r.normal(0, 1, 6)
    rows = [(int(i), [float(np.float32(x)) for x in near + r.normal(0, 0.4, 6)], int(r.integers(0, 3))) for i in range(260)]
    rows += [(i, [0.25] * 6, i % 3) for i in range(300, 360)]                    # ties, also between labels
    rows += [(i, [0.0] * 6, i % 2) for i in range(400, 412)]                     # scores of 0
    rows += [(i, [-1.0 if j else 0.5 for j in range(6)], 1) for i in range(500, 504)]
    rows += [(600, [], 1), (601, [], 1), (602, [], 2), (700, [1e6] * 6, 1), (701, [1e6] * 6, 1), (702, [9e5] * 6, 0)]
    rows += [(800, None, 1), (801, [float("nan")] * 6, 1), (802, [None] * 6, 1), (803, [float("inf")] * 6, 1),
             (900, [0.1] * 6, None), (None, [0.1] * 6, 1), (1000, [0.5, 0.5], 1), (1001, [0.5, 0.5], 1), (1002, [0.5, 0.4], 2)]
    return rows


@pytest.mark.parametrize("cell_rows,anchor_rows", [(7, 2), (4096, 512)])
def test_equals_a_full_sort(spark, monkeypatch, vectors, cell_rows, anchor_rows):
    monkeypatch.setattr(negatives, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", anchor_rows)
    df = spark.createDataFrame(vectors, SCHEMA).withColumn("score", F.lit("clash")).withColumn("cell", F.lit(None))
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(vectors, 20)
    assert {r[0] for r in got} >= {600, 700, 1000}
    other = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 20 == 0, k=2, low=50, high=90).collect())
    assert other == brute(vectors, 20, 2, 50, 90)


@pytest.mark.parametrize("k", [1, 4])
def test_several_teams_and_cells_give_the_rows_of_one(spark, monkeypatch, vectors, k):
    monkeypatch.setattr(negatives, "CELL_ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(negatives, "TEAM_BYTES", 1000)
    monkeypatch.setattr(negatives, "CELL_PRODUCTS", 1)
    made, plain = [], negatives.layout
    monkeypatch.setattr(negatives, "layout", lambda *x: made.append(plain(*x)) or made[-1])
    df = spark.createDataFrame(vectors, SCHEMA)
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 20 == 0, k=k).collect()) == brute(vectors, 20, k)
    assert min(made[0]) > 1


def test_anchors_are_not_broadcast(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 1, 4)], i % 3) for i in range(600)]
    monkeypatch.setattr(negatives, "CELL_ROWS", 8)  # an anchor's copies grew with the number of blocks, in one broadcast
    plans, plain = [], common.Shared.write

    def write(self, df, *args, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(self, df, *args, **more)

    monkeypatch.setattr(common.Shared, "write", write)
    out = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("MapInArrow" in p for p in plans) > 2
    assert not any("BroadcastExchange" in p for p in plans)
    assert sorted(tuple(x) for x in out.collect()) == brute(rows)


def test_copies_of_anchors_stay_below_the_rows():
    for rows in (10**4, 10**6, 10**8):
        anchors = rows // 100
        teams, cells = negatives.layout(anchors, anchors * 1232, rows, rows * 64, rows // 4096)
        assert cells * anchors <= teams * rows and teams <= 1 + anchors * 1232 // negatives.TEAM_BYTES
        assert cells >= min(rows // 4096, 50 * teams) // 2 or rows == 10**4
    assert negatives.layout(0, 0, 0, 0, 0) == (1, 1)


@pytest.mark.parametrize("size", [3, 50, 1e5, 1e12, 1e200])
def test_blocks_of_a_task_give_the_best_of_all(size):
    r = np.random.default_rng(11)
    n, dim, k = 700, 3, 3
    m = np.floor(r.normal(0, size, (n, dim)))
    m[::7], m[1::9], m[5] = m[0], np.floor(r.normal(0, 3, dim)), 0
    ids, labels = r.integers(0, 500, n), r.integers(0, 4, n)
    at = np.unique(ids, return_index=True)[1][::5]
    s = common.products(m[at], m)

    def block(x, **more):
        ints = {"id": ids[x], "label": labels[x], **more}
        return {"n": len(x), "m": negatives._narrow(m[x]), **{c: np.asarray(v).astype("<i8").tobytes() for c, v in ints.items()}}

    def best(i, fits):
        j = np.flatnonzero(fits)
        return j[np.lexsort((ids[j], ~s[i][j]))][:k]

    def found(anchors):
        for i in range(0, n, 256):
            x = np.arange(i, min(i + 256, n))
            anchors.meet(len(x), ids[x], labels[x], m[x])
        return sorted(tuple(x) for b in anchors.found() for x in zip(*(c.to_pylist() for c in b.columns)))

    positives = [best(i, (labels == labels[x]) & (ids != ids[x])) for i, x in enumerate(at)]
    want = [(ids[x], s[i, j], ids[j]) for i, x in enumerate(at) for j in positives[i]]
    assert found(negatives._Positives(dim, [block(at[:9]), block(at[9:])], k)) == sorted(want)
    want = []
    for i, x in enumerate(at):
        scores = {int(p) for p in s[i, positives[i]]}
        rows = set()
        for p in scores:
            rows.update(best(i, (labels != labels[x]) & (ids != ids[x]) & [negatives.inside(int(c), p, 80, 100) for c in s[i]]).tolist())
        want += [(ids[x], s[i, j], ids[j]) for j in rows]
    blocks = [block(at[a:b], at=[len(p) for p in positives[a:b]], scores=np.concatenate([s[i, positives[i]] for i in range(a, b)]))
              for a, b in ((0, 9), (9, len(at)))]
    assert found(negatives._Negatives(dim, blocks, k, 80, 100)) == sorted(want)


def test_repeated_rows_and_an_empty_table(spark):
    rows = [(100, [1.0], 1), (100, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (2, [0.9], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r)[1:4] for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect())
    assert got == sorted([(1, r, 2) for r in (1, 2)] * 2)                # both rows of 1 are positives, both rows of 2 ranks
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(df, F.col("vec_id") % 100 == 0, high=110)


def test_products_are_whole_numbers_at_any_size():
    q = np.array([[3.0, 4.0], [2.0**40, 1.0], [1e300, 1e300]])
    c = np.array([[1.0, 2.0], [2.0**40, 3.0], [-1e300, 0.0]])
    want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q]
    want = [[min(max(x, common.LOW), common.HIGH) for x in r] for r in want]
    assert common.products(q, c).tolist() == want


def test_keys_sort_as_the_rows_should_be_met(spark):
    r = np.random.default_rng(5)
    rows = [(int(a), int(s), int(k), int(i)) for a, s, k, i in zip(
        r.choice([-5, 0, 9, common.LOW, common.HIGH], 300), r.choice([common.LOW, -1, 0, 1, 7, common.HIGH], 300),
        r.integers(0, 2, 300), r.integers(-3, 3, 300))]
    df = spark.createDataFrame(rows, "anchor long, score long, kind int, id long")
    keys = df.select(negatives.pack(F.col("anchor"), F.col("score"), F.col("kind"), F.col("id")).alias("key")).orderBy("key")
    out = [tuple(x) for x in negatives.unpack(keys.toArrow().column(0).combine_chunks()).tolist()]
    assert out == sorted(rows, key=lambda x: (x[0], -x[1], x[2], x[3]))


def test_query_equals_oracle(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        df = QUERIES[NAME](spark, sf)
        want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[NAME]})").fetchall())
        assert sorted(tuple(r) for r in df.collect()) == want and want
